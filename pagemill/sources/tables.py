"""Parquet tables and append-only batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, spread_by: str | None = None
) -> DataFrame:
    """A Parquet table.

    ``spread_by`` names a unique key. A table of one split, as a small file is, is spread by it, so that
    text work does not run in one task; that moves at most one split's bytes. Any other table is read as it lies.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(path)
    if spread_by is None or table.rdd.getNumPartitions() > 1:
        return table
    return table.repartition(spark.sparkContext.defaultParallelism, spread_by)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a new snapshot; a path that already has one is an error."""
    df.write.mode("errorifexists").parquet(path)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch of a log below ``path``. A replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a log with their ``batch`` number.

    The state of a table is a fold over its log, so a small batch costs its own size and
    nothing is rewritten; ``compact`` bounds the number of batches to read.
    """
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def compact(folded: DataFrame, path: str, last_batch: int) -> None:
    """Start a new log at ``path`` with the folded state as its first batch."""
    append_batch(folded, path, last_batch)
