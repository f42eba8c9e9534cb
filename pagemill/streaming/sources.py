"""Stream readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Stream of the Parquet files of a folder whose names match ``pattern``.

    A matching name may also be a folder, as Spark writes a table: its files are then read. The pattern stands in braces, since a
    file source takes a single file as part of a pattern only.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{pattern}}}")
