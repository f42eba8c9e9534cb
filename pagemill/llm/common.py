"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import work_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What Python gets of a table at once, in bytes: 10,000 rows, the usual batch, are tens of MB of texts on either side.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: A word, for Spark's regular expressions; ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside hand their rows to Python in batches of ``BATCH_BYTES``; a longer row is a batch of its own."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and safe from lost executors.

    The shuffle files of the job go with its end, since no later one reads them. Python gets its rows in small batches.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        with small_batches(spark):
            df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """64-bit hash that tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
