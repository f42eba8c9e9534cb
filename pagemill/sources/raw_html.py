"""Content-addressed store of raw HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls

KEY = r"raw_html/[0-9a-f]{64}\.html"


def store_rows(pages: DataFrame) -> DataFrame:
    """``(raw_html_path, html)`` rows for pages with a normalised ``url``."""
    return pages.select(urls.raw_html_key(F.col("url")).alias("raw_html_path"), "html")


def write_store(pages: DataFrame, path: str) -> None:
    """Write the store as Parquet in 256 folders by the first two hex digits of the key.

    The keys are hashes, so the folders are even whatever the hosts look like.
    """
    rows = store_rows(pages).withColumn("prefix", F.substring("raw_html_path", 10, 2))
    spread = rows.repartition("prefix", F.substring("raw_html_path", 12, 2))
    spread.write.mode("overwrite").partitionBy("prefix").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(raw_html_path, html)`` rows from one object per page below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.html"
    ).load(path)
    return files.select(
        F.regexp_extract("path", KEY, 0).alias("raw_html_path"), F.decode("content", "UTF-8").alias("html")
    )
