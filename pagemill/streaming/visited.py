"""The visited set of a crawl as a table in folders by url hash, of which a small batch reads few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import cut_lineage

#: Folders of a batch; a batch that finds few urls is compared with as few.
FOLDERS = 1024
SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("folder", T.IntegerType()),
])


def folder_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDERS)).cast("int")


def add_batch(urls: DataFrame, path: str, batch: int) -> None:
    """Distinct ``url`` rows of one batch. A replayed batch replaces itself."""
    rows = urls.select("url", folder_of(F.col("url")).alias("folder"))
    rows.repartition("folder").write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("folder").parquet(
        f"{path}/batch={batch}"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def earlier(urls: DataFrame, path: str, batch: int) -> DataFrame:
    """The visited urls of earlier batches in the folders of ``urls``; no other folder is read."""
    touched = [r[0] for r in urls.select(folder_of(F.col("url"))).distinct().collect()]  # FOLDERS numbers at most
    return read(urls.sparkSession, path).filter((F.col("batch") < batch) & F.col("folder").isin(touched)).select("url")


def compact(spark: SparkSession, path: str, new_path: str, last_batch: int) -> None:
    """All urls as one batch of a new table, so that a folder is one file again."""
    add_batch(cut_lineage(read(spark, path).select("url").distinct()), new_path, last_batch)
