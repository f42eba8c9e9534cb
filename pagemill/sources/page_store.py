"""The page table on disk, in folders by url hash, of which a change rewrites only those of its urls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas
from pagemill.operators import pages as page_table
from pagemill.session import cut_lineage

SCHEMA = T.StructType([*schemas.PAGES.fields, T.StructField("folder", T.IntegerType())])


class PageStore:
    """A page table below ``path`` in ``folders`` folders by the hash of the url.

    A change reads the folders of its urls, and their new files take the place of the old ones when all are
    written; the files of every other folder stay as they are. A change that died is run again: it finds what it
    has written as known pages and writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int = 256):
        self.spark, self.path, self.folders = spark, path, folders

    def folder_of(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.folders)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).select(*schemas.PAGES.fieldNames())

    def write(self, pages: DataFrame) -> None:
        """Replace the folders that ``pages`` has rows in."""
        rows = pages.select(*schemas.PAGES.fieldNames()).withColumn("folder", self.folder_of(F.col("url")))
        rows.repartition("folder").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("folder").parquet(self.path)

    def of_urls(self, urls: DataFrame) -> DataFrame:
        """The pages in the folders of ``urls``, a stored table; other folders are not read."""
        touched = [r[0] for r in urls.select(self.folder_of(F.col("url"))).distinct().collect()]  # at most as many as folders
        return self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("folder").isin(touched)).drop("folder")

    def change(self, urls: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the folders of ``urls`` with ``changed`` of their pages."""
        self.write(changed(self.of_urls(urls)))

    def upsert(self, writes: DataFrame, promote_stubs: bool = False) -> None:
        """Fold page writes into the table. Of other folders only the ids are looked at, for the largest."""
        batch = cut_lineage(page_table.fold_writes(writes, promote_stubs))
        self.change(batch, lambda pages: page_table.upsert_folded(pages, batch, promote_stubs, all_pages=self.read()))

    def soft_delete(self, failed: DataFrame, now: Column) -> None:
        gone = cut_lineage(failed.select("url").distinct())
        self.change(gone, lambda pages: page_table.soft_delete(pages, gone, now))
