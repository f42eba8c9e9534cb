"""Intermediate tables laid out by a join key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import work_path


def bucketed(df: DataFrame, key: str, buckets: int, made: list[str], order: str | None = None) -> DataFrame:
    """``df`` written as a table in ``buckets`` by ``key`` and read back.

    Joins and groupings on ``key`` with as many partitions read the table without a
    shuffle, as often as they like, and its lineage starts at the files, which lie in the shared folder like those
    of every stored step. With ``order`` the rows of a bucket lie in the order of that column. The table's name is added to ``made``: who starts the job forgets those names when it ends.
    """
    spark = df.sparkSession
    name = f"pagemill_{uuid.uuid4().hex}"
    made.append(name)
    dealt = df.repartition(buckets, key)
    dealt = dealt if order is None else dealt.sortWithinPartitions(order)
    dealt.write.bucketBy(buckets, key).option("path", work_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def drop_tables(spark: SparkSession, made: list[str]) -> None:
    """Take the names out of the catalog; the files go with the folder of the application."""
    for name in made:
        spark.sql(f"drop table if exists {name}")
