"""Row numbers over data of any size and any skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut_lineage


def number_urls(urls: DataFrame, start: Column | int = 0) -> DataFrame:
    """Dense ids ``start + 1 ...`` for distinct urls, the same on every run.

    Urls are numbered inside 65,536 buckets of their md5 prefix, which are even whatever
    the hosts look like, and each bucket is shifted by the sizes of the buckets before it.
    """
    keyed = urls.withColumn("bucket", F.substring(F.md5("url"), 1, 4))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 65,536 rows: one task may order them, and every executor may hold them.
    offsets = keyed.groupBy("bucket").agg(F.count("*").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("url"))
    return (
        keyed.withColumn("rn", inside)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("id", (F.lit(start) if isinstance(start, int) else start) + F.col("shift") + F.col("rn"))
        .drop("bucket", "rn", "shift")
    )


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` per group in ``order`` (a unique key), with no group held by one task.

    A range partitioning on group and order splits a hot group over many tasks. Each piece
    is numbered alone and shifted by the sizes of the group's earlier pieces.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("piece", F.spark_partition_id())
    # Range bounds come from a sample, so the pieces are fixed in a table before they are counted.
    pieces = cut_lineage(ranged)
    before = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and piece.
    shifts = pieces.groupBy("piece", *group).agg(F.count("*").alias("n")).withColumn(
        "shift", F.coalesce(F.sum("n").over(before), F.lit(0))
    ).drop("n")
    inside = Window.partitionBy("piece", *group).orderBy(*order)
    return (
        pieces.withColumn("rn", F.row_number().over(inside))
        .join(shifts, ["piece", *group])
        .withColumn(name, F.col("rn") + F.col("shift"))
        .drop("piece", "rn", "shift")
    )
