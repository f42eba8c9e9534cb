"""Exact dedup against a persistent index of digests, bucketed and sorted by hash.

* ``keyed`` reads each text once: white space runs become one space, and the SHA-256 of the UTF-8 bytes is its identity.
* ``DigestIndex`` is a table of Parquet files in a folder that all executors reach: one row per digest, in buckets by digest and
  sorted inside a file, with a folder per batch. ``add`` groups new rows by digest, drops those that the index has by a
  sort-merge anti join that shuffles the new side alone, and writes the rest as the folder of its batch. A batch that is added again replaces itself
  and sees only earlier batches, so a job that died is simply run again. ``compact`` writes a new index of one sorted file per
  bucket, which joins read without a sort.
* ``verdicts`` gives every row the one that stays. At most ``HOT_GROUPS`` digests can each have more than that share of the
  rows; those few go to all tasks, and rows of all others meet their digest by a shuffle in which no group is large.

The row that stays is the first of its batch: the smallest id, then the first as stored. Batches added in the order of ids
therefore keep the smallest id of all, and a later batch never replaces a row that an earlier one kept.

Defined results: a null text counts as empty, and empty texts are equal. A null id comes after all others; a group that
has only null ids keeps a row with a null id. Of repeated rows one stays. Very long texts are one value of a scan and are not moved. An
empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
HOT_GROUPS = 4096
#: Rows that a bucket is meant for, some 50 bytes each, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 4
COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch BIGINT"
#: While a batch is written: only its own folder is replaced, by files that were complete before; and a table of sorted
#: single files per bucket is read as sorted, which Spark leaves out by default.
WRITING = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text with every run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``digest`` and ``row`` (a number of its own) of every row; no text is carried further."""
    digest = text_digest(F.col(f"`{text}`")).alias("digest")
    return stored(df.select(F.col(f"`{key}`").cast("long").alias("id"), digest, F.monotonically_increasing_id().alias("row")), "rows")


class DigestIndex:
    """Digests that have been seen, with the row that stays for each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/entries'"
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """A new, empty index below ``path``, which must not have one."""
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """The index that an earlier session has left below ``path``."""
        index = cls(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])
        spark.sql(f"ALTER TABLE {index.name} RECOVER PARTITIONS")
        return index

    def entries(self) -> DataFrame:
        """``digest``, ``keep_id``, ``keep_row`` and ``batch`` of all digests."""
        return self.spark.table(self.name)

    def fresh(self, rows: DataFrame, batch: int) -> DataFrame:
        """The row that stays of every digest of ``rows`` that no earlier batch has."""
        first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        found = rows.groupBy("digest").agg(F.min(first).alias("first")).select(
            "digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")
        )
        seen = self.entries().filter(F.col("batch") < batch).select("digest")
        # Merge join: neither side has a size bound, and the index lies in the order of the key.
        return found.repartition(self.buckets, "digest").hint("merge").join(seen.hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Append the new digests of ``rows`` (``id``, ``digest``, ``row``) as ``batch``; batches are added in rising order."""
        self._write(self.fresh(rows, batch), batch)

    def _write(self, entries: DataFrame, batch: int) -> None:
        """The folder of a batch, whatever it held before, from ``entries`` in the buckets of the table."""
        conf, view = self.spark.conf, f"entries_{uuid.uuid4().hex}"
        before = {name: conf.get(name) for name in WRITING}
        entries.createOrReplaceTempView(view)
        try:
            for name, value in WRITING.items():
                conf.set(name, value)
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} SELECT digest, keep_id, keep_row, {int(batch)}L AS batch FROM {view}")
        finally:
            for name, value in before.items():
                conf.set(name, value)
            self.spark.catalog.dropTempView(view)

    def compact(self, path: str, buckets: int | None = None) -> DigestIndex:
        """A new index at ``path`` with the same entries as batch 0, a file per bucket."""
        made = DigestIndex.create(self.spark, path, buckets or self.buckets)
        made._write(self.entries().repartition(made.buckets, "digest"), 0)
        return made

    def close(self) -> None:
        """Forget the name of the table; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")


def verdicts(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of all ``rows``, which must be in the index."""
    counts = rows.groupBy("digest").agg(F.count("*").alias("group_size")).repartition(index.buckets, "digest")
    groups = stored(counts.hint("merge").join(index.entries().drop("batch").hint("merge"), "digest"), "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") > total // HOT_GROUPS + 1
    few = F.broadcast(groups.filter(hot))  # at most HOT_GROUPS digests have as many rows
    held = rows.join(few, "digest").unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(groups.filter(~hot), "digest"))
    return held.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def deduplicated(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", batches: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of every row of ``df``; the index stays at ``path``.

    Rows arrive in ``batches`` by rising id, each against the index that the earlier ones left.
    """
    rows = keyed(df, key, text)
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("id", [n / batches for n in range(1, batches)] or [0.5], 1000)).first()
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    index = DigestIndex.create(df.sparkSession, path, max(LEAST_BUCKETS, -(-n // bucket_rows)))
    for batch in range(len(cuts) + 1):
        part = rows
        if batch > 0:
            part = part.filter((F.col("id") > cuts[batch - 1]) | F.col("id").isNull() if batch == len(cuts) else F.col("id") > cuts[batch - 1])
        if batch < len(cuts):
            part = part.filter(F.col("id") <= cuts[batch])
        index.add(part, batch)
    found = verdicts(rows, index)
    index.close()
    return found
