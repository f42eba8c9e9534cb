"""Incremental index: new page contents become index documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemill import schemas
from pagemill.functions import html, scores, text
from pagemill.operators import indexing
from pagemill.session import cut_lineage
from pagemill.sources import tables

LOG = T.StructType([
    *schemas.INDEX_DOCUMENTS.fields, T.StructField("readability_score", T.DoubleType()),
    T.StructField("deleted", T.BooleanType()), T.StructField("synced_at", T.TimestampType()),
])


def sync_index(
    changed: DataFrame, log_path: str, checkpoint: str, now: Column, first_batch: int = 0, trigger: dict | None = None,
    postings_path: str | None = None,
) -> StreamingQuery:
    """Append index documents for a stream of changed pages, and with ``postings_path`` their postings.

    ``changed`` has the document columns except ``body_text``, ``crawled_at`` as a timestamp, ``indexed_at``,
    ``deleted_at`` and ``html``. Pages that were not crawled since they were indexed are left out. A deleted page that is in the index
    becomes a tombstone, one that never was is nothing. Extraction needs no
    state and no shuffle: each micro-batch is one pass. ``now`` is when the batch counts as indexed;
    ``first_batch`` continues the numbers of an earlier stream.
    """
    gone = F.col("deleted_at").isNotNull()
    body = F.when(gone, F.lit("")).otherwise(F.coalesce(html.main_text(F.col("html")), F.lit("")))
    given = {
        "crawled_at": scores.epoch_seconds(F.col("crawled_at")),
        "rank_score": F.coalesce("rank_score", F.lit(scores.DEFAULT_RANK_SCORE)),
        "body_text": F.col("main_text"), "readability_score": text.reading_ease(F.col("main_text")),
        "deleted": gone, "synced_at": now,
    }
    due = F.when(gone, F.col("indexed_at").isNotNull()).otherwise(indexing.is_stale())
    documents = changed.filter(due).withColumn("main_text", body).select(
        *[given.get(n, F.col(n)).alias(n) for n in LOG.fieldNames()]
    )
    def write(batch: DataFrame, number: int) -> None:
        tables.append_batch(batch, log_path, first_batch + number)
        if postings_path is not None:
            # From what was stored, so that no page is extracted twice.
            stored = batch.sparkSession.read.schema(LOG).parquet(f"{log_path}/batch={first_batch + number}")
            kept = stored.groupBy("url").agg(F.max_by(F.struct(*LOG.fieldNames()), F.struct("crawled_at", "id", "deleted")).alias("d"))
            indexing.append_postings(kept.select("d.*").filter(~F.col("deleted")), postings_path, first_batch + number)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _latest(log: DataFrame, key: str) -> DataFrame:
    """Which row of the log is the last of each ``key``; texts are not read for it."""
    last = log.groupBy(key).agg(F.max(F.struct("batch", "crawled_at", "id", "deleted")).alias("last"))
    return last.select(key, "last.*")


def current_index(log: DataFrame) -> DataFrame:
    """The latest document of each url that is not deleted."""
    last = _latest(log, "url").filter(~F.col("deleted"))
    return log.join(last, ["url", "batch", "crawled_at", "id", "deleted"], "left_semi").select(*LOG.fieldNames())


def live_versions(log: DataFrame) -> DataFrame:
    """``(id, version)`` of the documents in the index: which batch's postings of an id count. A stored, narrow table."""
    last = _latest(log, "url").filter(~F.col("deleted"))
    return cut_lineage(last.select("id", F.col("batch").alias("version")).distinct())


def index_marks(log: DataFrame) -> DataFrame:
    """``(id, indexed_at)`` of every page in the log, null once it was deleted: what the page table should say."""
    last = log.groupBy("id").agg(F.max_by(F.struct("deleted", "synced_at"), F.struct("batch", "crawled_at")).alias("last"))
    return last.select("id", F.when(~F.col("last.deleted"), F.col("last.synced_at")).alias("indexed_at"))
