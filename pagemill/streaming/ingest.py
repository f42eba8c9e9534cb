"""Streams of fetched pages into the page log, and the tables that the log stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemill import schemas
from pagemill.functions import html, urls
from pagemill.operators import links, pages as page_table
from pagemill.sources import tables
from pagemill.streaming import visited

LOG = T.StructType([*schemas.PAGE_WRITES.fields, T.StructField("targets", T.ArrayType(T.StringType()))])


def ingest(
    fetched: DataFrame, log_path: str, checkpoint: str, crawled_at: Column,
    skip: list[str] = html.BODY_SKIP, skip_visited: bool = True, order: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Append each micro-batch of ``(url, html)`` rows to the page log.

    A batch is extracted in one pass and written once, with its links beside its page
    columns. Urls that an earlier batch wrote are skipped: they are a table beside the log, in folders by url hash, of which a
    batch reads those of its own urls, so no state grows in the stream. Of rows of one url in a batch the first by ``order`` is taken, then the smallest
    html, so a replayed batch, which replaces its own folder, stores the same.
    """

    spark, seen = fetched.sparkSession, f"{log_path}-visited"
    # The log starts with an empty batch, so that it can be read from the first batch on.
    tables.append_batch(spark.createDataFrame([], LOG), log_path, -1)
    visited.add_batch(spark.createDataFrame([("",)], "url string"), seen, -1)  # a folder must be there; no page has this url

    def write(batch: DataFrame, number: int) -> None:
        place = F.struct(*([F.col(order)] if order else []), F.col("html"))
        rows = batch.groupBy(urls.normalize_url(F.col("url")).alias("url")).agg(F.min_by("html", place).alias("html"))
        if skip_visited:
            asked = batch.select(urls.normalize_url(F.col("url")).alias("url"))
            rows = rows.join(visited.earlier(asked, seen, number), "url", "left_anti")
        rows = rows.withColumn("seq", F.lit(2 * number)).withColumn(
            "targets", html.outgoing_links(F.col("url"), F.col("html"), skip)
        )
        record = page_table.page_record(rows, F.lit(0), crawled_at, extra=["targets"])
        tables.append_batch(record, log_path, number)
        if skip_visited:
            visited.add_batch(batch.sparkSession.read.schema(LOG).parquet(f"{log_path}/batch={number}"), seen, number)

    return (
        fetched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_pages(log: DataFrame) -> DataFrame:
    """Pages and link stubs after all batches of the log, without ids.

    The links of a batch come after its pages, so a page of the same batch is not a stub.
    """
    targets = log.select(F.explode("targets").alias("target_url"), "seq", "crawled_at").groupBy("target_url").agg(
        F.min("seq").alias("seq"), F.min("crawled_at").alias("crawled_at")
    )
    given = {
        "url": F.col("target_url"), "domain": urls.stub_domain(F.col("target_url")),
        "depth": F.lit(links.STUB_DEPTH), "crawled_at": F.col("crawled_at"), "is_stub": F.lit(True),
        "seq": F.col("seq") + 1,
    }
    stubs = targets.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGE_WRITES
    ])
    return page_table.fold_writes(log.select(*schemas.PAGE_WRITES.fieldNames()).unionByName(stubs))


def current_links(log: DataFrame) -> DataFrame:
    """Distinct ``(source_url, target_url)`` of the log."""
    return links.link_pairs(log.select("url", F.array_distinct("targets").alias("targets"))).distinct()
