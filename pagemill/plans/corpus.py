"""From raw HTML to the page table and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html, text, urls
from pagemill.operators import frontier, indexing, language as languages, links, pages as page_table
from pagemill.operators.sizing import sized
from pagemill.session import cut_lineage


def distinct_pages(raw: DataFrame, order: str) -> DataFrame:
    """One row per normalised url, the first in ``order``, as ``(url, html, seq)``; of equal orders the smallest html."""
    normal = raw.select(urls.normalize_url(F.col("url")).alias("url"), "html", F.col(order).alias("seq"))
    counted = normal.groupBy("url").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    # Only the repeated urls travel, so the html is not shuffled unless very many repeat. They
    # are stored, so that then both sides are shuffled and a url of very many copies is split.
    repeated = cut_lineage(counted.filter("n > 1").drop("n"))
    if repeated.isEmpty():
        return normal
    known = sized(repeated)
    once = normal.join(known.select("url"), "url", "left_anti")
    first = normal.join(known, "url").filter(F.col("seq").eqNullSafe(F.col("first_seq")))
    return once.unionByName(first.groupBy("url").agg(F.min("html").alias("html"), F.first("seq").alias("seq")))


def load_corpus(
    existing: DataFrame, raw: DataFrame, crawled_at: Column, order: str = "page_id",
    depth: Column | None = None, model: tuple[DataFrame, DataFrame] | None = None, skip: list[str] = html.BODY_SKIP,
    readable: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Page table and edges after loading ``raw(url, html, order)`` into ``existing``.

    ``crawled_at`` may use the column ``seq``, the value of ``order``. With a language ``model`` (``language.train``)
    every page gets the language of its text; ``readable`` gives it the reading ease of its main text, which otherwise the index
    cycle sets. Both results are stored in the shared folder.
    """
    # Every extraction of a page happens in one projection; the page table and the link
    # graph both start from its stored result.
    fetched = distinct_pages(raw, order)
    found = fetched.withColumn("targets", html.outgoing_links(F.col("url"), F.col("html"), skip))
    extra = ["targets"]
    if readable:
        found = found.withColumn("main_text", html.main_text(F.col("html")))
        found = found.withColumn("readability_score", text.reading_ease(F.col("main_text")))
        extra.append("readability_score")
    extracted = cut_lineage(page_table.page_record(found, depth if depth is not None else F.lit(0), crawled_at, extra=extra))
    writes = extracted.drop(*extra)
    if model is not None:
        found = languages.identify(extracted.select("url", F.col("body_text").alias("text")), "url", model)
        # Only the writes need the language; a page without a url meets none.
        writes = writes.drop("language").join(found, "url").select(*writes.columns)
        extracted = extracted.filter(F.col("url").isNotNull())
    pages = page_table.upsert(existing, writes)
    if readable:
        ease = pages.select("id", "url").join(extracted.select("url", "readability_score"), "url").drop("url")
        pages = page_table.set_columns_by_id(pages, ease, ["readability_score"])
    pages = cut_lineage(pages)
    stubs, edges = links.load_links(pages.select("id", "url"), extracted.select("url", "targets"))
    seen = extracted.agg(F.max("crawled_at")).scalar()
    return cut_lineage(page_table.add_stubs(pages, stubs, seen)), cut_lineage(edges)


def index_cycle(
    pages: DataFrame, raw_html: DataFrame, index: DataFrame, now: Column, n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Page table and index after all pending pages, or the oldest ``n``: extract, replace documents, mark pages."""
    batch = cut_lineage(indexing.with_body(indexing.index_batch(pages, n), raw_html))
    marks = batch.select("id", "readability_score", now.alias("indexed_at"))
    return (
        page_table.set_columns_by_id(pages, marks, ["readability_score", "indexed_at"]),
        indexing.replace_documents(index, indexing.documents(batch)),
    )


def cleanup_cycle(
    pages: DataFrame, index: DataFrame, n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Page table and index after all deleted pages, or the first ``n``, left the index."""
    batch = cut_lineage(indexing.cleanup_batch(pages, n).select("id", "url"))
    return (
        page_table.set_index_mark(pages, batch, F.lit(None).cast("timestamp")),
        indexing.delete_documents(index, batch),
    )


def apply_retries(
    queue: DataFrame, visited: DataFrame, pages: DataFrame, decisions: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queue, visited set and page table after ``decisions(url, depth, decision)`` of the retry state.

    A url to fetch again is queued at its depth and may be visited again; one that failed for good stays
    visited and its page is marked as deleted.
    """
    again = decisions.filter(F.col("decision") == "requeue")
    failed = decisions.filter(F.col("decision") == "failed").select("url")
    return (
        frontier.merge_frontier(queue, again.select("url", "depth")), frontier.remove_visited(visited, again),
        page_table.soft_delete(pages, failed, now),
    )
