"""Outgoing links and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html, urls
from pagemill.operators.numbering import number_urls
from pagemill.operators.sizing import sized
from pagemill.session import cut_lineage

STUB_DEPTH = -1


def page_outlinks(pages: DataFrame, skip: list[str] = html.BODY_SKIP) -> DataFrame:
    """``(url, targets)``: all valid link targets of each page, in page order, duplicates kept."""
    return pages.select("url", html.outgoing_links(F.col("url"), F.col("html"), skip).alias("targets"))


def link_pairs(outlinks: DataFrame) -> DataFrame:
    """One row per recorded link."""
    return outlinks.select(F.col("url").alias("source_url"), F.explode("targets").alias("target_url"))


def link_stubs(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Page rows for link targets that are not pages yet; ``targets`` has a ``target_url``."""
    unknown = targets.select(F.col("target_url").alias("url")).distinct().join(pages.select("url"), "url", "left_anti")
    return unknown.select(
        "url", urls.stub_domain(F.col("url")).alias("domain"), F.lit(STUB_DEPTH).alias("depth")
    )


def with_new_ids(known: DataFrame, new: DataFrame) -> DataFrame:
    """Give rows of ``new`` the ids after the largest known one."""
    largest: Column = F.coalesce(known.agg(F.max("id")).scalar(), F.lit(0))
    return number_urls(new, largest)


def resolve_edges(pairs: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Distinct ``(source_id, target_id)`` of link pairs whose two ends are known pages."""
    ids = page_ids.select("id", "url")
    source = ids.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"))
    target = ids.select(F.col("id").alias("target_id"), F.col("url").alias("target_url"))
    return (
        pairs.select("source_url", "target_url").distinct()
        .join(source, "source_url").join(target, "target_url")
        .select("source_id", "target_id")
    )


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edge set with the new edges added once."""
    return edges.select("source_id", "target_id").union(new.select("source_id", "target_id")).distinct()


def drop_dangling_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges of removed pages vanish: keep those whose two ends still exist."""
    ids = pages.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    ).select("source_id", "target_id")


def load_links(page_ids: DataFrame, outlinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stub rows (with ids) for unknown targets, and the distinct edges of all pages in ``outlinks``.

    A page's links are made distinct inside its row and get the source id before they are exploded; only the
    target side needs a shuffle. Rows of a url that has several are made distinct apart. Both
    arguments are read more than once, so they should be stored tables.
    """
    unique = outlinks.withColumn("targets", F.array_distinct("targets"))
    targets = unique.select(F.explode("targets").alias("target_url"))
    stubs = cut_lineage(with_new_ids(page_ids, link_stubs(targets, page_ids)))
    known = page_ids.select("id", "url").unionByName(stubs.select("id", "url"))

    def from_source(rows: DataFrame) -> DataFrame:
        return rows.join(page_ids.select(F.col("id").alias("source_id"), "url"), "url").select(
            "source_id", F.explode("targets").alias("target_url")
        )

    repeated = cut_lineage(unique.groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").select("url"))
    if repeated.isEmpty():
        pairs = from_source(unique)
    else:
        few = sized(repeated)
        pairs = from_source(unique.join(few, "url", "left_anti")).union(from_source(unique.join(few, "url", "left_semi")).distinct())
    edges = pairs.join(
        known.select(F.col("id").alias("target_id"), F.col("url").alias("target_url")), "target_url"
    ).select("source_id", "target_id")
    return stubs, edges
