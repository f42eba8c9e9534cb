"""The rank cycle: link graph, page rank and composite score in the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import scores
from pagemill.operators import graph


def score_pages(pages: DataFrame, ranks: DataFrame, as_of: Column) -> DataFrame:
    """Page table with fresh scores; pages without a rank keep their old ones."""
    fresh = scores.freshness(F.col("crawled_at"), as_of)
    qual = scores.quality(F.col("text_length"))
    domain = scores.domain_authority(F.col("url"))
    new = {
        "rank_score": scores.composite(F.col("raw_rank"), fresh, qual, F.col("readability_score"), domain),
        "freshness_score": fresh, "quality_score": qual, "domain_score": domain,
    }
    ranked = F.col("raw_rank").isNotNull()
    joined = pages.join(ranks.select("id", F.col("score").alias("raw_rank")), "id", "left")
    return joined.select(*[
        F.when(ranked, new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n)
        for n in schemas.PAGES.fieldNames()
    ])


def rank_cycle(pages: DataFrame, edges: DataFrame, as_of: Column, **options) -> DataFrame:
    """Rank all pages, stubs and deleted ones included, and update their scores."""
    return score_pages(pages, graph.pagerank(pages.select("id"), edges, **options), as_of)
