"""Connected components of links between 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node of ``links`` (``a``, ``b`` long).

    Alternating large-star and small-star rounds; each moves links to smaller neighbours by a minimum per
    node, which combines before the shuffle, so a hot node costs its links and nothing is gathered. Ends
    when a round changes no link. Loops (a = b) and repeated links are allowed; nodes without a link to
    another node are not in the result.
    """
    links = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    for _ in range(max_rounds):
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
