"""Crawl frontier: what to visit next, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators.numbering import row_numbers

# Urls taken from the queue at a time, seconds between two fetches of one
# host, fetches per minute over all hosts, links followed from a seed.
POP_SIZE = 20
DELAY_SECONDS = 1.0
MAX_PER_MINUTE = 60
MAX_DEPTH = 3


def enqueue(links: DataFrame, visited: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Frontier rows for ``(target_url, depth)`` links found at ``depth``.

    Pages at ``max_depth`` add nothing, visited urls stay out, and a url found at several
    depths is queued at the smallest.
    """
    return (
        links.filter(F.col("depth") < max_depth)
        .groupBy(F.col("target_url").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        .join(visited.select("url"), "url", "left_anti")
    )


def merge_frontier(frontier: DataFrame, added: DataFrame) -> DataFrame:
    return frontier.select("url", "depth").union(added.select("url", "depth")).groupBy("url").agg(
        F.min("depth").alias("depth")
    )


def pop(frontier: DataFrame, n: int = POP_SIZE) -> DataFrame:
    """The ``n`` urls of smallest depth, ties in url order."""
    return frontier.orderBy("depth", "url").limit(n)


def add_visited(visited: DataFrame, fetched: DataFrame) -> DataFrame:
    return visited.select("url").union(fetched.select("url")).distinct()


def remove_visited(visited: DataFrame, retried: DataFrame) -> DataFrame:
    return visited.join(retried.select("url").distinct(), "url", "left_anti")


def fetch_schedule(
    frontier: DataFrame, delay_seconds: float = DELAY_SECONDS, max_per_minute: int = MAX_PER_MINUTE
) -> DataFrame:
    """Planned second of each fetch: hosts are spaced out, and each minute has a cap.

    ``(url, depth)`` gains ``domain``, ``host_turn``, ``global_turn`` and ``fetch_at``, in
    seconds after the start.
    """
    hosts = frontier.select("url", "depth", urls.netloc(F.col("url")).alias("domain"))
    turns = row_numbers(hosts, ["domain"], ["depth", "url"], "host_turn").withColumn(
        "host_at", (F.col("host_turn") - 1) * F.lit(float(delay_seconds))
    )
    ranked = row_numbers(turns, [], ["host_at", "depth", "url"], "global_turn")
    minute = F.floor((F.col("global_turn") - 1) / F.lit(max_per_minute)) * 60.0
    return ranked.select(
        "url", "domain", "depth", "host_turn", "global_turn", F.greatest("host_at", minute).alias("fetch_at")
    )
