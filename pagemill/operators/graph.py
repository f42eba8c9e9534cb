"""Iterative graph jobs over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.sizing import small
from pagemill.session import cut_lineage
from pagemill.sources.buckets import bucketed, drop_tables

# Damping factor and number of rounds of the page rank.
DAMPING = 0.85
ITERATIONS = 20

# Nodes with more links than this are kept apart.
HOT_DEGREE = 1_000_000
# Edges of a bucket, about; the side that is hashed is the sources of one bucket.
BUCKET_EDGES = 2_000_000


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of outgoing links of every node, 0 for none."""
    counted = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links_out"))
    return nodes.select("id").join(counted, "id", "left").select(
        "id", F.coalesce("links_out", F.lit(0)).alias("links_out")
    )


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    damping: float = DAMPING,
    iterations: int = ITERATIONS,
    checkpoint_every: int = 5,
    hot_degree: int = HOT_DEGREE,
    dangling: str = "drop",
) -> DataFrame:
    """Page rank by power iteration: ``(id, score)`` for every node.

    All nodes count, scores start at 1/N and the number of rounds is fixed. A node's score is divided by its link count
    before it meets the edges, so the edges carry two ids and nothing else.

    The score of nodes without links is not handed on (``dangling="drop"``), or shared by all nodes
    (``dangling="redistribute"``; then all scores sum to 1). What they hold is 1 less the scores of the nodes with links, a
    scalar subquery of the next round over the stored state, which never passes through the driver.

    Only nodes that have links hand score on. All rounds but the last therefore run on
    the edges between such nodes; link targets that were never crawled enter in the last
    round alone. Edges and nodes are stored in buckets by source, so a round shuffles
    only the partial sums per target.

    A source with very many links would fill one partition. All sources above
    ``hot_degree`` are split off: their edges stay spread out and meet their scores, which are at most one in
    ``hot_degree`` as many as edges, by broadcast if their size was checked. Tables made on the way are dropped at the end.
    """
    if dangling not in ("drop", "redistribute"):
        raise ValueError("dangling is 'drop' or 'redistribute'")
    made: list[str] = []
    try:
        return cut_lineage(_pagerank(nodes, edges, damping, iterations, checkpoint_every, hot_degree, dangling == "redistribute", made))
    finally:
        drop_tables(nodes.sparkSession, made)


class HotSources:
    """Edges cut by whether their source has more than ``hot_degree`` links; ``degrees`` is a stored table."""

    def __init__(self, degrees: DataFrame, hot_degree: int):
        hot = degrees.filter(F.col("links_out") > hot_degree)
        self.ids = None if hot.isEmpty() else cut_lineage(hot.select(F.col("id").alias("source_id")))
        # A row of a hot source is two numbers: if their ids are few, their rows are.
        self.few = self.ids is not None and small(self.ids)

    def sent(self, rows: DataFrame) -> DataFrame:
        """A side with a row or less per hot source, for a join with their edges."""
        return F.broadcast(rows) if self.few else rows

    def split(self, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Edges of all other sources, and those of the hot ones."""
        if self.ids is None:
            return edges, None
        return edges.join(self.sent(self.ids), "source_id", "left_anti"), edges.join(self.sent(self.ids), "source_id", "left_semi")


def _pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float, iterations: int, checkpoint_every: int, hot_degree: int, redistribute: bool,
    made: list[str],
) -> DataFrame:
    spark = nodes.sparkSession
    count = nodes.count()
    if count == 0:
        return nodes.select("id", F.lit(None).cast("double").alias("score"))
    base = (1.0 - damping) / count
    # Read three times: for the degrees, for the rounds, and for the last round.
    edges = cut_lineage(edges.select("source_id", "target_id"))
    degrees = cut_lineage(edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links_out")))
    n_edges = degrees.agg(F.coalesce(F.sum("links_out"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_edges // BUCKET_EDGES)
    sources = bucketed(degrees, "id", parts, made)
    hot = HotSources(degrees, hot_degree)

    def received(cold: DataFrame, spread: DataFrame | None, state: DataFrame) -> DataFrame:
        shares = state.select(F.col("id").alias("source_id"), (F.col("score") / F.col("links_out")).alias("share"))
        # Hashing the shares of a partition leaves its edges as they are stored, unsorted.
        sent = cold.join(shares.hint("shuffle_hash"), "source_id").select("target_id", "share")
        if spread is not None:
            hot_shares = hot.sent(shares.join(hot.ids, "source_id", "left_semi"))
            sent = sent.union(spread.join(hot_shares, "source_id").select("target_id", "share"))
        return sent.groupBy(F.col("target_id").alias("id")).agg(F.sum("share").alias("received"))

    def score(state: DataFrame) -> Column:
        handed = F.coalesce("received", F.lit(0.0))
        if redistribute:
            unsent = F.lit(1.0) - F.coalesce(state.agg(F.sum("score")).scalar(), F.lit(0.0))
            handed = handed + unsent / F.lit(float(count))
        return (F.lit(base) + F.lit(damping) * handed).alias("score")

    if iterations == 0:
        return nodes.select("id", F.lit(1.0 / count).alias("score"))
    state = sources.withColumn("score", F.lit(1.0 / count))
    if iterations > 1:
        # Both sides of this join are shuffled, so that a target of very many links is split.
        inner = edges.join(degrees.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        cold, spread = hot.split(inner.select("source_id", "target_id"))
        # By target, so that a round sums the shares of one target one after the other.
        cold = bucketed(cold, "source_id", parts, made, order="target_id")
        spread = None if spread is None else cut_lineage(spread)
        rounds = iterations
        if spread is None and not redistribute and cold.isEmpty():
            # No page links to another page that links on: from the first round on, nothing moves.
            state, rounds = sources.withColumn("score", F.lit(base)), 1
        for done in range(1, rounds):
            inbound = received(cold, spread, state)
            state = sources.join(inbound.hint("shuffle_hash"), "id", "left").select("id", "links_out", score(state))
            # The unsent score is read from the state beside the shares, so the state is a table then.
            if redistribute or done % checkpoint_every == 0 and done < rounds - 1:
                state = bucketed(state, "id", parts, made)
    last = received(*hot.split(edges), state)
    return nodes.select("id").join(last, "id", "left").select("id", score(state))


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_depth: int, hot_degree: int = HOT_DEGREE) -> DataFrame:
    """``(id, depth)`` of every node within ``max_depth`` links of the seeds, smallest depth.

    The edges are stored once in buckets by source. A level shuffles the nodes it starts from and those it finds, not the
    edges. Edges of sources with very many links stay spread out.
    """
    made: list[str] = []
    try:
        return _bfs_levels(edges, seeds, max_depth, hot_degree, made)
    finally:
        drop_tables(edges.sparkSession, made)


def _bfs_levels(edges: DataFrame, seeds: DataFrame, max_depth: int, hot_degree: int, made: list[str]) -> DataFrame:
    spark = edges.sparkSession
    pairs = cut_lineage(edges.select("source_id", "target_id"))
    degrees = cut_lineage(pairs.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links_out")))
    n_edges = degrees.agg(F.coalesce(F.sum("links_out"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_edges // BUCKET_EDGES)
    hot = HotSources(degrees, hot_degree)
    cold, spread = hot.split(pairs)
    cold = bucketed(cold, "source_id", parts, made)
    spread = None if spread is None else cut_lineage(spread)
    frontier = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for depth in range(1, max_depth + 1):
        reached = reached_from(frontier, cold, spread, hot).join(visited, "id", "left_anti")
        frontier = cut_lineage(reached.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited


def reached_from(frontier: DataFrame, cold: DataFrame, spread: DataFrame | None, hot: HotSources) -> DataFrame:
    """Distinct targets of the links of ``frontier``; the edges are not shuffled."""
    start = frontier.select(F.col("id").alias("source_id"))
    found = cold.join(start.hint("shuffle_hash"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    if spread is not None:
        some = hot.sent(start.join(hot.ids, "source_id", "left_semi"))
        found = found.union(spread.join(some, "source_id", "left_semi").select(F.col("target_id").alias("id")))
    return found.distinct()
