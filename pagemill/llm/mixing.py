"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. ``targets``: how many words each source gives; water-filling with a limit of ``max_repeats`` times its size.
2. Every source is put into one permuted order (a hash of the document) and read in rounds, so that a
   target of 2.4 times a source is two whole rounds and the first 0.4 of a third. Places in that
   order are sums of sizes: per hash bucket first, then inside a bucket, so no source is held by one task.
3. The order is cut into blocks of ``block_words``; a source's block quota is exact.
4. A binary tree over the output shards splits the vector of quotas at each node: the left half's blocks are
   drawn from the node's sources without replacement (multivariate hypergeometric). A shard finds its own
   leaf by walking down from the root with seeded draws, so shards agree without any exchange, and its
   blocks are a range of each source's permuted blocks: disjoint, and together the whole quota.
5. Rows are shuffled inside their shard by a hash.

Defined results: a null or empty text has size 0 and is never taken. A null source is a source of its
own, the last one. Repeated rows, and rows that share an id, are documents each; equal rows are
ordered after one another. Documents that straddle the end of a target are taken if more than half lies before it. An
empty table gives an empty result. Extra columns, also of maps, are carried along in a struct, so none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import WORD, stored
from pagemill.operators.sizing import BROADCAST_ROWS

#: More sources than this are an error: their quotas are sent to every task.
MAX_SOURCES = 100_000
#: Above this numpy draws no hypergeometric numbers.
LARGE = 10**9
#: What tells a row from all others that differ.
KEY = ["h", "h2"]
#: Hex digits of the hash that make a bucket inside a source.
BUCKET_DIGITS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], max_repeats: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (``source``, ``source_size``).

    Sources in code-point order, null last, get ``weights`` in turn. With a level L a source gives
    min(max_repeats * size, L * weight); L makes them sum to the whole size, and is the largest level at which
    the sources that it should not fill are not filled. Sources are a few rows, so one task orders them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("at", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return ranked.select("source", "source_size", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def _keyed(df: DataFrame, seed: int) -> list[Column]:
    """Key of a row: ``h`` orders by id, ``h2`` is a hash of all columns. Equal rows have equal keys."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))

    def hashable(name: str, kind: str) -> Column:
        # Spark hashes no maps; a column that holds one counts by its JSON.
        column = F.col(f"`{name}`")
        return F.to_json(F.struct(column)) if re.search(r"\b(map|variant)\b", kind) else column

    return [h.alias("h"), F.xxhash64(*[hashable(*c) for c in df.dtypes]).alias("h2")]


def rows_of(df: DataFrame, keep: list[str], *, text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """A stored table with ``doc`` (the columns ``keep``), ``row`` (a number of its own), ``source``, ``size`` and the key.

    All steps work on its short columns; a caller that keeps no texts here meets them again by the key.
    """
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{source}`").alias("source"),
        words_in(F.col(f"`{text}`")).alias("size"), *_keyed(df, seed), F.monotonically_increasing_id().alias("row"),
    )
    return stored(rows, "sizes")


def placed(rows: DataFrame, weights: list[float], max_repeats: int = 3) -> DataFrame:
    """``row``, ``source``, ``size``, ``source_size``, ``target``, ``start`` and ``repeats`` of every row of ``rows_of``.

    ``start`` is the row's place, in words, in its source's permuted order; ``repeats`` is how often the mix takes it.
    """
    rows = rows.select("row", "source", "size", "h", "h2").withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    of_source = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = buckets.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    shifts = shifts.alias("b").join(of_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        F.col("b.source").alias("shift_source"), F.col("b.bucket").alias("shift_bucket"), "shift", "source_size", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("h", "h2", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = numbered.join(
        shifts, F.col("source").eqNullSafe(F.col("shift_source")) & (F.col("bucket") == F.col("shift_bucket"))
    ).withColumn("start", F.col("shift") + F.col("within"))
    left = F.col("target") - F.col("start") - F.col("size") / 2
    repeats = F.when(F.col("size") > 0, F.least(
        F.lit(max_repeats), F.greatest(F.lit(0), (F.floor(left / F.col("source_size")) + 1).cast("int"))
    )).otherwise(F.lit(0))
    return out.select("row", "source", "size", "source_size", "target", "start", repeats.alias("repeats"), "h", "h2")


def leaf(quotas: list[int], shards: int, shard: int, seed: int) -> list[tuple[int, int]]:
    """First block and number of blocks of each source in one shard: a walk down the splitting tree."""
    import numpy as np

    left_at, counts = np.zeros(len(quotas), dtype=np.int64), np.array(quotas, dtype=np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        want = int(counts.sum()) * (middle - low) // (high - low)
        left = draw(rng, counts, want)
        if shard < middle:
            counts, high = left, middle
        else:
            left_at, counts, low = left_at + left, counts - left, middle
    return list(zip(left_at.tolist(), counts.tolist()))


def hypergeometric(rng, good: int, bad: int, want: int) -> int:
    """How many of ``want`` draws without replacement are good; exact at any size.

    Of large urns every block is taken alone with one chance, until as many as wanted are taken: given their number, that is
    the same law. The number of trials grows with the root of the blocks, about 90,000 for five billion.
    """
    import numpy as np

    if max(good, bad) < LARGE:
        return int(rng.hypergeometric(good, bad, want))
    chance = want / (good + bad)
    while True:
        taken = rng.binomial(good, chance, size=1 << 18)
        hit = np.flatnonzero(taken + rng.binomial(bad, chance, size=1 << 18) == want)
        if len(hit):
            return int(taken[hit[0]])


def draw(rng, counts, want: int):
    """One multivariate hypergeometric draw of ``want`` blocks, source by source."""
    import numpy as np

    out, total = np.zeros_like(counts), int(counts.sum())
    for place, good in enumerate(counts.tolist()):
        total -= good
        if want == 0:
            break
        if good == 0:
            continue
        out[place] = take = want if total == 0 else hypergeometric(rng, good, total, want)
        want -= take
    return out


def mix(df: DataFrame, weights: list[float], *, text: str = "text", source: str = "source", max_repeats: int = 3,
        block_words: int = 20_000, shard_words: int = 2_000_000, seed: int = 0) -> DataFrame:
    """A row per taken copy: ``doc``, ``size``, ``copy`` (from 0), ``shard`` and ``place`` (order by it inside a shard)."""
    rows = rows_of(df, ["doc_id"], text=text, source=source, seed=seed)
    taken = stored(placed(rows, weights, max_repeats), "mix")
    copies = dealt(taken, block_words=block_words, shard_words=shard_words, seed=seed)
    # Equal rows are one here; the copies of each of them find it.
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *_keyed(df, seed)).dropDuplicates(KEY)
    return copies.join(rows.select("row", *KEY), "row").join(whole, KEY).select("doc", "size", "copy", "shard", "place")


def dealt(taken: DataFrame, *, block_words: int, shard_words: int, seed: int = 0) -> DataFrame:
    """The copies that ``placed`` takes: ``row``, ``size``, ``copy``, ``shard``, ``place``, dealt by the splitting tree."""
    spark = taken.sparkSession
    copies = taken.filter("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    copies = copies.withColumn(
        "block", F.floor((F.col("copy") * F.col("source_size") + F.col("start")) / block_words).cast("long")
    )
    last = copies.groupBy("source").agg((F.max("block") + 1).alias("quota"))
    rows = last.orderBy(F.col("source").isNull(), "source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names, quotas = [r["source"] for r in rows], [int(r["quota"]) for r in rows]
    shards = max(1, -(-sum(quotas) * block_words // shard_words))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                found = leaf(quotas, shards, int(shard), seed)
                yield pd.DataFrame(
                    [(names[k], at, n, int(shard)) for k, (at, n) in enumerate(found) if n],
                    columns=["source", "first", "n", "shard"],
                ).astype({"first": "int64", "n": "int64", "shard": "int64"})

    ranges = spark.range(shards).mapInPandas(leaves, "source string, first long, n long, shard long")
    blocks = ranges.select(
        F.col("source").alias("of"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("of_block")
    )
    order = F.xxhash64("h", "h2", "copy", F.lit(seed))
    # A few ranges become a row per block, which Spark does not see when it sizes the side; their number is known.
    blocks = F.broadcast(blocks) if sum(quotas) <= BROADCAST_ROWS else blocks.hint("merge")
    joined = copies.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    return joined.select("row", "size", "copy", "shard", order.alias("place"))


def mixed_rows(df: DataFrame, weights: list[float], **options) -> DataFrame:
    """The mix with ``df``'s columns, a row per copy, in shards that are shuffled inside."""
    rows = mix(df, weights, **options)
    return rows.repartition("shard").sortWithinPartitions("shard", "place").select("doc.*")
