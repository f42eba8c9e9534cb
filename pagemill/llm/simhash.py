"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most
two bits, one segment differs in at most one bit. Every fingerprint is indexed under its segments and
under the variants of a segment with one bit as a wildcard; equal keys make candidates, and the bit
distance of each candidate is then verified. Segments that agree, or differ at the wildcard, leave
at most two bits (one bit) for the other segment, so one of its three (two) parts is unchanged and joins the key. That
keeps the candidates of a crowded segment few without losing a link. Two sides that differ at the
wildcard are joined bit 0 to bit 1, so no pair is found at every place. The work is on distinct
fingerprints: any number of copies is one row.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Texts of fewer
words than a shingle are one shingle. Rows of a null id take part; a component that has only null ids has a null id.
Repeated rows share fingerprint and component. Extra columns are ignored by ``grouped`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, text_key
from pagemill.llm.graph import components

BITS, MAX_BITS = 64, 2


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text; counts bytes of the hashes, 65,536 shingles at a time."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    joined = map(b" ".join, zip(*runs))
    total, counts = max(1, len(words) - shingle + 1), np.zeros((8, 256), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, 65_536):
        size = min(65_536, total - start)
        hashes = np.fromiter((digest(next(joined), 42) for _ in range(size)), dtype="<u8", count=size)
        for place, column in enumerate(hashes.view(np.uint8).reshape(size, 8).T):
            counts[place] += np.bincount(column, minlength=256)
    # How often each bit of each byte is set.
    table = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = (counts @ table).reshape(64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Column of signed 64-bit fingerprints."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(x, shingle) for x in batch], dtype="int64")

    return compute(text)


def _keys() -> Column:
    """Index entries of a fingerprint ``f``: key and ``bit``, which is null where nothing is a wildcard."""
    high, low = F.shiftrightunsigned("f", 32), F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))

    def part(value: Column, at: int, width: int) -> Column:
        return F.shiftright(value, at).bitwiseAND(F.lit((1 << width) - 1))

    plain = [
        F.struct(F.xxhash64(F.lit(s * 8 + at), own, part(other, at, width)).alias("key"), F.lit(None).cast("int").alias("bit"))
        for s, own, other in ((0, low, high), (1, high, low)) for at, width in ((0, 11), (11, 11), (22, 10))
    ]
    wild = [
        F.struct(
            F.xxhash64(F.lit(100 + place * 2 + half), low.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << place))), part(high, 16 * half, 16)).alias("key"),
            part(low, place, 1).cast("int").alias("bit"),
        )
        for place in range(32) for half in range(2)
    ]
    return F.array(*plain, *wild)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints ``f`` that differ in 1 to ``max_bits`` (at most 2) bits."""
    if max_bits > MAX_BITS:
        raise ValueError("two segments with one wildcard find up to two bits")
    # A few bytes become seventy entries: spread before, not by the size of what comes in. Spark would take a
    # repartitioning by "f" itself for done, and join its few bytes to few tasks.
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("f"))
    index = spread.select("f", F.explode(_keys()).alias("x")).select("f", "x.key", "x.bit")
    # With a wildcard: 0 against 1. Without: each with each other, the smaller on the left.
    left = index.filter("bit is null or bit = 0").select(F.col("f").alias("a"), "key", F.col("bit").alias("bit_a"))
    right = index.filter("bit is null or bit = 1").select(F.col("f").alias("b"), F.col("key"), F.col("bit").alias("bit_b"))
    # Merge join: Spark takes the entries for as few bytes as the fingerprints they are made of, and would send them to all tasks.
    pairs = left.hint("merge").join(right.hint("merge"), "key").filter(
        (F.col("bit_a").isNull() == F.col("bit_b").isNull())
        & (F.col("bit_a").isNotNull() | (F.col("a") < F.col("b")))
        & F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits)
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(df: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``f`` (signed fingerprint) and ``component_id`` (smallest doc_id reachable) of every row."""
    marked = stored(df.select("doc_id", text_key(F.col(text)).alias("text_key"), fingerprint(F.col(text), shingle).alias("f")), "prints")
    classes = marked.groupBy("f").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(classes.select("f"), max_bits)).withColumnRenamed("node", "f")
    rooted = classes.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("f", "component_id"), "f")


def keep_one(df: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, text: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the smallest doc_id, then the smallest hash of the text."""
    groups = grouped(df, shingle, max_bits, text)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    # A component without any id is one component per fingerprint at least; it keeps a row as well.
    chosen = groups.groupBy(F.coalesce("component_id", "f"), F.col("component_id").isNull()).agg(F.min(first).alias("row")).select(
        F.col("row.none").alias("none"), F.coalesce("row.doc_id", F.lit(0)).alias("id"), F.col("row.text_key").alias("key")
    )
    # Texts are shuffled once: equal rows are dropped where the join has put them.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), text_key(F.col(text)).alias("key"),
    )
    keys = ["none", "id", "key"]
    return rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select("doc.*")
