"""Duplicate passages by FM-indexes of content shards.

A window is ``width`` neighbouring words. Each window is anchored at its smallest ``GRAM``-word hash; equal windows have
equal anchors, so neighbouring windows of one anchor travel as one segment and meet their duplicates
in the shard of the anchor, whatever document they are in. Per shard, the different segments
become one sequence with a compressed FM-index: the Burrows-Wheeler transform in a wavelet matrix of packed bits with
block ranks. The shard's segments are streamed through it by backward search, all windows
in step, which gives the matching statistics: for each window's end the longest match that occurs
again, up to the window's width. Intervals of full matches give the smallest document of a window.

What keeps it in proportion:
* Equal texts are one class, of which the smallest document alone is searched; the others are removed whole.
* Anchors that occur in one class only cannot hold a duplicate and are dropped before any text moves.
* Equal segments are one row with their smallest document, combined before the shuffle.
* An anchor of more than ``HOT`` places (a stock phrase in many contexts) is cut into single windows that are dealt by their
  own hash, so no shard grows with it.

Defined results: a null or empty text has no words and keeps none. A null doc_id neither removes words nor loses any. Repeated rows
(same id and text) get the same result; words repeated inside one document stay. Extra columns are ignored by ``deduplicated``.
Words are compared by XXH64 of their bytes, 13 in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

WIDTH, GRAM, HOT = 13, 4, 4096
#: Words of one shard, about.
SHARD_WORDS = 400_000
PLACE = "doc_id long, k1 long, k2 long, start int, n int"


#: Bytes of texts that are hashed together.
CHUNK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: bytes) -> np.ndarray:
    """XXH64 of every word's bytes; a long text is split a chunk at a time."""
    parts, at, digest = [], 0, xxhash.xxh64_intdigest
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK) if at + CHUNK < len(data) else None
        stop = gap.start() if gap else len(data)
        words = data[at:stop].split()
        parts.append(np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, the text of each word, and the first word of each text."""
    found = [_word_hashes(x.encode()) for x in texts]
    counts = np.array([len(x) for x in found], dtype=np.int64)
    ids = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    return ids, np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts


def chunks(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    total = np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + ids[k: len(total) + k]
    return _mixed(total)


def segments(ids: np.ndarray, of: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of every segment of texts; no window reaches over two texts."""
    n_windows = len(ids) - width + 1
    if n_windows <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    marks, reach = _grams(ids, gram), width - gram + 1
    # The hash's upper bits with the place in the lower ones: a minimum is an anchor with its place.
    mask = np.uint64((1 << 20) - 1)
    least, size = (marks & ~mask) | (np.arange(len(marks), dtype=np.uint64) & mask), 1
    while 2 * size <= reach:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(least) - (reach - size)], least[reach - size:])
    at = np.arange(n_windows)
    anchor = at + (((least & mask).astype(np.int64) - at) & int(mask))
    whole = of[:n_windows] == of[width - 1:]
    same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & whole[:-1] & (of[1:n_windows] == of[: n_windows - 1])])
    begins = whole & ~same
    starts, stops = np.flatnonzero(begins), np.append(np.flatnonzero(begins | ~whole), n_windows)
    return starts, stops[np.searchsorted(stops, starts, side="right")] - starts, marks[anchor[starts]].view(np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence: a packed bit row for each bit of the alphabet, with a count before each block of 64."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels, current = [], symbols
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((current >> shift) & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bits)] = bits
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            self.levels.append((shift, blocks, before, len(bits) - int(bits.sum())))
            current = np.concatenate([current[bits == 0], current[bits == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``low`` and before ``high``."""
        base = np.zeros_like(low)
        for shift, blocks, before, zeros in self.levels:
            bit = ((symbol >> shift) & 1).astype(bool)

            def ones(at: np.ndarray) -> np.ndarray:
                block = at >> 6
                mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
                return before[block] + np.bitwise_count(blocks[block] & mask).astype(np.int64)

            base, low, high = (np.where(bit, zeros + o, at - o) for at, o in ((x, ones(x)) for x in (base, low, high)))
        return low - base, high - base


class FMIndex:
    """FM-index of segments of word numbers (from 1; 0 ends a segment), for patterns up to ``depth`` words."""

    def __init__(self, sequence: np.ndarray, depth: int = 16):
        n = len(sequence)
        ranks, step = sequence.astype(np.int64), 1
        while step < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - step)] = ranks[step:]
            _, ranks = np.unique(ranks * (int(ranks.max(initial=0)) + 1) + after, return_inverse=True)
            step *= 2
        self.suffixes = np.argsort(ranks, kind="stable")
        symbols = int(sequence.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.transform = WaveletMatrix(sequence[self.suffixes - 1], symbols)

    def statistics(self, sequence: np.ndarray, ends: np.ndarray, width: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For patterns that end at ``ends`` of ``sequence``: the longest suffix, up to ``width`` words, that occurs ``least`` times, and its interval."""
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(self.suffixes), dtype=np.int64)
        length, active = np.zeros(len(ends), dtype=np.int64), np.arange(len(ends))
        for step in range(width):
            symbol = sequence[ends[active] - step]
            a, b = self.transform.rank(symbol, low[active], high[active])
            a, b = a + self.first[symbol], b + self.first[symbol]
            more = b - a >= least
            active = active[more]
            low[active], high[active], length[active] = a[more], b[more], step + 1
        return length, low, high


def smallest_documents(contents: list[bytes], owners: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each segment of a shard, the smallest document that has each of its windows."""
    parts = [np.frombuffer(c, dtype="<i8") for c in contents]
    sizes = np.array([len(p) for p in parts])
    _, numbers = np.unique(np.concatenate(parts), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    sequence, of = np.zeros(starts[-1], dtype=np.int64), np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.ones(len(sequence), dtype=bool)
    inside[starts[1:] - 1] = False
    sequence[inside] = numbers + 1
    index = FMIndex(sequence, depth=max(16, width))
    windows = sizes - width + 1
    shift = np.concatenate([[0], np.cumsum(windows)])
    ends = np.repeat(starts[:-1] - shift[:-1], windows) + np.arange(shift[-1]) + width - 1
    length, low, high = index.statistics(sequence, ends, width)
    found = np.repeat(owners, windows)
    full = np.flatnonzero(length == width)
    if len(full):
        # Intervals of patterns of one length are equal or apart.
        left, at = np.unique(low[full], return_inverse=True)
        right = np.zeros(len(left), dtype=np.int64)
        right[at] = high[full]
        by_suffix = np.append(owners[of[index.suffixes]], owners.max())
        least = np.minimum.reduceat(by_suffix, np.stack([left, right], axis=1).ravel())[::2]
        found[full] = least[at]
    return np.split(found, shift[1:-1])


def _rows(df: DataFrame, text: str) -> DataFrame:
    """``doc_id``, ``text`` and its hashes ``k1`` and ``k2``: equal texts are a class."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("k1"),
        F.xxhash64(F.lit(7), content).alias("k2"),
    )


def _places(rows: DataFrame, width: int) -> DataFrame:
    """Segments of every text: class ``k1``, ``start`` and ``anchor``."""

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = batch["text"], batch["k1"].to_numpy()
            for a, b in chunks(texts):
                ids, of, first = hashed_words(list(texts[a:b]))
                start, _, anchor = segments(ids, of, width)
                own = of[start]
                yield pd.DataFrame({"k1": keys[a:b][own], "start": start - first[own], "anchor": anchor})

    return rows.select("text", "k1").mapInPandas(anchored, "k1 long, start int, anchor long")


def _pieces(chosen: DataFrame, width: int) -> DataFrame:
    """The live segments (``parts``: twice the start, one more if hot) of the chosen texts with their words.

    Those of hot anchors come as single windows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = {c: batch[c].to_numpy() for c in ("doc_id", "k1", "k2")}
            for a, b in chunks(batch["text"]):
                ids, of, first = hashed_words(list(batch["text"][a:b]))
                starts, sizes, anchors = segments(ids, of, width)
                if not len(starts):
                    continue
                parts = list(batch["parts"][a:b])
                text = np.repeat(np.arange(b - a), [len(p) for p in parts])
                part = np.concatenate(parts).astype(np.int64)
                wanted = (part >> 1) + first[text]
                place = np.minimum(np.searchsorted(starts, wanted), len(starts) - 1)
                # A part that is no segment here is of another text with the same first hash.
                right = (starts[place] == wanted) & (of[np.minimum(wanted, len(of) - 1)] == text)
                wanted, place, hot = wanted[right], place[right], (part[right] & 1).astype(bool)
                single = np.repeat(np.arange(len(wanted))[hot], sizes[place[hot]])
                within = np.arange(len(single)) - np.repeat(np.cumsum(sizes[place[hot]]) - sizes[place[hot]], sizes[place[hot]])
                at = np.concatenate([wanted[~hot], wanted[single] + within])
                n = np.concatenate([sizes[place[~hot]], np.ones(len(single), dtype=np.int64)])
                shard_key = np.concatenate([anchors[place[~hot]], _grams(ids, width).view(np.int64)[wanted[single] + within]])
                data, row = ids.tobytes(), of[at]
                yield pd.DataFrame({
                    **{c: x[a:b][row] for c, x in keys.items()}, "start": at - first[row], "n": n, "shard_key": shard_key,
                    "content": [data[8 * s: 8 * (s + k + width - 1)] for s, k in zip(at.tolist(), n.tolist())],
                })

    return chosen.mapInPandas(cut, f"{PLACE}, shard_key long, content binary")


def _smallest(distinct: DataFrame, width: int) -> DataFrame:
    """``least_docs``, the smallest document of each window, of the segments that it matters for, by an index per shard."""
    words = distinct.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, words // 8 // SHARD_WORDS)

    def indexed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["shard_key", "content"], ignore_index=True)
        found = smallest_documents(list(frame["content"]), frame["least"].to_numpy(), width)
        # Segments of one document whose windows are nowhere earlier change nothing.
        keep = [i for i, (f, a, b) in enumerate(zip(found, frame["least"], frame["most"])) if a < b or (f < a).any()]
        return pd.DataFrame({
            "shard_key": frame["shard_key"].iloc[keep].to_numpy(), "segment": frame["segment"].iloc[keep].to_numpy(),
            "least_docs": pd.Series([found[i] for i in keep], dtype=object),
        })

    sharded = distinct.withColumn("segment", F.xxhash64("content")).withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(indexed, "shard_key long, segment long, least_docs array<long>")


def removable(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """A row per class of equal texts: ``k1``, ``k2``, ``head`` (its smallest document) and ``starts``.

    ``starts`` are the first words of the head's windows that also start in a smaller document; null if there is
    none. All windows of the other documents of a class start in its head. Each step is a stored table, so that its
    shuffle files do not outlive it.
    """
    rows = _rows(df, text).filter("doc_id is not null")
    heads = stored(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("head")), "heads")
    places = stored(_places(rows, width), "anchors")
    shared = stored(places.groupBy("anchor").agg(
        F.min("k1").alias("least"), F.max("k1").alias("most"), (F.count("*") > HOT).alias("hot")
    ).filter("least < most").select("anchor", "hot"), "shared")
    live = stored(places.join(shared, "anchor").groupBy("k1").agg(
        F.collect_set(2 * F.col("start") + F.col("hot").cast("int")).alias("parts")
    ), "live")
    wanted = heads.join(live, "k1").withColumnRenamed("head", "doc_id")
    pieces = stored(_pieces(rows.join(wanted, ["k1", "k2", "doc_id"]), width), "segments")
    distinct = stored(pieces.groupBy("shard_key", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "distinct")
    least = stored(_smallest(distinct, width), "least")
    spots = pieces.select("doc_id", "k1", "k2", "start", "n", "shard_key", F.xxhash64("content").alias("segment"))
    hit = spots.join(least, ["shard_key", "segment"])
    covered = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get("least_docs", j) < F.col("doc_id"))
    starts = hit.select("k1", "k2", F.transform(covered, lambda j: F.col("start") + j).alias("starts")).filter(
        F.size("starts") > 0
    ).groupBy("k1", "k2").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return stored(heads.join(starts, ["k1", "k2"], "left"), "removable")


def covered_words(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words the windows cover."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def deduplicated(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the remaining words, joined by a space) of every document."""
    joined = _rows(df, text).join(removable(df, text, width), ["k1", "k2"], "left")
    is_copy = F.coalesce(F.col("head") < F.col("doc_id"), F.lit(False))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, copies in batches:
            out = []
            for content, at, copy in zip(texts, starts, copies):
                words = content.encode().split()
                n = len(words)
                if copy and n >= width:
                    words = []
                elif at is not None:
                    gone = covered_words(n, np.asarray(at, dtype=np.int64), width)
                    words = [w for w, g in zip(words, gone) if not g]
                out.append((n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    # A document without an id loses nothing.
    own = F.when(F.col("doc_id").isNotNull(), F.col("starts"))
    return joined.select("doc_id", kept("text", own, is_copy).alias("x")).select("doc_id", "x.n_words", "x.n_removed", "x.kept")
