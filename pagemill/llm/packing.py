"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces are placed longest first; among the open bins that hold a piece under every constraint, the one is
chosen whose residual vector scores best, by ``norm`` (smallest weighted norm of what would be left) or ``dot``
(largest weighted dot product of need and residual). A piece that none holds opens a bin.

Whole-bin pieces are bins of their own. All others are dealt by a hash to groups of about
``group_pieces``, packed side by side; each group wastes at most about one bin, so the loss is below one
in a thousand bins and shrinks with the group size. Groups are hashes of id and place, so neither a hot source nor a group of copies gathers in one task.

Defined results: a null or empty text is one piece of the end token. A piece longer than the token capacity is an error, as is
one whose square exceeds the attention capacity. Ties go to the fuller bin, then the older. Repeated rows are packed each. An
empty table gives no rows. Extra columns are ignored by ``pack_documents``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts above this many characters are encoded in parts, cut where the tokenizer cuts as well.
PART_CHARS = 500_000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
             score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` in any order."""
    size = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weight = np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left = np.empty((max(16, len(lengths)), 3))  # residual of open bins, closed ones are moved out
    number = np.empty(len(left), dtype=np.int64)
    n_open = n_bins = 0
    for i in order:
        length = int(lengths[i])
        need = np.array([length, 1, length * length], dtype=float)
        if (need > size).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        chosen = -1
        if n_open:
            fits = np.flatnonzero((left[:n_open] >= need).all(axis=1))
            if len(fits):
                after = (left[fits] - need) / size
                if score == "norm":
                    chosen = fits[np.argmin(((after * weight) ** 2).sum(axis=1))]
                else:
                    chosen = fits[np.argmax(((left[fits] / size) * (need / size) * weight).sum(axis=1))]
        if chosen < 0:
            chosen, n_open = n_open, n_open + 1
            left[chosen], number[chosen] = size, n_bins
            n_bins += 1
        bins[i], offsets[i] = number[chosen], capacity.tokens - int(left[chosen, 0])
        left[chosen] -= need
        if left[chosen].min() < 1:
            n_open -= 1
            left[chosen:n_open], number[chosen:n_open] = left[chosen + 1:n_open + 1].copy(), number[chosen + 1:n_open + 1].copy()
    return bins, offsets


class Encoder:
    """Ids of a text by a public byte-level vocabulary.

    ``ranks_path`` (the vocabulary as ranks) is the fast way to the ids of ``vocabulary_path``; texts that
    spell a special token go through the vocabulary file itself.
    """

    def __init__(self, vocabulary_path: str, ranks_path: str | None, pattern: str | None):
        self.paths, self.special = (vocabulary_path, ranks_path, pattern), "<|endoftext|>"
        self.whole = self.fast = None

    def _slow(self):
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.paths[0])
        return self.whole

    def _ranks(self):
        if self.fast is None:
            import base64

            import tiktoken

            with open(self.paths[1], "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.paths[2], mergeable_ranks=ranks, special_tokens={})
        return self.fast

    def ids(self, text: str) -> list[int]:
        if self.paths[1] is None or self.special in text:
            return self._slow().encode(text, add_special_tokens=False).ids
        if len(text) <= PART_CHARS:
            return self._ranks().encode_ordinary(text)
        out: list[int] = []
        for part in parts(text):
            out += self._ranks().encode_ordinary(part)
        return out


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text cut before single spaces that stand between other characters, where no token reaches across."""
    at, cut = 0, re.compile(r"(?<=\S)(?= \S)")
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def pieces_of(ids: list[int], capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and ids of each piece; only the first may be shorter."""
    array = np.array(ids, dtype="<u4")
    first = len(array) % capacity or min(len(array), capacity)
    yield 0, array[:first]
    for start in range(first, len(array), capacity):
        yield start, array[start:start + capacity]


def tokenized(df: DataFrame, encoder: Encoder, *, text: str = "text", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """A row per piece (``PIECES``) with ``row``, the hash that tells documents of one id apart."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, out = batch["doc_id"], batch["row"], []
            for doc, key, content in zip(ids, keys, batch["content"]):
                for n, (start, piece) in enumerate(pieces_of([*encoder.ids(content or ""), end_id], capacity)):
                    out.append((doc, n, start, len(piece), zlib.crc32(piece.tobytes()), key))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("content"),
        F.xxhash64("doc_id", F.col(f"`{text}`")).alias("row"),
    )
    return rows.mapInPandas(encode, f"{PIECES}, row long")


def assign(pieces: DataFrame, capacity: Capacity, *, group_pieces: int = 8192, **options) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the table is read twice and should be a stored one."""
    columns = list(pieces.columns)
    n = pieces.filter(F.col("length") < capacity.tokens).count()
    groups = max(1, -(-n // group_pieces))
    # Copies of one document have one hash; the row's number in its partition deals them out.
    numbered = pieces.withColumn("tie", F.monotonically_increasing_id())
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("row", "piece", "tie"), F.lit(groups)))
    full = dealt.filter(F.col("length") == capacity.tokens).select(
        *columns, F.xxhash64("row", "piece", "tie").alias("unused"), "tie"
    )
    # Even numbers are full pieces, odd ones are bins of groups.
    full = full.select(*columns, (F.col("tie") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece", "tie"], kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, **options)
        base = frame["group"].iloc[0] if len(frame) else 0
        out = frame[columns].copy()
        out["sequence_id"], out["offset"] = (bins * groups + base) * 2 + 1, offsets
        return out

    packed = dealt.filter(F.col("length") < capacity.tokens).groupBy("group").applyInPandas(
        pack, f"{kinds}, sequence_id long, offset long"
    )
    return full.unionByName(packed)


def pack_documents(df: DataFrame, encoder: Encoder, *, text: str = "text", end_id: int = 2,
                   capacity: Capacity = Capacity(), **options) -> DataFrame:
    """Pieces of every document with their sequence and their place in it."""
    pieces = stored(tokenized(df, encoder, text=text, end_id=end_id, capacity=capacity.tokens), "pieces")
    return assign(pieces, capacity, **options)
