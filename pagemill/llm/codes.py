"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry, found by a GNAT.

* Vectors are whole numbers, cut into equal consecutive parts. Each place has a codebook of its own.
* ``Gnat`` is a geometric near-neighbour access tree over the entries of one codebook: a node has split points, every other entry
  lies below its nearest split point, and the node holds the range of distances from each split point to the entries below
  each other one. A query at distance ``d`` of a split point with a best distance ``r`` so far rules out a whole subtree when
  [d - r, d + r] does not meet that range.
* Ranges and distances are rounded outwards and the test is strict, so an entry as near as the best is never ruled out. Entries are
  compared by squared distances in whole numbers, ties to the lower number.
* All parts of a batch go through a tree together, node by node. A round shuffles one row of sums per task and entry; vectors never move.

The driver holds codebooks alone: entries x width numbers, whatever the table.

Defined results: null and empty vectors, vectors with null or non-finite components, and vectors whose length is not the most
frequent one (the smaller of two as frequent) of those that can be cut into equal parts take no part. Rows of a null id take part;
their vectors start a codebook after all others. Repeated rows count as often as they come; vectors of one id start in the order of
their components. With fewer vectors than entries there are as many entries. An empty table gives no rows. A component
that no 64-bit distance can hold is an error. Columns other than key, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.vectors import finite, lists, matrix, scaled, slices

#: Relative widening of a distance, far above the rounding of a square root of a 64-bit number.
WIDEN = 1e-12


@dataclass
class Node:
    """Split points, their subtrees, and the ranges of distances from split point (row) to subtree (column)."""

    splits: np.ndarray
    children: list["Node | None"]
    low: np.ndarray
    high: np.ndarray


class Gnat:
    """Exact nearest entries of a codebook of whole numbers."""

    def __init__(self, entries: np.ndarray, fanout: int = 8):
        self.entries, self.fanout = entries.astype(np.int64), fanout
        self.root = self._grow(np.arange(len(entries)))

    def _squares(self, points: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), len(numbers)), dtype=np.int64)
        for j in range(points.shape[1]):
            out += (points[:, j, None] - self.entries[numbers, j]) ** 2
        return out

    def _grow(self, members: np.ndarray) -> Node | None:
        if not len(members):
            return None
        # Split points: the lowest number, then the entry farthest from all that are chosen.
        chosen, far = [0], self._squares(self.entries[members], members[:1])[:, 0]
        while len(chosen) < min(self.fanout, len(members)):
            far[chosen] = -1
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._squares(self.entries[members], members[chosen[-1:]])[:, 0])
        splits = members[chosen]
        others = np.delete(members, chosen)
        squares = self._squares(self.entries[others], splits)
        home = squares.argmin(axis=1) if len(others) else np.zeros(0, dtype=np.int64)
        roots = np.sqrt(squares.astype(np.float64))
        low, high = np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf)
        for child in np.unique(home):
            low[:, child] = roots[home == child].min(axis=0) * (1 - WIDEN)
            high[:, child] = roots[home == child].max(axis=0) * (1 + WIDEN)
        return Node(splits, [self._grow(others[home == c]) for c in range(len(splits))], low, high)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest entry and squared distance of every point; and how many distances were computed."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        number = np.full(len(points), len(self.entries))
        count = self._search(self.root, points.astype(np.int64), np.arange(len(points)), best, number) if len(points) else 0
        return number, best, count

    def _search(self, node: Node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> int:
        squares = self._squares(points[rows], node.splits)
        # Of split points at one distance the lowest number counts.
        order = np.argsort(node.splits)
        near = order[squares[:, order].argmin(axis=1)]
        least = squares[np.arange(len(rows)), near]
        nearer = (least < best[rows]) | ((least == best[rows]) & (node.splits[near] < number[rows]))
        best[rows[nearer]], number[rows[nearer]] = least[nearer], node.splits[near[nearer]]
        count, roots = squares.size, np.sqrt(squares.astype(np.float64))
        # Below its nearest split point first: that shrinks the reach for all others.
        for own in (True, False):
            for place, child in enumerate(node.children):
                if child is None:
                    continue
                at = np.flatnonzero((near == place) == own)
                reach = np.sqrt(best[rows[at]].astype(np.float64))[:, None] * (1 + WIDEN)
                out = (roots[at] * (1 - WIDEN) - reach > node.high[:, place]) | (roots[at] * (1 + WIDEN) + reach < node.low[:, place])
                at = at[~out.any(axis=1)]
                if len(at):
                    count += self._search(child, points, rows[at], best, number)
        return count


def prepared(df: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """``vec_id``, ``label`` and ``v`` (whole numbers) of the rows that take part, and their length."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0) & finite(F.col("v")))
    rows = stored(rows.withColumn("v", scaled(F.col("v"), scale)), "whole")
    first = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = first["width"] if first else parts
    return rows.filter(F.size("v") == width), width


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (place, entry, component) after one round: floors of the means of their parts; an entry without any stays."""
    parts, entries, size = books.shape
    trees = [Gnat(book) for book in books]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, size + 1), dtype=np.int64)
        for batch in slices(batches, parts * size):
            v = matrix(batch, "v", parts * size).astype(np.int64).reshape(-1, parts, size)
            ones = np.ones((len(v), 1), dtype=np.int64)
            for place, tree in enumerate(trees):
                np.add.at(total[place], tree.nearest(v[:, place])[0], np.hstack([v[:, place], ones]))
        held = np.flatnonzero(total[:, :, -1].ravel())
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), lists(total.reshape(-1, size + 1)[held])], ["entry", "sums"])

    found = rows.select("v").mapInArrow(sums, "entry long, sums array<long>").select("entry", F.posexplode("sums"))
    found = found.groupBy("entry", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")))
    total: dict[int, dict[int, int]] = {}
    for entry, place, value in found.collect():  # entries x (width + parts) rows
        total.setdefault(entry, {})[place] = int(value)
    out = books.reshape(-1, size).copy()
    for entry, values in total.items():
        out[entry] = [values[place] // values[size] for place in range(size)]
    return out.reshape(books.shape)


def coded(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64,
          rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` (squared distance) of every vector that takes part; and the codebooks.

    The codebooks are an array by part, entry and component.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hex digits")
    rows, width = prepared(df, key, vector, label, parts, scale)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    kind = dict(rows.dtypes)["label"]
    if not start:
        return df.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), np.zeros((parts, 0, 0), dtype=np.int64)
    size = width // parts
    books = np.array([r[0] for r in start], dtype=np.int64).reshape(-1, parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = moved(rows, books)
    trees = [Gnat(book) for book in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            v = matrix(batch, "v", width).reshape(-1, parts, size)
            found = [tree.nearest(v[:, place])[:2] for place, tree in enumerate(trees)]
            numbers = np.stack([number for number, _ in found], axis=1).astype(np.uint8)
            code = pa.array([row.tobytes().hex() for row in numbers], pa.string())
            error = pa.array(np.sum([square for _, square in found], axis=0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, error], ["vec_id", "label", "code", "error"])

    made = rows.select("vec_id", "label", "v").mapInArrow(encode, f"vec_id long, label {kind}, code string, error long")
    return stored(made, "codes"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, as numbers of the original scale."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, books.shape[0] * books.shape[2]):
            numbers = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), dtype=np.uint8).reshape(-1, len(books))
            vectors = np.concatenate([books[place][numbers[:, place]] for place in range(len(books))], axis=1) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(vectors)], [*batch.schema.names, "vector"])

    names = [f"`{name}` {kind}" for name, kind in codes.dtypes]
    return codes.mapInArrow(decode, ", ".join([*names, "vector array<double>"]))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls together.

    Sums are few rows and combine before the shuffle; a hot label is rows of one side of an equality join, which Spark splits.
    """
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("l"))).drop("l")


def digest(books: np.ndarray) -> str:
    """Lower-case hex SHA-256 of all components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
