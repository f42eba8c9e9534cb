"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

* ``fit`` builds ``n_trees`` trees, each in a task of its own, over a bounded sample of vectors. A
  node splits at the median of the projection on the difference of two random members, and is stored as their two numbers.
* Every vector of the table, not the sample alone, goes down all trees. Equal vectors are one row with
  their smallest ids, so copies fill no leaf.
* ``walk`` goes through all trees for a query by one priority queue. A leaf's place in it is the sum of squared margins
  where its path leaves the query's side, which bounds its distance from below. Leaves are taken until they hold
  ``search_factor * n ** search_power`` vectors (counted per tree) of a table of ``n`` different ones.
* ``Cells`` cuts a leaf with many vectors or visitors into cells of bounded size, so no leaf is one task, and deals the cells
  to groups of about ``GROUP_ROWS`` rows. Vectors are shuffled once, to their groups, and a query is one row in each group that it visits. A group gives the best ``k``
  of each of its queries by exact distance, and the best of all groups are the answer.

The law of the search fits vectors without any structure, of which the nearest ten are hardly nearer than the rest: such tables
need a share of their vectors that falls slowly as they grow. One law holds at every size, with no floor and no switch.
Leaves beyond the sample grow with the table, so a query visits about as many, each with more vectors. Vectors of real models need less.

What the driver holds and sends has a bound: the sample (``sample_rows`` and ``sample_bytes``), and per leaf, of which there are fewer
than sampled vectors in each tree, two counts.

Defined results: null, empty or zero vectors, vectors with null or non-finite components and vectors of another length than
the most frequent (the smaller of two as frequent) take no part, nor do rows of null id. Rows that share an id
and a vector count once. Different vectors of one id are each a candidate, so an id can come back twice, and a query id with
several vectors has the ``k`` nearest pairs of them all; rows of its own id are never its answer. Ties go to the smaller id. With fewer candidates than ``k`` all that are found
come back. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.common import stored
from pagemill.llm.vectors import matrix, slices

#: Vectors and visitors of one cell.
CELL_ROWS, CELL_VISITS = 4096, 1024
GROUP_ROWS = 20_000
#: Queries that walk the forest together.
WALK_ROWS = 64


@dataclass(frozen=True)
class Settings:
    n_trees: int = 16
    leaf_rows: int = 32
    sample_rows: int = 65_536
    sample_bytes: int = 32 << 20
    search_factor: float = 4.5
    search_power: float = 0.8
    seed: int = 7


@dataclass
class Tree:
    """Inner nodes: the two members of the sample whose difference is the normal, threshold and children.

    A child below zero is the leaf ``-1 - child``.
    """

    pairs: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray

    @property
    def n_leaves(self) -> int:
        return len(self.thresholds) + 1

    def normals(self, sample: np.ndarray) -> np.ndarray:
        across = sample[self.pairs[:, 0]].astype(np.float64) - sample[self.pairs[:, 1]]
        return across / np.linalg.norm(across, axis=1, keepdims=True)

    def leaves(self, vectors: np.ndarray, sample: np.ndarray) -> np.ndarray:
        """Leaf of every vector, level by level."""
        at = np.zeros(len(vectors), dtype=np.int64) if len(self.thresholds) else np.full(len(vectors), -1)
        normals = self.normals(sample)
        while (moving := np.flatnonzero(at >= 0)).size:
            node = at[moving]
            side = np.einsum("ij,ij->i", vectors[moving], normals[node]) > self.thresholds[node]
            at[moving] = self.children[node, side.astype(np.int64)]
        return -1 - at


def grow(sample: np.ndarray, leaf_rows: int, seed: list[int]) -> Tree:
    """One tree over a sample; a node whose members cannot be told apart is a leaf."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pairs, thresholds, children = [], [], []
    n_leaves, work = 0, [(np.arange(len(sample)), -1, 0)]
    while work:
        rows, parent, side = work.pop()
        node = None
        if len(rows) > leaf_rows:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                normal = sample[a] - sample[b]
                height = sample[rows] @ normal
                cut = float(np.median(height))
                above = height > cut
                if 0 < above.sum() < len(rows):
                    node = len(pairs)
                    pairs.append((a, b))
                    thresholds.append(cut / np.linalg.norm(normal))
                    children.append([0, 0])
                    work += [(rows[above], node, 1), (rows[~above], node, 0)]
                    break
        if node is None:
            n_leaves += 1
            node = -n_leaves
        if parent >= 0:
            children[parent][side] = node
    return Tree(np.array(pairs, dtype=np.int64).reshape(-1, 2), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2))


def walk(forest: list[Tree], sizes: list[np.ndarray], margins: list[np.ndarray], rows: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) by the squared margins on the way to them, until they hold ``rows`` vectors."""
    queue = [(0.0, t, 0 if len(tree.thresholds) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < rows:
        cost, t, node = heapq.heappop(queue)
        if node < 0:
            held += int(sizes[t][-1 - node])
            found.append((t, -1 - node))
            continue
        margin = float(margins[t][node])
        near, far = forest[t].children[node][int(margin > 0)], forest[t].children[node][int(margin <= 0)]
        heapq.heappush(queue, (cost, t, int(near)))
        heapq.heappush(queue, (cost + margin * margin, t, int(far)))
    return found


class Cells:
    """Where the vectors and visits of every leaf meet; leaves of all trees are numbered through."""

    def __init__(self, sizes: np.ndarray, visits: np.ndarray):
        self.rows = np.where(visits > 0, -(-sizes // CELL_ROWS), 0)
        self.columns = -(-visits // CELL_VISITS)
        cells = self.rows * self.columns
        self.first = np.cumsum(cells) - cells
        # Cells of one leaf are about as large; cells follow each other into groups by their load.
        self.load = -(-sizes // np.maximum(1, self.rows)) + -(-visits // np.maximum(1, self.columns))
        self.before = np.cumsum(cells * self.load) - cells * self.load

    def deal(self, leaf: np.ndarray, place: np.ndarray, along_rows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number of the input, cell and group of every copy: a vector is in one row of cells, a visit in one column."""
        own, copies = (self.rows, self.columns) if along_rows else (self.columns, self.rows)
        copies = np.where(own[leaf] > 0, copies[leaf], 0)
        at = np.repeat(np.arange(len(leaf)), copies)
        other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        leaf = leaf[at]
        fixed = place[at] % own[leaf]
        inside = fixed * self.columns[leaf] + other if along_rows else other * self.columns[leaf] + fixed
        return at, self.first[leaf] + inside, (self.before[leaf] + inside * self.load[leaf]) // GROUP_ROWS


def numbers(df: DataFrame, vector: str) -> str:
    """Single-precision vectors are stored as such, which loses nothing; distances are always in double precision."""
    kind = df.schema[vector].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array of floats, as they come, or of doubles) of the rows that take part."""
    v = F.col(f"`{vector}`").cast(f"array<{numbers(df, vector)}>")

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    rows = stored(rows.distinct(), "vectors")
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.filter(F.size("v") == (width["width"] if width else 0))


def fit(vectors: DataFrame, settings: Settings) -> tuple[np.ndarray, list[Tree]]:
    """A sample, the vectors of the smallest hashes, and its forest."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return np.zeros((0, 0), dtype=np.float32), []
    wanted = max(1, min(settings.sample_rows, settings.sample_bytes // (4 * width)))
    drawn = vectors.withColumn("h", F.xxhash64("v", F.lit(settings.seed)))
    # Few more than wanted pass the filter, so what tasks hand to the limit is of its size.
    drawn = drawn.filter(F.pmod("h", F.lit(1 << 40)) <= int(1.1 * min(1.0, wanted / n) * (1 << 40)) + 1)
    rows = drawn.orderBy("h", "v").limit(wanted).select(F.col("v").cast("array<float>").alias("v")).toArrow()
    sample = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    del rows
    if not len(sample):  # only hashes above the filter: a table of very few vectors
        return np.zeros((0, width), dtype=np.float32), [Tree(np.zeros((0, 2), dtype=np.int64), np.zeros(0), np.zeros((0, 2), dtype=np.int64))]
    shared = spark.sparkContext.broadcast(sample)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                tree = grow(shared.value.astype(np.float64), settings.leaf_rows, [settings.seed, int(number)])
                yield pd.DataFrame({"tree": [number], "pairs": [tree.pairs.ravel()], "thresholds": [tree.thresholds], "children": [tree.children.ravel()]})

    kinds = "tree long, pairs array<long>, thresholds array<double>, children array<long>"
    built = spark.range(0, settings.n_trees, 1, settings.n_trees).mapInPandas(build, kinds).orderBy("tree").toArrow()
    shared.destroy()
    forest = []
    for n in range(built.num_rows):
        pairs, thresholds, children = (built.column(c)[n].values.to_numpy(zero_copy_only=False) for c in ("pairs", "thresholds", "children"))
        forest.append(Tree(pairs.reshape(-1, 2), thresholds, children.reshape(-1, 2)))
    return sample, forest


def _per_leaf(counts: DataFrame, n_leaves: int) -> np.ndarray:
    """Sums of ``n`` by ``leaf``, as one array of a number for each leaf."""
    found, out = counts.groupBy("leaf").agg(F.sum("n").alias("n")).toArrow(), np.zeros(n_leaves, dtype=np.int64)
    out[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    return out


def nearest(df: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10,
            settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance) of each query row's ``k`` nearest others.

    ``queries`` holds the ids (column ``key``) of the rows of ``df`` to search for.
    """
    spark = df.sparkSession
    points = clean(df, key, vector)
    # Of equal vectors the k + 1 smallest ids can be answers. A class is a number: ids can be in several. The two smallest
    # ids tell which one comes first for a query of any id; they are equal if there is one.
    classes = points.groupBy("v").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "numbered")
    second = points.join(classes.filter("least < most"), "v").filter(F.col("id") > F.col("least")).groupBy("class").agg(F.min("id").alias("second"))
    classes = stored(classes.join(second, "class", "left").select("class", "v", "least", F.coalesce("second", "least").alias("second")), "classes")
    members = points.join(classes, "v").select("class", "id")
    sample, forest = fit(classes, settings)
    empty = "query_id long, rank int, vec_id long, score double"
    if not forest:
        return spark.createDataFrame([], empty)
    width, first = sample.shape[1], np.cumsum([0, *(tree.n_leaves for tree in forest)])
    shared = spark.sparkContext.broadcast((sample, forest))
    trees = range(len(forest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(int(first[-1]), dtype=np.int64)
        for batch in slices(batches, width):
            vectors = matrix(batch, "v", width).astype(np.float64)
            for t, tree in enumerate(shared.value[1]):
                held += np.bincount(first[t] + tree.leaves(vectors, shared.value[0]), minlength=len(held))
        yield pa.RecordBatch.from_pydict({"leaf": np.flatnonzero(held), "n": held[held > 0]})

    flat = _per_leaf(classes.select("v").mapInArrow(count, "leaf long, n long"), int(first[-1]))
    sizes = [flat[first[t]:first[t + 1]] for t in trees]
    # Every tree holds each vector once.
    wanted = math.ceil(settings.search_factor * int(sizes[0].sum()) ** settings.search_power)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            for start in range(0, batch.num_rows, WALK_ROWS):
                part = batch.slice(start, WALK_ROWS)
                vectors = matrix(part, "qv", width).astype(np.float64)
                margins = [vectors @ tree.normals(shared.value[0]).T - tree.thresholds for tree in shared.value[1]]
                found = [
                    np.array([first[t] + leaf for t, leaf in walk(shared.value[1], sizes, [m[n] for m in margins], wanted)])
                    for n in range(part.num_rows)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], [*part.schema.names, "leaves"])

    asked = points.join(queries.select(F.col(f"`{key}`").cast("long").alias("id")).distinct(), "id").select(
        F.col("id").alias("query_id"), F.col("v").alias("qv")
    )
    # One that asks is a vector of a query id.
    asked = stored(asked.withColumn("asker", F.monotonically_increasing_id()), "asked")
    spread = asked.repartition(max(spark.sparkContext.defaultParallelism, points.rdd.getNumPartitions()), "asker")
    kind = numbers(df, vector)
    query = f"asker long, query_id long, qv array<{kind}>"
    # A row is a query with all the leaves it visits.
    visits = stored(spread.select("asker", "query_id", "qv").mapInArrow(visit, f"{query}, leaves array<long>"), "visits")

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(flat), dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("leaves").flatten().to_numpy(), minlength=len(held))
        yield pa.RecordBatch.from_pydict({"leaf": np.flatnonzero(held), "n": held[held > 0]})

    cells = Cells(flat, _per_leaf(visits.select("leaves").mapInArrow(count_visits, "leaf long, n long"), len(flat)))

    def place_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            vectors, classes = matrix(batch, "v", width).astype(np.float64), batch.column("class").to_numpy()
            for t, tree in enumerate(shared.value[1]):
                at, cell, group = cells.deal(first[t] + tree.leaves(vectors, shared.value[0]), classes, True)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(cell), *rows.columns], ["group", "cell", *rows.schema.names])

    def place_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            leaves, askers = batch.column("leaves"), batch.column("asker").to_pylist()
            for n, asker in enumerate(askers):
                at = leaves[n].values.to_numpy()
                _, cell, group = cells.deal(at, np.full(len(at), asker), False)
                order = np.argsort(group, kind="stable")
                groups, starts = np.unique(group[order], return_index=True)
                # One row for each group: the query, and its cells there.
                parts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(cell[order]))
                rows = batch.slice(n, 1).select(["asker", "query_id", "qv"]).take(pa.array(np.zeros(len(groups), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(groups), parts, *rows.columns], ["group", "cells", *rows.schema.names])

    left = classes.select("class", "least", "second", "v").mapInArrow(
        place_vectors, f"group long, cell long, class long, least long, second long, v array<{kind}>"
    )
    right = visits.mapInArrow(place_visits, f"group long, cells array<long>, {query}")

    def rerank(rows: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        names = ["asker", "query_id", "class", "first", "score"]
        out = [pd.DataFrame({name: [] for name in names})]
        if len(rows) and len(visitors):
            vectors, asked = (np.stack(x.to_numpy()).astype(np.float64) for x in (rows["v"], visitors["qv"]))
            ids, least, second = (rows[name].to_numpy() for name in ("class", "least", "second"))
            askers, query_ids, here = visitors["asker"].to_numpy(), visitors["query_id"].to_numpy(), rows.groupby("cell").indices
            number = np.repeat(np.arange(len(visitors)), visitors["cells"].map(len).to_numpy())
            for cell, members in pd.Series(np.concatenate(visitors["cells"].to_numpy())).rename("cell").to_frame().groupby("cell").indices.items():
                if cell in here:
                    who, at = number[members], here[cell]
                    score = distances(vectors[at], asked[who])
                    first = np.where(least[at] == query_ids[who][:, None], second[at], least[at])
                    score[first == query_ids[who][:, None]] = np.inf  # a class of the query's id alone
                    far = np.partition(score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
                    q, v = np.nonzero((score <= far[:, None]) & (first != query_ids[who][:, None]))
                    out.append(pd.DataFrame(dict(zip(names, (askers[who[q]], query_ids[who[q]], ids[at[v]], first[q, v], score[q, v])))))
        found = pd.concat(out[1:] or out).drop_duplicates(["asker", "class"]).sort_values(["query_id", "score", "first", "asker", "class"])
        return found.groupby("query_id").head(k).astype({name: "int64" for name in names[:4]})

    kinds = "asker long, query_id long, class long, first long, score double"
    found = stored(left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(rerank, kinds), "found")
    shared.destroy()
    best = _best(found.distinct(), ["score", "first", "asker", "class"], k)
    spread = best.join(_smallest(members, k + 1), "class").withColumn("vec_id", F.explode("ids")).filter("vec_id <> query_id")
    ranked = _best(spread.select("query_id", "vec_id", "score"), ["score", "vec_id"], k)
    return ranked.select("query_id", F.col("n").alias("rank"), "vec_id", "score")


def distances(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row for each query, in double precision and summed in the order of the components."""
    total = np.zeros((len(queries), len(vectors)))
    for j in range(vectors.shape[1]):
        total += (vectors[:, j] - queries[:, j, None]) ** 2
    return np.sqrt(total)


def _best(df: DataFrame, order: list[str], n: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("n", number).filter(F.col("n") <= n)


def _smallest(members: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of each class; ranks are limited before the shuffle, so a large class is not gathered."""
    number = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    return members.withColumn("n", number).filter(F.col("n") <= n).groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"))
