"""Centroid clustering in whole numbers, with centroids ruled out in rotated coordinates.

* ``prepared`` turns components into whole numbers once. A sum of products per task, added up by Spark, gives the
  covariance of all vectors; its eigenvectors are a rotation whose leading coordinates hold most of the spread.
* Every vector is stored with its ``lead`` rotated coordinates and the norm of the rest. For a centroid treated alike, the squared
  distance of the leading coordinates plus the squared difference of the residual norms is never above the squared
  distance. It is lowered by a slack far above the rounding of doubles.
* ``nearest`` computes the exact whole-number distance of the centroid with the lowest bound, rules out every centroid whose bound is
  above it, and compares the others in whole numbers. Bounds decide what is compared, never what is nearest.
* A round shuffles one row of sums per task and centroid; vectors never move.

What the driver holds are centroids and the rotation: ``k`` x width and width x width numbers, whatever the table.

Defined results: null vectors, vectors of another length than ``width`` and vectors with null or non-finite components take no
part. Rows of a null id take part but start no centroid unless too few others are there. Repeated rows count as often as they
come, also as starting centroids; vectors of one id start in the order of their components. With fewer than ``k`` vectors there are
as many centroids; an empty table gives no rows. A component that no 64-bit distance can hold is an error. Extra columns are ignored.
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

#: Share of the squared norms that bounds are lowered by; rounding errs by less than 1e-12 of them.
SLACK = 1e-9
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"


@dataclass(frozen=True)
class Rotation:
    """Mean, all rotated axes by falling spread, and how many of them lead."""

    mean: np.ndarray
    axes: np.ndarray
    lead: int

    def turn(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the others."""
        turned = (vectors - self.mean) @ self.axes.T
        return turned[:, : self.lead], np.sqrt((turned[:, self.lead:] ** 2).sum(axis=1))


def nearest(vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of every vector (the smaller number of equals), its squared distance, and how many were compared."""
    lead_c, rest_c = rotation.turn(centroids.astype(np.float64))
    norm, norm_c = (lead ** 2).sum(axis=1) + rest ** 2, (lead_c ** 2).sum(axis=1) + rest_c ** 2
    flat = (lead ** 2).sum(axis=1)[:, None] + (lead_c ** 2).sum(axis=1) - 2 * (lead @ lead_c.T)
    low = flat + (rest[:, None] - rest_c) ** 2 - SLACK * (norm[:, None] + norm_c)
    cluster = low.argmin(axis=1)
    best = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
    open_ = low <= best[:, None] * (1 + SLACK)
    compared = open_.sum(axis=1)
    open_[np.arange(len(vectors)), cluster] = False
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, number])
        distance = ((vectors[rows] - centroid) ** 2).sum(axis=1)
        nearer = (distance < best[rows]) | ((distance == best[rows]) & (number < cluster[rows]))
        best[rows[nearer]], cluster[rows[nearer]] = distance[nearer], number
    return cluster, best, compared


def prepared(df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id`` and ``v`` (whole numbers) of the rows that take part."""
    v = F.col(f"`{vector}`")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == width) & finite(F.col("v")))
    return stored(rows.select("vec_id", scaled(F.col("v"), scale).alias("v")), "whole")


def rotation_of(rows: DataFrame, width: int, lead: int) -> Rotation:
    """The principal axes of all vectors; one sum of products per task is all that moves."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in slices(batches, width):
            v = matrix(batch, "v", width).astype(np.float64)
            v = np.hstack([v, np.ones((len(v), 1))])
            total += v.T @ v
        if total[-1, -1]:
            yield pa.RecordBatch.from_pydict({"place": np.arange(total.size), "value": total.ravel()})

    sums = rows.select("v").mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value")).collect()
    total = np.zeros((width + 1) ** 2)
    for place, value in sums:  # (width + 1)^2 rows
        total[place] = value
    total = total.reshape(width + 1, width + 1)
    n = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / n
    spread = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1]
    return Rotation(mean, spread.T[::-1].copy(), min(lead, width))


def rotated(rows: DataFrame, rotation: Rotation, width: int) -> DataFrame:
    """``rows`` with ``lead`` (leading rotated coordinates) and ``rest`` (norm of the others)."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            lead, rest = rotation.turn(matrix(batch, "v", width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists(lead), pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    return stored(rows.select("vec_id", "v").mapInArrow(turn, "vec_id long, v array<int>, lead array<double>, rest double"), "rotated")


def starting(rows: DataFrame, k: int, seed: str = "1:") -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of their ids."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    return np.array([r[0] for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; one without any stays."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in slices(batches, width + k):
            v = matrix(batch, "v", width).astype(np.int64)
            cluster, _, _ = nearest(v, matrix(batch, "lead", rotation.lead), batch.column("rest").to_numpy(), centroids, rotation)
            np.add.at(total, cluster, np.hstack([v, np.ones((len(v), 1), dtype=np.int64)]))
        held = np.flatnonzero(total[:, -1])
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), lists(total[held])], ["cluster", "sums"])

    parts = rows.select("v", "lead", "rest").mapInArrow(sums, "cluster long, sums array<long>")
    parts = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")))
    found: dict[int, dict[int, int]] = {}
    for cluster, place, total in parts.collect():  # k x (width + 1) rows
        found.setdefault(cluster, {})[place] = int(total)
    out = centroids.copy()
    for cluster, total in found.items():
        out[cluster] = [total[place] // total[width] for place in range(width)]
    return out


def clustered(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64, k: int = 16,
              rounds: int = 3, lead: int = 16) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every vector that takes part.

    ``compared`` is the number of centroids whose distance was computed after the bounds.
    """
    spark = df.sparkSession
    rows = prepared(df, key, vector, width, scale)
    centroids = starting(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    rotation = rotation_of(rows, width, lead)
    rows = rotated(rows, rotation, width)
    for _ in range(rounds):
        centroids = moved(rows, centroids, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width + k):
            v = matrix(batch, "v", width).astype(np.int64)
            found = nearest(v, matrix(batch, "lead", rotation.lead), batch.column("rest").to_numpy(), centroids, rotation)
            cluster, distance, compared = (pa.array(x.astype(t)) for x, t in zip(found, (np.int32, np.int64, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, distance, compared], ["vec_id", "cluster", "distance", "compared"])

    assigned = stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long, compared int"), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(inertia.values())
    about = spark.createDataFrame([(c, n, total, digests[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    return assigned.join(F.broadcast(about), "cluster").select(*names)  # k rows
