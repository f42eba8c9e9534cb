"""Centroids, vector codes and the digest index against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import centroids, codes, digests
from pagemill.session import work_path

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string"
DOCS = "doc_id long, text string, digest string, row int, id string"


def vectors(n, width, seed, structured=True):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width))
    if structured:
        points = 3 * rng.normal(size=(5, width))[rng.integers(0, 5, n)] + points * np.linspace(1.5, 0.05, width)
    return points.astype(np.float32)


def table_of(spark, points, extra=()):
    rows = [(i, [float(x) for x in p], i % 4 if i % 5 else None, "x", "y") for i, p in enumerate(points)]
    return spark.createDataFrame(rows + list(extra), VECTORS)


def odd(width):
    return [(9000, None, 1, "", ""), (9001, [], 1, "", ""), (9002, [float("nan")] * width, 1, "", ""), (9003, [math.inf] + [1.0] * (width - 1), 1, "", ""),
            (9004, [None] + [1.0] * (width - 1), 1, "", ""), (9005, [1.0] * (width - 1), 1, "", "")]


def brute_clusters(rows, k, rounds, scale):
    """Plain rounds over (id, vector) rows; Python whole numbers only."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found)


@pytest.mark.parametrize("structured", [True, False])
def test_clusters_match_brute_force_with_odd_repeated_and_anonymous_rows(spark, structured):
    points = vectors(250, 6, 1, structured)
    same = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None, "", "") for i in (3, 3, 7000, None, None)]
    df = table_of(spark, points, odd(6) + same)
    got = sorted(
        (r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
        for r in centroids.clustered(df, width=6, k=9, rounds=3, lead=2).collect()
    )
    assert got == brute_clusters([(i, p.tolist()) for i, p in enumerate(points)] + [(r[0], r[1]) for r in same], 9, 3, 64)


def test_ruling_out_centroids_is_exact_and_saves_comparisons():
    rng = np.random.default_rng(2)
    for spread, offset in ((3, 0), (400, 100_000_000), (90_000_000, 0)):
        points = rng.integers(-spread, spread + 1, size=(3000, 12)) * (rng.random(12) < 0.5) + offset
        points = points.astype(np.int64)
        centres = np.vstack([points[:14], points[:2]])  # with equal centroids
        mean = points.mean(axis=0)
        axes = np.linalg.eigh(np.cov((points - mean).T))[1].T[::-1]
        rotation = centroids.Rotation(mean, axes.copy(), 6)
        lead, rest = rotation.turn(points.astype(float))
        cluster, distance, compared = centroids.nearest(points, lead, rest, centres, rotation)
        squares = ((points[:, None] - centres) ** 2).sum(axis=2)
        assert (cluster == squares.argmin(axis=1)).all() and (distance == squares.min(axis=1)).all()
        assert compared.mean() < 14 or spread == 3


def test_clusters_of_few_or_no_vectors_and_of_far_components(spark):
    assert centroids.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    few = centroids.clustered(table_of(spark, vectors(3, 4, 5)), width=4, k=16).collect()
    assert sorted(r.vec_id for r in few) == [0, 1, 2] and {r.distance for r in few} == {0}
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(table_of(spark, np.full((2, 4), 3e7)), width=4).count()


def test_tree_finds_the_nearest_entry_of_any_codebook():
    rng = np.random.default_rng(4)
    for n, width, spread in ((64, 4, 200), (64, 4, 2), (1, 3, 5), (7, 2, 1), (64, 1, 3), (200, 5, 1 << 27), (64, 4, 0)):
        entries = rng.integers(-spread, spread + 1, size=(n, width))
        points = np.vstack([rng.integers(-spread, spread + 1, size=(2000, width)), entries])
        number, square, count = codes.Gnat(entries).nearest(points)
        squares = ((points[:, None] - entries) ** 2).sum(axis=2)
        assert (number == squares.argmin(axis=1)).all() and (square == squares.min(axis=1)).all()
        assert count <= squares.size
    entries = np.round(1000 * rng.normal(size=(5, 4)))[rng.integers(0, 5, 64)] + rng.integers(-20, 20, size=(64, 4))
    points = entries[rng.integers(0, 64, 5000)] + rng.integers(-5, 6, size=(5000, 4))
    assert codes.Gnat(entries).nearest(points)[2] < 0.6 * 5000 * 64


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows]
    size = len(kept[0][2]) // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for row in cut:
                groups.setdefault(near(row[p], book)[1], []).append(row[p])
            books[p] = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else e for j, e in enumerate(book)]
    found = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, label, _), error in zip(kept, errors):
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [(i is None, i or 0, "".join(f"{j:02x}" for _, j in f), error, sums[label]) for (i, label, _), f, error in zip(kept, found, errors)]
    return sorted(out), digest


@pytest.mark.parametrize("structured", [True, False])
def test_codes_match_brute_force_with_odd_repeated_and_anonymous_rows(spark, structured):
    points = vectors(150, 12, 6, structured)
    same = [(i, [0.5] * 12, None, "", "") for i in (2, 2, 8000, None)]
    df = table_of(spark, points, odd(12) + same + [(8001, [1.0] * 8, 2, "", "")])
    made, books = codes.coded(df, parts=4, entries=20)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in codes.with_label_errors(made).collect())
    rows = [(i, p.tolist(), i % 4 if i % 5 else None) for i, p in enumerate(points)] + [(r[0], r[1], None) for r in same]
    want, digest = brute_codes(rows, 4, 20, 2, 256)
    assert got == want and codes.digest(books) == digest


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    points = vectors(80, 8, 7)
    made, books = codes.coded(table_of(spark, points), parts=2, entries=16)
    for r in codes.decoded(made, books).collect():
        whole = np.floor(points[r.vec_id].astype(float) * 256)
        assert ((whole - 256 * np.array(r.vector)) ** 2).sum() == r.error


def test_codes_of_few_or_no_vectors(spark):
    made, books = codes.coded(spark.createDataFrame([], VECTORS))
    assert codes.with_label_errors(made).count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    made, books = codes.coded(table_of(spark, vectors(3, 16, 8)))
    assert {r.error for r in made.collect()} == {0} and books.shape == (16, 3, 1)


SPACES = ["a b", "a \t\n b", " a b", "a b ", "", None, " ", "\x0b\x0c", "ä b", "a b", "a b", "x" * 300_000, "x " * 150_000]


def brute_groups(rows):
    texts = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        texts.setdefault(key, []).append(i)
    return {
        hashlib.sha256(k.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for k, ids in texts.items()
    }


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_dedup_matches_brute_force(spark, batches):
    rows = [(i, SPACES[i % len(SPACES)]) for i in range(40)] + [(i, f"text {i % 70}") for i in range(100, 400)]
    rows += [(3, SPACES[3]), (3, SPACES[3]), (None, "only here"), (None, "only here"), (None, "a b")]
    df = spark.createDataFrame([(i, t, "d", 1, "i") for i, t in rows], DOCS)
    got = digests.deduplicated(df, work_path(spark, "index"), batches=batches, bucket_rows=50).collect()
    want = brute_groups(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    kept = {}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.digest.hex()]
        if r.kept:
            assert r.doc_id == r.keep_id and r.digest not in kept
            kept[bytes(r.digest)] = r.doc_id
    assert len(kept) == len(want)


def test_dedup_of_nothing(spark):
    assert digests.deduplicated(spark.createDataFrame([], DOCS), work_path(spark, "index")).count() == 0


def keyed(spark, ids, texts):
    return digests.keyed(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))


def test_index_outlives_its_session_and_a_batch_that_runs_twice(spark):
    path = work_path(spark, "index")
    index = digests.DigestIndex.create(spark, path, buckets=4)
    first, second = keyed(spark, [5, 6, 7], ["a", "b", "b"]), keyed(spark, [1, 8, 9], ["a", "c", "c"])
    index.add(first, 0)
    index.add(second, 1)
    index.add(second, 1)  # again, as after a lost driver
    index.close()
    index = digests.DigestIndex.open(spark, path)
    held = {(r.keep_id, r.batch) for r in index.entries().collect()}
    assert held == {(5, 0), (6, 0), (8, 1)}  # the row that a batch kept stays, also for a smaller id that comes later
    assert {r.keep_id for r in index.fresh(keyed(spark, [2, 3], ["c", "d"]), 2).collect()} == {3}
    smaller = index.compact(work_path(spark, "compacted"))
    assert {r.keep_id for r in smaller.entries().collect()} == {5, 6, 8}
    index.close()
    smaller.close()


def test_index_is_joined_where_it_lies(spark):
    many = keyed(spark, range(2000), [f"t {i}" for i in range(2000)])
    index = digests.DigestIndex.create(spark, work_path(spark, "index"), buckets=8)
    index.add(many, 0)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = index.fresh(many, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    old = plan[plan.index("SortMergeJoin"):].split("\n")
    scan = next(n for n, line in enumerate(old) if "Bucketed: true" in line)
    # From the scan up to the join: neither an exchange nor a sort, since every bucket is one sorted file.
    depth, above = len(old[scan]) - len(old[scan].lstrip(" :+-*")), []
    for line in reversed(old[:scan]):
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            depth = at
            above.append(line)
    text = " ".join(above[:above.index(next(x for x in above if "SortMergeJoin" in x))])
    assert "Exchange" not in text and "Sort [" not in text
    assert index.fresh(many, 1).count() == 0
    index.close()
