"""Nearest neighbours, near-duplicates and components against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import ann, graph, simhash

VECTORS = "vec_id long, embedding array<float>, label int, rank string"
DOCS = "doc_id long, text string, f string, component_id int"


def test_neighbours_match_brute_force_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0, "x") for i in range(300)]
    copy = [1.0] * 8
    rows += [(i, copy, 0, "x") for i in range(1000, 1040)]
    odd = [(2000, None, 0, "x"), (2001, [0.0] * 8, 0, "x"), (2002, [float("nan")] + [1.0] * 7, 0, "x"), (2003, [1.0], 0, "x"),
           (2004, [math.inf] + [1.0] * 7, 0, "x"), (2005, [None] + [1.0] * 7, 0, "x"), (None, copy, 0, "x"), (2006, [], 0, "x")]
    df = spark.createDataFrame(rows + odd + rows[:3], VECTORS)
    asked = df.filter((F.col("vec_id") % 100 == 0))
    got = {}
    for r in ann.nearest(df, asked, k=10, settings=ann.Settings(n_trees=4, leaf_rows=16, sample_rows=200, search_factor=1e4)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    points = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _, _ in rows}
    assert set(got) == {0, 100, 200, 1000}
    for q in got:
        want = sorted((math.sqrt(sum(((points[p] - points[q]) ** 2).tolist())), p) for p in points if p != q)[:10]
        assert [x[1] for x in sorted(got[q])] == [p for _, p in want]
        assert [x[0] for x in sorted(got[q])] == list(range(1, 11))
        assert [x[2] for x in sorted(got[q])] == pytest.approx([d for d, _ in want], abs=1e-12)
    # Copies: distance zero, smallest ids first, without the query itself.
    assert [x[1] for x in sorted(got[1000])] == list(range(1001, 1011))


def test_neighbours_of_ids_with_several_vectors_are_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 60, [float(x) for x in rng.normal(size=4).astype(np.float32)], 0, "") for i in range(240)]
    rows += [(0, [1.0] * 4, 0, ""), (7, [1.0] * 4, 0, ""), (7, [1.0] * 4, 0, ""), (0, [1.0, 1.0, 1.0, 2.0], 0, "")]
    df = spark.createDataFrame(rows, VECTORS)
    settings = ann.Settings(n_trees=4, leaf_rows=16, sample_rows=200, search_factor=1e4)
    found = sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=10, settings=settings).collect())
    different = {(i, tuple(v)) for i, v, _, _ in rows}
    for q in (0, 20, 40):
        pairs = sorted((math.dist(v, w), p) for i, v in different if i == q for p, w in different if p != q)[:10]
        got = [r for r in found if r[0] == q]
        assert [r[1:3] for r in got] == [(n, p) for n, (_, p) in enumerate(pairs, 1)]
        assert [r[3] for r in got] == pytest.approx([d for d, _ in pairs], abs=1e-12)


def test_neighbours_recall_when_few_leaves_are_read(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, [float(x) for x in p], 0, "") for i, p in enumerate(points.astype(np.float32))], VECTORS)
    settings = ann.Settings(n_trees=8, leaf_rows=32, sample_rows=1500, search_factor=0.92)
    found = ann.nearest(df, df.filter("vec_id % 100 = 0"), k=10, settings=settings).collect()
    p32, hit = points.astype(np.float32).astype(float), 0
    for q in range(0, 4000, 100):
        order = np.argsort(((p32 - p32[q]) ** 2).sum(1), kind="stable")
        hit += len({int(i) for i in order if i != q and True} & {r.vec_id for r in found if r.query_id == q} & {int(i) for i in order[:11]} - {q})
    assert hit >= 0.9 * 10 * 40


def recall(df, points, asked, settings):
    found = {}
    for r in ann.nearest(df, df.filter(F.col("vec_id").isin(asked)), k=10, settings=settings).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    wide = points.astype(float)
    order = {q: np.argsort(((wide - wide[q]) ** 2).sum(1), kind="stable")[:11] for q in asked}
    return sum(len(found[q] & ({int(i) for i in order[q]} - {q})) for q in asked) / (10 * len(asked))


@pytest.mark.parametrize("n,settings", [
    (500, ann.Settings()), (1500, ann.Settings()), (6000, ann.Settings()), (20_000, ann.Settings()), (20_000, ann.Settings(sample_rows=4000)),
])
def test_neighbours_recall_of_vectors_without_structure_holds_at_every_size(spark, n, settings):
    points = np.random.default_rng(6).normal(size=(n, 64))
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in p], 0, "") for i, p in enumerate(points)], VECTORS).repartition(4)
    asked = list(range(0, n, n // 60))
    assert recall(df, points, asked, settings) >= 0.9


def test_neighbours_recall_of_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    points = np.array([r[1] for r in df.orderBy("vec_id").collect()], dtype=np.float32)
    assert recall(df, points, list(range(0, 2000, 50)), ann.Settings()) >= 0.9


@pytest.mark.parametrize("rows,visits", [(1, 1), (5000, 1), (3, 5000), (9000, 3000), (40, 0)])
def test_every_vector_meets_every_visitor_of_its_leaf_once(rows, visits):
    sizes, visitors = np.array([7, rows, 5]), np.array([2, visits, 0])
    cells = ann.Cells(sizes, visitors)
    at, cell, group = cells.deal(np.full(rows, 1), np.arange(rows), True)
    at_v, cell_v, group_v = cells.deal(np.full(visits, 1), np.arange(visits), False)
    here = {}
    for c, row in zip(cell.tolist(), at.tolist()):
        here.setdefault(c, set()).add(row)
    met = {}
    for c, asker in zip(cell_v.tolist(), at_v.tolist()):
        met.setdefault(asker, []).append(here[c])
    assert len(met) == visits and all(sum(map(len, sets)) == rows == len(set().union(*sets)) for sets in list(met.values())[:20])
    groups = dict(zip(cell.tolist(), group.tolist()))
    assert all(groups[c] == g for c, g in zip(cell_v.tolist(), group_v.tolist()))
    assert max(np.bincount(cell), default=0) <= ann.CELL_ROWS and max(np.bincount(cell_v), default=0) <= ann.CELL_VISITS if visits else not len(cell)
    assert not len(cells.deal(np.full(5, 2), np.arange(5), True)[0])  # a leaf that nobody visits sends nothing


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ann.nearest(empty, empty).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.nearest(empty, empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (5, [0.0, 1.0], 0, "")], VECTORS)
    assert [(r.vec_id, r["rank"]) for r in ann.nearest(two, two.filter("vec_id = 0")).collect()] == [(5, 1)]


def brute_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "ÄB Ab", "a b c a b c a b", "x " * 70_000 + "y z"])
def test_fingerprint_is_the_defined_one(text):
    assert simhash.fingerprint_of(text) % 2**64 == brute_fingerprint(text)


def brute_components(prints):
    """Smallest id reachable over fingerprints that differ in two bits or fewer."""
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for doc, v in prints.items():
        least[find(v)] = min(least.get(find(v), doc), doc)
    return {doc: least[find(v)] for doc, v in prints.items()}


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = set(base)
    for b in base:
        for _ in range(25):
            v = b
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << bit
            values.add(v)
    # One crowded segment, bits at both ends of the segments and both signs.
    values |= {base[0] ^ (1 << k) for k in range(64)} | {0, 1, 1 << 63, (1 << 63) | 1, (1 << 31) | (1 << 32)}
    signed = [v - (v >> 63 << 64) for v in values]
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "f long")).collect()}
    want = {(a, b) for a in values for b in values if 1 <= (a ^ b).bit_count() <= 2}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}
    assert len(got) == len(want) // 2
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "f long"), 3)


def test_entries_of_fingerprints_are_not_sent_to_all_tasks(spark):
    # Few enough bytes for a broadcast by what Spark knows, before and while it runs; seventy entries a row are not.
    found = simhash.links(spark.range(0, 300, 3).select(F.col("id").alias("f")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_and_representatives_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(40)]
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " more", "a", 1) for i, t in enumerate(texts[:20])]
    rows += [(200, texts[3].upper(), "a", 1), (201, None, "a", 1), (202, "", "a", 1), (203, "  ", "a", 1), (204, texts[5], "a", 1)]
    df = spark.createDataFrame(rows + [rows[4]] + [(None, texts[6], "a", 1), (None, "lonely words here", "a", 1)], DOCS)
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    want = brute_components(prints)
    got = simhash.grouped(df).collect()
    assert len(got) == len(rows) + 3
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.component_id for r in got if r.doc_id is None} == {want[6], None}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 1


def test_no_documents_no_groups(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.grouped(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(100, 100), (7, 7), (1, 0), (-5, 200), (300, 300)]
    got = dict((r.node, r.root) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 150)} | {200: -5, -5: -5}
    assert got == want
