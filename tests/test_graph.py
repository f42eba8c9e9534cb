"""Graph jobs against brute force on small graphs."""

import pytest
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.operators import frontier, graph, links
from pagemill.operators.numbering import number_urls, row_numbers
from pagemill.plans import corpus
from pagemill.session import cut_lineage
from pagemill.sources.buckets import bucketed, drop_tables


def brute_rank(nodes, edges, rounds, d=0.85):
    n = len(nodes)
    out = {v: sum(1 for s, _ in edges if s == v) for v in nodes}
    score = {v: 1 / n for v in nodes}
    for _ in range(rounds):
        nxt = {v: (1 - d) / n for v in nodes}
        for s, t in edges:
            nxt[t] += d * score[s] / out[s]
        score = nxt
    return score


GRAPHS = {
    "cycle": ([1, 2, 3], [(1, 2), (2, 3), (3, 1)]),
    "dangling": ([1, 2, 3, 4], [(1, 2), (1, 3), (2, 2), (3, 4)]),
    "stubs only": ([1, 2, 3], [(1, 2), (1, 3)]),
    "no edges": ([5, 6], []),
    "hub": (list(range(30)), [(0, i) for i in range(30)] + [(i, (i * 7) % 30) for i in range(1, 30)]),
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("hot_degree", [1_000_000, 3])
def test_pagerank(spark, name, hot_degree):
    nodes, edges = GRAPHS[name]
    n = spark.createDataFrame([(v,) for v in nodes], "id long")
    e = spark.createDataFrame(edges, "source_id long, target_id long")
    for rounds in (1, 7):
        got = {r.id: r.score for r in graph.pagerank(n, e, iterations=rounds, checkpoint_every=3, hot_degree=hot_degree).collect()}
        want = brute_rank(nodes, edges, rounds)
        assert got.keys() == want.keys()
        assert all(abs(got[v] - want[v]) < 1e-12 for v in nodes)
        total = sum(got.values())
        assert total <= 1 + 1e-12
        if name == "cycle":
            assert abs(total - 1) < 1e-12


def test_pagerank_round_shuffles_sums_only(spark):
    n = spark.range(50).select("id")
    e = spark.range(500).select((F.col("id") % 50).alias("source_id"), (F.col("id") * 7 % 50).alias("target_id"))
    made = []
    three, two = (
        graph._pagerank(n, e, graph.DAMPING, rounds, 5, graph.HOT_DEGREE, False, made)._jdf.queryExecution().executedPlan().toString()
        for rounds in (3, 2)
    )
    for name in made:
        spark.sql(f"drop table {name}")
    assert three.count("Exchange hashpartitioning") == two.count("Exchange hashpartitioning") + 1


def brute_shared_rank(nodes, edges, rounds):
    scores = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        out = {v: [t for s_, t in edges if s_ == v] for v in nodes}
        unsent = sum(scores[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * unsent / len(nodes))
        for v in nodes:
            for t in out[v]:
                new[t] += 0.85 * scores[v] / len(out[v])
        scores = new
    return scores


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("hot_degree", [1_000_000, 3])
def test_pagerank_that_shares_the_score_of_nodes_without_links(spark, name, hot_degree):
    nodes, edges = GRAPHS[name]
    n = spark.createDataFrame([(v,) for v in nodes], "id long")
    e = spark.createDataFrame(edges, "source_id long, target_id long")
    for rounds in (1, 4):
        got = {r.id: r.score for r in graph.pagerank(n, e, iterations=rounds, hot_degree=hot_degree, dangling="redistribute").collect()}
        want = brute_shared_rank(nodes, edges, rounds)
        assert all(abs(got[v] - want[v]) < 1e-12 for v in nodes) and abs(sum(got.values()) - 1) < 1e-12
    with pytest.raises(ValueError):
        graph.pagerank(n, e, dangling="keep")


@pytest.mark.parametrize("hot_degree", [1_000_000, 1])
def test_bfs_with_hot_sources(spark, hot_degree):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 3), (1, 3)], "source_id long, target_id long")
    got = {r.id: r.depth for r in graph.bfs_levels(edges, spark.createDataFrame([(1,)], "id long"), 2, hot_degree).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_a_bfs_level_does_not_shuffle_the_edges(spark):
    made = []
    edges = spark.range(1000).select((F.col("id") % 50).alias("source_id"), (F.col("id") * 7 % 90).alias("target_id"))
    degrees = cut_lineage(edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links_out")))
    cold = bucketed(edges, "source_id", 4, made)
    start = cut_lineage(spark.range(3).select("id"))
    plan = graph.reached_from(start, cold, None, graph.HotSources(degrees, 10**6))._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert "Bucketed: true" in plan and not any("source_id" in line and "target_id" in line for line in shuffled) and len(shuffled) == 2
    drop_tables(spark, made)


def test_bfs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 3)], "source_id long, target_id long")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r.depth for r in graph.bfs_levels(edges, seeds, 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_ids_are_dense_and_stable(spark):
    urls = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("url"))
    first = {r.url: r.id for r in number_urls(urls, 10).collect()}
    again = {r.url: r.id for r in number_urls(urls.repartition(7), 10).collect()}
    assert first == again and sorted(first.values()) == list(range(11, 3011))


def test_row_numbers_with_a_hot_group(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") * 7919 % 2003).alias("k")
    )
    got = row_numbers(rows, ["g"], ["k"], "n").collect()
    for group in ("rare", "hot"):
        mine = sorted((r.k, r.n) for r in got if r.g == group)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    whole = row_numbers(rows, [], ["k"], "n").collect()
    assert [r.n for r in sorted(whole, key=lambda r: r.k)] == list(range(1, 2001))


def test_load_links(spark):
    pages = spark.createDataFrame([(1, "http://a/x"), (2, "http://b/y")], "id long, url string")
    out = spark.createDataFrame(
        [("http://a/x", ["http://b/y", "http://c/z?q", "http://b/y", "http://a/x"]), ("http://b/y", ["http://c/z?q"])],
        "url string, targets array<string>",
    )
    stubs, edges = links.load_links(pages, out)
    assert [tuple(r) for r in stubs.select("id", "url", "domain", "depth").collect()] == [(3, "http://c/z?q", "c", -1)]
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 1), (1, 2), (1, 3), (2, 3)]
    everyone = pages.unionByName(stubs.select("id", "url"))
    again = links.add_edges(edges, links.resolve_edges(links.link_pairs(out), everyone))
    assert sorted(tuple(r) for r in again.collect()) == [(1, 1), (1, 2), (1, 3), (2, 3)]
    left = links.drop_dangling_edges(edges, everyone.filter("id != 3"))
    assert sorted(tuple(r) for r in left.collect()) == [(1, 1), (1, 2)]


def test_edges_of_repeated_rows_are_distinct(spark):
    html_ = '<p>x</p><a href="/b">b</a><a href="/c">c</a>'
    rows = [(1, "http://h/a", html_), (1, "http://h/a", html_), (2, "http://h/a#x", html_), (2, "http://h/b", html_), (None, "http://h/z", "z"), (None, "http://h/z", "z")]
    raw = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages, edges = corpus.load_corpus(spark.createDataFrame([], schemas.PAGES), raw, F.lit("2024-01-01").cast("timestamp"))
    url = {r.id: r.url for r in pages.collect()}
    assert sorted(url.values()) == ["http://h/a", "http://h/b", "http://h/c", "http://h/z"]
    found = sorted((url[r.source_id], url[r.target_id]) for r in edges.collect())
    assert found == [("http://h/a", "http://h/b"), ("http://h/a", "http://h/c"), ("http://h/b", "http://h/b"), ("http://h/b", "http://h/c")]
    outlinks = spark.createDataFrame([("http://h/a", ["http://h/b"]), ("http://h/a", ["http://h/b", "http://h/c"]), ("http://h/b", ["http://h/b"])], "url string, targets array<string>")
    _, edges = links.load_links(pages.select("id", "url"), outlinks)
    assert sorted((url[r.source_id], url[r.target_id]) for r in edges.collect()) == [
        ("http://h/a", "http://h/b"), ("http://h/a", "http://h/c"), ("http://h/b", "http://h/b")]


def test_frontier(spark):
    found = spark.createDataFrame([("a", 0), ("a", 2), ("b", 1), ("c", 3), ("d", 0)], "target_url string, depth int")
    visited = spark.createDataFrame([("d",)], "url string")
    got = {r.url: r.depth for r in frontier.enqueue(found, visited, max_depth=3).collect()}
    assert got == {"a": 1, "b": 2}
    queue = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "url string, depth int")
    assert [r.url for r in frontier.pop(queue, 2).collect()] == ["c", "a"]


def test_schedule_spaces_hosts_and_caps_minutes(spark):
    queue = spark.createDataFrame([(f"http://h{i % 2}/{i:03d}", 0) for i in range(10)], "url string, depth int")
    rows = frontier.fetch_schedule(queue, delay_seconds=2.0, max_per_minute=4).collect()
    for host in ("h0", "h1"):
        times = [r.fetch_at for r in sorted((r for r in rows if r.domain == host), key=lambda r: r.host_turn)]
        assert all(b - a >= 2.0 or b % 60 == 0 for a, b in zip(times, times[1:]))
    per_minute = {}
    for r in rows:
        per_minute[r.fetch_at // 60] = per_minute.get(r.fetch_at // 60, 0) + 1
    assert max(per_minute.values()) <= 4


def test_pagerank_makes_its_edges_once(spark):
    # What the edges are made from is in no later plan, the last round's included; sums go by target in order.
    edges = spark.range(40).select(F.col("id").alias("source_id"), ((F.col("id") * 7 + 3) % 40).alias("target_id")).filter("source_id <> 987654")
    made = []
    ranks = graph._pagerank(spark.range(40), edges, graph.DAMPING, 4, 5, graph.HOT_DEGREE, False, made)
    assert "987654" not in ranks._jdf.queryExecution().optimizedPlan().toString()
    assert all(abs(r.score - 1 / 40) < 1e-12 for r in ranks.collect())
    drop_tables(spark, made)


def test_pagerank_leaves_no_table(spark):
    nodes, edges = spark.range(4), spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "source_id long, target_id long")
    ranks = graph.pagerank(nodes, edges, iterations=8, checkpoint_every=2)
    assert ranks.count() == 4
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pagemill_")]
