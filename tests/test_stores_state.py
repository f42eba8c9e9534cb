"""Tables in folders by url hash, the log of postings, and keyed retry state."""

import datetime
import random
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.operators import indexing, pages as page_table, search
from pagemill.session import cut_lineage
from pagemill.sources import page_store, tables
from pagemill.streaming import index_sync, recent_retries, visited
from pagemill.streaming.sources import read_files

NOW = "2024-01-01"


def writes(spark, urls, seq, title):
    given = {"url": F.col("url"), "title": F.lit(title), "domain": F.lit("h"), "depth": F.lit(0), "body_text": F.lit("b"),
             "crawled_at": F.lit(NOW), "is_stub": F.lit(False), "seq": F.lit(seq)}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGE_WRITES])


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_an_upsert_leaves_the_files_of_other_folders(spark, tmp_path):
    path = str(tmp_path / "pages")
    store = page_store.PageStore(spark, path, folders=32)
    store.write(page_table.upsert(spark.createDataFrame([], schemas.PAGES), writes(spark, [f"u{i}" for i in range(500)], 1, "old")))
    before = files(path)
    for _ in range(2):  # a change that runs twice is the change
        store.upsert(writes(spark, ["u7", "new"], 2, "new"))
        after = files(path)
        same = [p for p in before if after.get(p) == before[p]]
        assert len(before) == 32 and len(same) >= 30
        rows = {r.url: r for r in store.read().collect()}
        assert len(rows) == 501 and sorted(r.id for r in rows.values()) == list(range(1, 502))
        assert rows["u7"].title == rows["new"].title == "new" and rows["u8"].title == "old" and rows["new"].id == 501
    store.soft_delete(spark.createDataFrame([("u9",), ("none",)], "url string"), F.lit(NOW).cast("timestamp"))
    assert [r.url for r in store.read().filter("deleted_at is not null").collect()] == ["u9"]


def test_a_small_batch_reads_few_folders_of_the_visited_urls(spark, tmp_path):
    path = str(tmp_path / "visited")
    urls = [f"http://h/{i}" for i in range(300)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "url string")
    visited.add_batch(frame(urls[:200]), path, 0)
    visited.add_batch(frame(urls[200:]), path, 1)
    visited.add_batch(frame(urls[200:]), path, 1)  # replayed
    asked = frame(["http://h/5", "http://h/250", "http://h/none"])
    earlier = visited.earlier(asked, path, 2)
    assert earlier.join(asked, "url", "left_semi").count() == 2 and visited.read(spark, path).count() == 300
    assert visited.earlier(asked, path, 1).join(asked, "url", "left_semi").count() == 1
    plan = earlier._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    visited.compact(spark, path, str(tmp_path / "compacted"), 1)
    assert visited.read(spark, str(tmp_path / "compacted")).count() == 300


DOCS = ("id long, url string, title string, meta_description string, domain string, language string, crawled_at double, "
        "rank_score double, body_text string, readability_score double, deleted boolean, synced_at timestamp")


def doc(i, body, crawled=0.0, deleted=False):
    return (i, f"u{i}", f"title {i}", "", "d", "en", crawled, 1.0, body, 0.0, deleted, datetime.datetime(2024, 1, 1))


def test_search_over_the_postings_log_equals_search_over_a_rebuilt_store(spark, tmp_path):
    rng = random.Random(3)
    body = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(12))
    batches = [[doc(i, body()) for i in range(30)],
               [doc(i, body(), 1.0) for i in range(5, 12)] + [doc(2, "", 1.0, True)] + [doc(40, body())],
               [doc(2, body(), 2.0), doc(7, "", 2.0, True)]]
    log_path, path = str(tmp_path / "docs"), str(tmp_path / "postings")
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, DOCS).select(*index_sync.LOG.fieldNames())
        for _ in range(2):  # each batch is replayed
            tables.append_batch(frame, log_path, n)
            indexing.append_postings(frame.filter("not deleted"), path, n)
        log = tables.read_log(spark, log_path, index_sync.LOG)
        postings = tables.read_log(spark, path, indexing.POSTINGS_LOG)
        versions = index_sync.live_versions(log)
        current = cut_lineage(index_sync.current_index(log))
        rebuilt = cut_lineage(indexing.postings(current))
        indexing.compact_postings(postings, versions, str(tmp_path / f"compact{n}"), n)
        compacted = tables.read_log(spark, str(tmp_path / f"compact{n}"), indexing.POSTINGS_LOG)
        want = sorted(tuple(r) for r in rebuilt.collect())
        queries = spark.createDataFrame([(1, "alpha beta", None, None), (2, "zeta gama title", None, None)], "qid long, q string, domain string, language string")
        ranked = []
        for some in (rebuilt, indexing.live_postings(postings, versions), indexing.live_postings(compacted, versions)):
            assert sorted(tuple(r) for r in some.select("term", "id", "field", "pos").collect()) == want
            if n == 2:
                answers, matches = search.match_documents(queries, some, current)
                ranked.append(sorted(tuple(r) for r in search.rank(queries, answers, matches, some).collect()))
        assert n < 2 or (ranked[0] == ranked[1] == ranked[2] and len(ranked[0]) > 20)


def test_the_start_of_a_word_finds_longer_ones(spark):
    words = spark.createDataFrame([("al",), ("beta",), ("ü",)], "word string")
    vocabulary = spark.createDataFrame([("alpha",), ("al",), ("alarm",), ("beta",), ("betas",), ("übel",), ("xal",)], "term string")
    assert {tuple(r) for r in search.match_prefixes(cut_lineage(words), vocabulary).collect()} == {
        ("al", "alpha", 0), ("al", "alarm", 0), ("beta", "betas", 0), ("ü", "übel", 0)}
    queries = spark.createDataFrame([(1, "a Bet"), (2, "bet "), (3, "..."), (4, "")], "qid long, q string")
    assert {tuple(r) for r in search.last_words(queries).collect()} == {(1, "bet")}


def brute_run(times, quiet):
    times, n = sorted(times), 0
    for i, t in enumerate(times):
        n = 1 if i and t - times[i - 1] > quiet else n + 1
    return n


def test_runs_merge_whatever_the_order():
    rng = np.random.default_rng(5)
    for _ in range(200):
        times = rng.integers(0, 60, size=rng.integers(1, 12))
        run = None
        for chunk in np.array_split(np.sort(times), 3):
            if len(chunk):
                run = recent_retries.latest_run(rng.permutation(chunk), run, 5)
        assert run[2] == brute_run(times.tolist(), 5) and run[1] == times.max()


def test_recent_retries_over_batches_and_the_state_they_leave(spark, tmp_path):
    day = lambda n: pd.Timestamp("2024-01-01") + pd.Timedelta(days=n)
    batches = [
        [("a", day(0)), ("a", day(1)), ("a", day(1.5)), ("b", day(1))],
        [("a", day(2)), ("c", day(2))],
        [("c", day(30))], [("c", day(31))],  # time goes on, so a and b are forgotten
        [("a", day(32))],
    ]
    folder, state = tmp_path / "in", str(tmp_path / "state")
    seen = []
    keep = lambda batch, number: seen.extend(tuple(r) for r in batch.collect())
    for rows in batches:
        frame = spark.createDataFrame([(u, t.to_pydatetime(), "error") for u, t in rows] + [("z", rows[0][1].to_pydatetime(), "crawled")], "url string, ts timestamp, outcome string")
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        source = read_files(spark, str(folder), frame.schema)
        recent_retries.track_recent_retries(source, keep, state, quiet="10 days").awaitTermination()
    assert sorted(seen) == sorted([("a", 3, "requeue"), ("b", 1, "requeue"), ("a", 4, "failed"), ("c", 1, "requeue"),
                                   ("c", 1, "requeue"), ("c", 2, "requeue"), ("a", 1, "requeue")])
    held = spark.read.format("statestore").option("path", state).option("stateVarName", "run").load()
    assert {r["key"][0]: r["value"]["n"] for r in held.collect()} == {"a": 1, "c": 2}


def test_a_compacted_log_reads_the_same(spark, tmp_path):
    log, new = str(tmp_path / "log"), str(tmp_path / "new")
    for n in range(3):
        tables.append_batch(spark.createDataFrame([doc(n, "x", float(n)), doc(9, f"version {n}", float(n))], DOCS).select(*index_sync.LOG.fieldNames()), log, n)
    folded = index_sync.current_index(tables.read_log(spark, log, index_sync.LOG))
    tables.compact(folded, new, 2)
    again = tables.read_log(spark, new, index_sync.LOG)
    assert {r.batch for r in again.collect()} == {2}
    want = sorted(tuple(r) for r in folded.collect())
    assert sorted(tuple(r) for r in index_sync.current_index(again).collect()) == want and len(want) == 4
