"""Streams against their batch twins, sources and sinks."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.functions import html
from pagemill.operators import indexing, links, outcomes, search
from pagemill.plans import corpus
from pagemill.sources import buckets, raw_html, tables
from pagemill.streaming import counters, index_sync, ingest, retry
from pagemill.streaming.sources import read_files


@pytest.fixture()
def split_pages(spark, data, tmp_path):
    """The page table cut into five files, one per micro-batch, in order."""
    raw = spark.read.parquet(f"{data}/pages.parquet")
    folder = tmp_path / "in"
    for i in range(5):
        raw.filter(F.col("page_id").between(i * 10, i * 10 + 9)).coalesce(1).write.mode("append").parquet(str(folder))
    return raw, str(folder)


def test_ingest_equals_batch_and_survives_replay(spark, split_pages, tmp_path):
    raw, folder = split_pages
    stream = lambda: read_files(spark, folder, raw.schema, files_per_batch=1)
    when = F.lit("2024-01-01").cast("timestamp")
    log = str(tmp_path / "log")
    for state in ("s1", "s2"):  # the second run replays every batch
        ingest.ingest(stream(), log, str(tmp_path / state), when, skip=html.CODE_SKIP).awaitTermination()
        written = tables.read_log(spark, log, ingest.LOG)
        assert written.select("batch").distinct().count() == 5
        distinct = corpus.distinct_pages(raw, "page_id")
        pairs = links.link_pairs(links.page_outlinks(distinct, html.CODE_SKIP)).distinct()
        want_pages = {r.url for r in distinct.collect()}
        pages = {r.url: r for r in ingest.current_pages(written).collect()}
        assert {u for u, r in pages.items() if not r.is_stub} == want_pages
        assert set(pages) == want_pages | {r.target_url for r in pairs.collect()}
        got = {tuple(r) for r in ingest.current_links(written).select("source_url", "target_url").collect()}
        assert got == {tuple(r) for r in pairs.collect()}


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    rows = spark.range(20).withColumn("word", F.lit("w"))
    rows.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("part-*")).rename(tmp_path / "events.parquet")
    for name in ("pages.parquet", "events.parquet"):
        source, seen = read_files(spark, str(tmp_path), rows.schema, name), []
        source.writeStream.foreachBatch(lambda batch, number: seen.extend(r.id for r in batch.collect())).option(
            "checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == list(range(20)), name


def test_retry_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(
        F.col("user_id").cast("string").alias("url"),
        F.when(F.col("event_type") == "error", "error").otherwise("crawled").alias("outcome"),
    )
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    source = read_files(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            assert r.failures > seen.get(r.url, (0, ""))[0]
            seen[r.url] = (r.failures, r.decision)

    retry.track_retries(source, keep, str(tmp_path / "state")).awaitTermination()
    want = {r.url: (r.failures, r.decision) for r in outcomes.retry_state(events).collect() if r.failures}
    assert seen == want


def test_window_counts_of_closed_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts")
    days = [r[0] for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = read_files(spark, str(tmp_path / "in"), events.schema)
    counters.count_windows(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.window_start.date(), r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out/batch=*")).collect()}
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(
        F.count("*").alias("n")).collect() if r.d < days[-1]}
    assert got == want


def test_index_stream_keeps_the_latest_document(spark, tmp_path):
    text = "<p>" + "Some words in a row. " * 10 + "</p>"
    schema = ("id long, url string, title string, meta_description string, domain string, language string, "
              "crawled_at timestamp, rank_score double, indexed_at timestamp, deleted_at timestamp, html string")
    rows = [[(1, "a", "old"), (2, "b", "B"), (4, "d", "fresh")], [(1, "a", "new"), (3, "c", "gone")]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "id long, url string, title string").selectExpr(
            "id", "url", "title", "'' meta_description", "'d' domain", "'en' language",
            f"timestamp_seconds({i} * 60) crawled_at", "cast(null as double) rank_score",
            "case when title = 'fresh' then timestamp_seconds(999) end indexed_at",
            "case when title = 'gone' then timestamp_seconds(0) end deleted_at", f"'{text}' html",
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    now = F.timestamp_seconds(F.lit(500))
    index_sync.sync_index(source, str(tmp_path / "log"), str(tmp_path / "state"), now).awaitTermination()
    index = {r.url: r for r in index_sync.current_index(tables.read_log(spark, str(tmp_path / "log"), index_sync.LOG)).collect()}
    assert set(index) == {"a", "b"} and index["a"].title == "new" and index["a"].rank_score == 1.0
    assert index["b"].readability_score > 0
    # Page b is deleted after it was indexed: it leaves the index and loses its mark.
    later = source.filter("url = 'b'").withColumn("deleted_at", now).withColumn("indexed_at", now)
    index_sync.sync_index(later, str(tmp_path / "log"), str(tmp_path / "more"), now, first_batch=10).awaitTermination()
    log = tables.read_log(spark, str(tmp_path / "log"), index_sync.LOG)
    assert {r.url for r in index_sync.current_index(log).collect()} == {"a"}
    marks = {r.id: r.indexed_at is not None for r in index_sync.index_marks(log).collect()}
    assert marks == {1: True, 2: False}


def test_raw_html_store(spark, tmp_path):
    pages = spark.createDataFrame([("http://a/", "<p>1</p>"), ("http://b/", "<p>é</p>")], "url string, html string")
    raw_html.write_store(pages, str(tmp_path / "store"))
    stored = {r.raw_html_path: r.html for r in raw_html.read_store(spark, str(tmp_path / "store")).collect()}
    assert stored == {r.raw_html_path: r.html for r in raw_html.store_rows(pages).collect()}
    folder = Path(tmp_path / "objects/raw_html")
    folder.mkdir(parents=True)
    for key, content in stored.items():
        (tmp_path / "objects" / key).write_text(content, encoding="utf-8")
    read = {r.raw_html_path: r.html for r in raw_html.read_objects(spark, str(tmp_path / "objects")).collect()}
    assert read == stored


def test_postings_store_prunes_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "c c", None)], "id long, title string, body_text string, meta_description string")
    rows = indexing.postings(docs)
    indexing.write_postings(rows, str(tmp_path / "p"))
    stored = tables.read_table(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
    plan = stored.filter("term = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,c)" in plan


def test_bucketed_join_needs_no_shuffle(spark):
    made = []
    a = buckets.bucketed(spark.range(100).withColumnRenamed("id", "k"), "k", 4, made)
    b = buckets.bucketed(spark.range(100).withColumnRenamed("id", "k"), "k", 4, made)
    assert len(made) == 2
    plan = a.join(b.hint("shuffle_hash"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_broadcast_only_behind_a_size_check(spark):
    big, little = spark.range(50), spark.range(5)
    plan = lambda side: big.join(search.sized(side, 10), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(little).lower() and "broadcast" not in plan(spark.range(11)).lower()


def test_shared_dir_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_every_query_has_a_statement():
    import __spark_entry__ as entry
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["url_normalize", "page_text", "page_upsert", "frontier_pop", "config_overlay"])
def test_query_matches_its_statement(spark, data, name):
    from checks.compare import connect, difference
    from checks.queries import QUERIES

    assert difference(name, QUERIES[name](spark, data), connect(data)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r.rank_score, r.url))


def test_replayed_and_shuffled_batches_are_stored_alike(spark, tmp_path):
    rows = [(i, f"http://h/{i % 5}", f"<title>t{i}</title><p>{'body ' * 30}{i}</p>") for i in range(40)]
    stores = []
    for n, order in enumerate([rows, rows[::-1]]):
        folder = tmp_path / f"in{n}"
        spark.createDataFrame(order, "page_id long, url string, html string").repartition(3).write.parquet(str(folder))
        source = read_files(spark, str(folder), spark.read.parquet(str(folder)).schema)
        ingest.ingest(source, str(tmp_path / f"log{n}"), str(tmp_path / f"state{n}"), F.timestamp_seconds(F.lit(0)), order="page_id").awaitTermination()
        stores.append(sorted(map(str, tables.read_log(spark, str(tmp_path / f"log{n}"), ingest.LOG).collect())))
    assert stores[0] == stores[1] and len(stores[0]) == 5 and "t0" in stores[0][0]


def test_retries_requeue_or_delete(spark):
    decisions = spark.createDataFrame([("a", 1, "requeue"), ("b", 2, "failed"), ("c", 0, "none")], "url string, depth int, decision string")
    visited = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    pages = visited.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    queue, left, table = corpus.apply_retries(
        spark.createDataFrame([("a", 5)], "url string, depth int"), visited, pages, decisions, F.timestamp_seconds(F.lit(1))
    )
    assert [tuple(r) for r in queue.collect()] == [("a", 1)]
    assert {r.url for r in left.collect()} == {"b", "c"}
    assert [r.url for r in table.filter("deleted_at is not null").collect()] == ["b"]
