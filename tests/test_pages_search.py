"""The page table, the index and search on hand-made rows."""

import datetime as dt
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import html
from pagemill.operators import indexing, language, outcomes, pages, search, stats
from pagemill.operators import pages as page_table
from pagemill.plans import corpus
from pagemill.sources import tables

T0 = dt.datetime(2024, 1, 1)


def write(url, title, seq, stub=False, depth=1):
    when = T0 + dt.timedelta(days=seq)
    return (url, None if stub else title, f"meta {seq}", "h", -1 if stub else depth, None if stub else f"body {seq}",
            None if stub else f"raw {seq}", None if stub else "en", None if stub else 6, when, stub, seq)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PAGE_WRITES)


def empty(spark):
    return spark.createDataFrame([], schemas.PAGES)


def by_url(frame):
    return {r.url: r for r in frame.collect()}


def test_upsert_rules(spark):
    first = pages.upsert(empty(spark), table(spark, write("a", "A1", 1), write("s", None, 1, stub=True), write("a", "A2", 2)))
    rows = by_url(first)
    assert rows["a"].title == "A2" and rows["a"].meta_description == "meta 1" and rows["a"].raw_html_path == "raw 1"
    assert rows["a"].crawled_at == T0 + dt.timedelta(days=2) and rows["a"].rank_score == 1.0
    assert rows["s"].depth == -1 and rows["s"].title is None
    deleted = pages.soft_delete(first, spark.createDataFrame([("a",)], "url string"), F.lit("2024-03-01").cast("timestamp"))
    # The stub is crawled, a deleted page is crawled again, a known page is seen as a link.
    after = by_url(pages.upsert(deleted, table(spark, write("s", "S", 3), write("a", "A3", 4), write("n", "N", 5),
                                               write("a", None, 6, stub=True))))
    assert after["s"].title == "S" and after["s"].depth == -1 and after["s"].raw_html_path is None
    assert after["a"].title == "A3" and after["a"].deleted_at is not None and after["a"].id == rows["a"].id
    assert after["n"].id == 3
    promoted = by_url(pages.upsert(deleted, table(spark, write("s", "S", 3)), promote_stubs=True))
    assert promoted["s"].depth == 1 and promoted["s"].raw_html_path == "raw 3"


def test_upsert_twice_is_upsert_once(spark):
    batch = table(spark, write("a", "A", 1), write("b", "B", 2), write("b", None, 3, stub=True))
    once = pages.upsert(empty(spark), batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, pages.upsert(once, batch).collect()))


def test_index_and_cleanup_cycles(spark):
    rows = [write("a", "A", 1), write("b", "B", 2), write("s", None, 3, stub=True)]
    loaded = pages.upsert(empty(spark), table(spark, *rows))
    text = "<p>" + "A sentence that is long enough. " * 5 + "</p>"
    raw = spark.createDataFrame([("raw 1", text), ("raw 9", "x")], "raw_html_path string, html string")
    now = F.lit("2024-02-01").cast("timestamp")
    none = spark.createDataFrame([], schemas.INDEX_DOCUMENTS)
    after, index = corpus.index_cycle(loaded, raw, none, now)
    docs, marked = by_url(index), by_url(after)
    assert set(docs) == {"a", "b", "s"} and docs["a"].body_text.startswith("A sentence") and docs["b"].body_text == ""
    assert docs["a"].crawled_at == 1704153600.0 and docs["s"].rank_score == 1.0
    assert all(r.indexed_at for r in marked.values())
    assert marked["a"].readability_score > 0 and marked["b"].readability_score == 0.0
    again, same = corpus.index_cycle(after, raw, index, now)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, index.collect()))
    gone = pages.soft_delete(after, spark.createDataFrame([("b",), ("b",)], "url string"), now)
    cleaned, left = corpus.cleanup_cycle(gone, index)
    assert set(by_url(left)) == {"a", "s"} and by_url(cleaned)["b"].indexed_at is None
    assert indexing.queue_depth(cleaned).first()[0] == 1 and indexing.pending(cleaned).count() == 0


DOCS = [
    (1, "http://d/1", "red apple", "The apple was green. A banana fell.", "sweet fruit", "d", "en", 0.5),
    (2, "http://d/2", "fruit", "banana and apples; then a banana <split> & apple pie", "", "d", "en", 0.9),
    (3, "http://e/3", "", "Äpfel und bananna", "apple", "e", "de", 0.1),
    (4, "http://e/4", "", "nothing here", "only meta", "e", "fr", 0.2),
    (5, "http://e/5", "", "", "an apple alone", "e", "fr", 0.3),
]


def answers(spark, *queries, top_k=20):
    docs = spark.createDataFrame(
        DOCS, "id long, url string, title string, body_text string, meta_description string, domain string, "
              "language string, rank_score double")
    table_ = spark.createDataFrame(list(queries), "qid long, q string, domain string, language string")
    posts = indexing.postings(docs)
    found, matches = search.match_documents(table_, posts, docs)
    ranked = search.rank(table_, found, matches, posts, top_k)
    return docs, found, matches, ranked


def index_docs(spark, n):
    """``n`` documents of one body, each word twice."""
    return spark.range(n).select(
        "id", F.concat(F.lit("http://d/"), F.col("id").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"),
        F.lit("one two three four five one two three four five").alias("body_text"), F.lit(None).cast("string").alias("meta_description"),
        F.lit("d").alias("domain"), F.lit("en").alias("language"), F.lit(1.0).alias("rank_score"),
    )


def test_search_order_filters_and_limits(spark):
    docs, found, matches, ranked = answers(
        spark, (1, "apple banana", None, None), (7, "banana apple", None, None), (2, "apple", None, "de"), (3, "apple", "d", "en"), (4, "", None, None),
        (5, "zzz", None, None), (6, "appel", None, None),
    )
    order = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.qid, r.place)):
        order.setdefault(r.qid, []).append(r.id)
    # Both words found exactly, the nearer pair (2 words apart, then 4) first; a pair with an error; one word.
    assert order[1] == [2, 1, 3, 5]
    # The last word is dropped first, so a document without the first one is no answer.
    assert order[7] == [2, 1, 3]
    assert order[2] == [3] and order[3] == [1, 2]
    assert 4 not in order and 5 not in order
    # "apfel" is one letter from "appel", and "apple" one swap.
    assert order[6] == [1, 2, 3, 5]
    row = {(r.qid, r.id): r for r in ranked.collect()}
    assert (row[1, 2].words, row[1, 2].typos, row[1, 2].proximity, row[1, 2].attribute) == (2, 0, 2, 1)
    assert (row[1, 1].proximity, row[1, 1].attribute) == (4, 0)


def test_facets_snippets_and_display(spark):
    docs, found, matches, ranked = answers(spark, (1, "apple banana", None, None))
    maps = search.facet_maps(search.facets(matches)).first()
    assert maps.domain == {"d": 2, "e": 2} and maps.language == {"en": 2, "de": 1, "fr": 1}
    rows = by_url(search.results(ranked, found, docs))
    assert rows["http://d/2"].snippet == (
        "<b>banana</b> and <b>apples</b>; then a <b>banana</b> &lt;split&gt; &amp; <b>apple</b> pie")
    assert rows["http://e/5"].snippet == "an apple alone"
    shown = by_url(search.display(search.results(ranked, found, docs)))
    assert shown["http://e/3"].heading == "http://e/3" and shown["http://d/2"].heading == "fruit"


def test_a_facet_map_has_every_value(spark):
    n = 100_001
    counts = spark.range(n).select(
        F.lit(1).cast("long").alias("qid"), F.lit("domain").alias("facet"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("value"),
        (F.col("id") + 1).alias("n"),
    ).union(spark.createDataFrame([(1, "language", "en", 7), (2, "language", "de", 3)], "qid long, facet string, value string, n long"))
    rows = search.facet_maps(counts).select(
        "qid", F.size("domain").alias("size"), F.element_at("domain", f"d{n - 1}").alias("last"),
        F.aggregate(F.map_values("domain"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "language",
    )
    found = {r.qid: r for r in rows.collect()}
    assert (found[1]["size"], found[1]["last"], found[1]["total"], found[1]["language"]) == (n, n, n * (n + 1) // 2, {"en": 7})
    assert found[2]["total"] is None and found[2]["language"] == {"de": 3} and len(found) == 2


def test_long_queries_are_answered_from_their_first_words(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    texts = {i: rng.sample(words, rng.randint(1, 20)) for i in range(200)}
    docs = spark.createDataFrame(
        [(i, f"http://d/{i:03}", "", " ".join(t), "", "d" if i % 2 else "e", "en", 0.5) for i, t in texts.items()],
        "id long, url string, title string, body_text string, meta_description string, domain string, language string, rank_score double")
    asked = {q: rng.sample(words, n) for q, n in enumerate([1, 3, 4, 5, 9, 18, 20])}
    queries = spark.createDataFrame([(q, " ".join(w), "d" if q == 4 else None, None) for q, w in asked.items()],
                                    "qid long, q string, domain string, language string")
    _, matches = search.match_documents(queries, indexing.postings(docs), docs, typos=False, top_k=7)
    got = {}
    for r in matches.collect():
        got.setdefault(r.qid, {})[r.id] = r.words
    for q, wanted in asked.items():
        runs = {i: next((n for n, w in enumerate(wanted) if w not in t), len(wanted)) for i, t in texts.items() if q != 4 or i % 2}
        level = next((n for n in range(len(wanted), 0, -1) if sum(r >= n for r in runs.values()) >= 7), 1)
        assert got[q] == {i: r for i, r in runs.items() if r >= level}, q


def test_a_search_sends_its_terms_to_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i:04}", "", None) for i in range(500)], "id long, title string, body_text string, meta_description string")
    indexing.write_postings(indexing.postings(docs), str(tmp_path / "p"))
    store = tables.read_table(spark, str(tmp_path / "p"))
    few = search.of_terms(store, spark.createDataFrame([("w0003",), ("w0004",)], "term string"))
    assert "PushedFilters: [In(term, [w0003,w0004])" in few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 2
    many = search.of_terms(store, store.select("term"), limit=10)
    assert many.count() == 500


def test_words_of_many_queries_and_many_terms_meet_a_document_once(spark):
    docs = spark.createDataFrame(
        [(i, f"u{i}", "", " ".join(f"abc{n}" for n in range(i + 1)) + " end", "", "d", "en", 0.5) for i in range(30)],
        "id long, url string, title string, body_text string, meta_description string, domain string, language string, rank_score double")
    queries = spark.createDataFrame([(q, "end abc", None, None) for q in range(10)], "qid long, q string, domain string, language string")
    posts = indexing.postings(docs)
    found, matches = search.match_documents(queries, posts, docs, prefix=True)
    asked = found.filter("word = 'abc*'")
    meant = asked.select("word", "term").distinct()
    assert meant.count() == 30 and asked.count() == 300
    # A posting is one row, though ten queries ask for its word.
    assert search._word_hits(posts, meant).count() == posts.filter("term like 'abc%'").count()
    ranked = search.rank(queries, found, matches, posts).collect()
    assert {(r.qid, r.words, r.proximity) for r in ranked} == {(q, 2, 1) for q in range(10)}


def test_proximity_deals_two_numbers_a_hit_and_is_the_smallest_distance(spark):
    rng = random.Random(8)
    words = ["one", "two", "three", "four", "tw"]
    texts = {i: [[rng.choice([*words, "x", "y", "z", "twig"]) for _ in range(rng.randint(0, 40))] for _ in range(2)] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t), " ".join(b), None) for i, (t, b) in texts.items()],
                                 "id long, title string, body_text string, meta_description string")
    # A query's id may come again with other words; "tw" has a longer term, and one term may answer two words.
    asked = {1: [["one"], ["two"], ["three"]], 2: [["one", "four"], ["two"]], 3: [["four"]], 4: [["tw"], ["two"], ["one"], ["three"], ["four"]]}
    answers = spark.createDataFrame(
        [(q, s, w, t) for q, slots in asked.items() for s, group in enumerate(slots) for w in group for t in ([w, "two", "twig"] if w == "tw" else [w])],
        "qid long, slot int, word string, term string")
    level = {(q, i): rng.randint(1, len(slots)) for q, slots in asked.items() for i in texts if rng.random() < 0.8}
    candidates = spark.createDataFrame([(q, i, n) for (q, i), n in level.items()] * 2, "qid long, id long, words long")
    found = search._proximity(candidates, answers, indexing.postings(docs))
    got = {(r.qid, r.id): r.saved for r in found.collect()}
    want = {}
    for (q, i), n in level.items():
        at = [{(f, p) for f in range(2) for p, x in enumerate(texts[i][f]) if x in group or (x in ("two", "twig") and "tw" in group)} for group in asked[q][:n]]
        want[q, i] = sum(min([8, *(abs(a - b) for f, a in one for g, b in other if f == g)]) - 8 for one, other in zip(at, at[1:]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and len(set(want.values())) > 8
    assert len(got) == len(set(got)) == found.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    moved = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert len(moved) == 2 and "Window" not in plan and "pos" not in plan.split("RepartitionByExpression")[0]


def test_tasks_of_a_search_grow_with_its_hits(spark, monkeypatch):
    # Every document has the five words twice: 1,200 hits of the first four, 300 of the fifth.
    docs = index_docs(spark, 150)
    queries = spark.createDataFrame([(1, "one two three four five", None, None)], "qid long, q string, domain string, language string")
    seen, held = [], search._held

    def watched(*args):
        out = held(*args)
        plan = out._jdf.queryExecution().executedPlan().toString()
        seen.append({n for n in (60, 15) if f", {n})" in plan or f", {n}), REPARTITION_BY_NUM" in plan})
        return out

    monkeypatch.setattr(search, "TASK_HITS", 20)
    monkeypatch.setattr(search, "_held", watched)
    for typos in (True, False):
        _, matches = search.match_documents(queries, indexing.postings(docs), docs, typos=typos)
        assert {(r.id, r.words) for r in matches.collect()} == {(i, 5) for i in range(150)}
    assert seen == [{60}, {15}] * 2


def test_far_words_are_not_put_through_their_swaps(spark):
    # The swaps of a word are made for a term that is two replaced letters away, as one swap is, or may be two errors with a swap.
    condition = search.typo_distance(F.col("w"), F.col("t"), 2)._jc.toString()
    first_swap = condition.index("array_contains")
    assert re.search(r"=\(x_\d+, 2\)", condition[first_swap - 120:first_swap]), condition[:first_swap]


def test_crop(spark):
    body = " ".join(f"w{i}" for i in range(400))
    crop = lambda *terms: spark.range(1).select(
        search.snippet(F.lit(body), F.array(*[F.lit(t) for t in terms]))).first()[0]
    assert crop("w200").startswith("…w125 ") and "<b>w200</b>" in crop("w200") and crop("w200").endswith("w274…")
    assert crop("none").startswith("w0 w1 ") and crop("none").endswith("w149…")
    assert crop("w399").startswith("…w250 ") and crop("w399").endswith("<b>w399</b>")


def edit_distance(a, b):
    """Damerau's distance with any edits between, by its recurrence over last equal letters."""
    last, far = {}, len(a) + len(b)
    d = {(-1, j): far for j in range(-1, len(b) + 1)} | {(i, -1): far for i in range(-1, len(a) + 1)}
    d |= {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            row, column = last.get(y, 0), seen
            seen = j if x == y else seen
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1,
                          d[row - 1, column - 1] + (i - row - 1) + 1 + (j - column - 1))
        last[x] = i
    return d[len(a), len(b)]


def test_a_swap_is_one_error(spark):
    pairs = [("abcde", "abdce", 1), ("abcdefghi", "bacdefgih", 2), ("abcdefghi", "abcedfgh", 2), ("axbcdefgh", "bacdefgh", 2), ("abcdefghi", "badcfeghi", None)]
    frame = spark.createDataFrame(pairs, "a string, b string, n int")
    assert all(r.got == r.n for r in frame.withColumn("got", search.typo_distance(F.col("a"), F.col("b"), 2)).collect())


def test_typo_join_misses_nothing(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abé") for _ in range(random.randint(1, 13)))
    vocabulary = sorted({word() for _ in range(500)})
    words = {random.choice(vocabulary) for _ in range(40)} | {word() for _ in range(20)}
    for _ in range(3):  # and words of the vocabulary with neighbours swapped once or twice, wherever pieces are cut
        for w in sorted(words):
            i = random.randrange(len(w))
            words.add(w[:i] + w[i:i + 2][::-1] + w[i + 2:])
    words = sorted(words)
    frame = lambda v, name: spark.createDataFrame([(x,) for x in v], f"{name} string")
    got = {tuple(r) for r in search.match_terms(frame(words, "word"), frame(vocabulary, "term")).collect()}
    budget = lambda w: 2 if len(w) >= 9 else 1 if len(w) >= 5 else 0
    want = {(w, t, edit_distance(w, t)) for w in words for t in vocabulary if edit_distance(w, t) <= budget(w)}
    assert got == want


def test_outcomes_and_retries(spark):
    rows = [(True, 200, "text/html; x"), (False, None, None), (True, 503, None), (True, None, None), (True, 404, "text/html"),
            (True, 200, "image/png"), (True, 200, None)]
    frame = spark.createDataFrame(rows, "a boolean, s int, c string")
    got = [r[0] for r in frame.select(outcomes.fetch_outcome(F.col("a"), F.col("s"), F.col("c"))).collect()]
    assert got == ["crawled", "skipped", "error", "error", "dropped", "dropped", "dropped"]
    log = [("a", "error")] * 3 + [("b", "error")] * 2 + [("b", "crawled")] + [("b", "error")] * 2 + [("c", "crawled")]
    state = by_url(outcomes.retry_state(spark.createDataFrame(log, "url string, outcome string")))
    assert {u: r.decision for u, r in state.items()} == {"a": "requeue", "b": "failed", "c": "none"}


def test_histogram(spark):
    frame = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (5000.0,), (None,)], "v double")
    got = {r.le: r.n for r in stats.histogram(frame, "v").collect()}
    assert got[0.0] == 1 and got[10.0] == 3 and got[1000.0] == 3 and got[float("inf")] == 4


def test_language_accuracy_on_pages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.train(docs.select("text", F.col("lang").alias("language")))
    raw = spark.read.parquet(f"{data}/pages.parquet")
    texts = raw.select("page_id", html.visible_text(F.col("html")).alias("text"))
    declared = raw.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("declared"))
    both = language.identify(texts, "page_id", model).join(declared, "page_id").filter("declared != ''").collect()
    assert len(both) > 20 and sum(r.language == r.declared for r in both) / len(both) >= 0.9
    short = spark.createDataFrame([(1, "too short"), (2, "1234567890 " * 10)], "page_id long, text string")
    assert {r.language for r in language.identify(short, "page_id", model).collect()} == {"unknown"}


LANGUAGE_DOCS = [
    ("el", "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3, \u03a3 x\u03a3y"), ("tr", "\u0130stanbul\u0130 I ab1cd_ef"), ("zh", "\u4e2d\u6587\u5b57 \u4e2d\U00020000\u6587"),
    ("en", "The cat, the CAT; it's"), ("en", ""), ("en", None), (None, "the cat"), ("tr", "ab\ncd\tef\u0301g"), ("de", "Stra\u00dfe \u00c4\u00d6\u00dc"),
] + [("zh", "".join(map(chr, range(0x4E00, 0x4E00 + 600))))]


def trigrams_of(text):
    words = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower()).split()
    return Counter(f" {w} "[i:i + 3] for w in words for i in range(len(w)))


def test_language_trigrams_are_counted_where_the_text_is_read(spark):
    docs = spark.createDataFrame(LANGUAGE_DOCS, "language string, text string")
    want = Counter()
    for lang, text in LANGUAGE_DOCS:
        want.update({(lang, gram): n for gram, n in trigrams_of(text or "").items()})
    got = language._grams(docs, "language").groupBy("language", "gram").sum("n").collect()
    assert {(r[0], r[1]): r[2] for r in got} == want
    # A task sends trigrams, not words: a thousand texts of the same words make as many rows as one.
    many = spark.range(1000).coalesce(1).select(F.lit("en").alias("language"), F.lit("one two three two one").alias("text"))
    assert language._grams(many, "language").count() == len(trigrams_of("one two three"))


def test_language_of_repeated_null_and_short_texts(spark, monkeypatch):
    docs = spark.createDataFrame(LANGUAGE_DOCS, "language string, text string")
    model = language.train(docs)
    languages = [r.language for r in model[1].orderBy("language").collect()]
    floors = {r.language: r.floor for r in model[1].collect()}
    weights = {(r.language, r.gram): r.weight for r in model[0].collect()}
    known = {gram for _, gram in weights}
    rows = [(1, "The cat " * 9), (2, "the cat"), (2, "Stra\u00dfe " * 9), (2, None), (3, None), (None, "The cat " * 9), (4, "\u4e2d\u6587 " * 20),
            (5, "\u03a3\u0391\u03a3 " * 20), (6, "qqq " * 30), (7, "123 " * 30), (8, "\u0130stanbul \U00020000" * 9), (8, "\u0130stanbul \U00020000" * 9)]

    def wanted(key, text):
        grams = Counter()
        for k, t in rows:
            if k == key and key is not None and t and len(t) > language.MIN_CHARS:
                grams.update(trigrams_of(t))
        if not any(g in known for g in grams):
            return "unknown"
        if text is None:
            return languages[0] or "unknown"
        letters = sum(trigrams_of(text).values())
        sums = [(-(sum(weights.get((lang, g), 0) * n for g, n in grams.items()) + letters * floors[lang]), i) for i, lang in enumerate(languages)]
        return languages[min(sums)[1]] or "unknown"

    texts = spark.createDataFrame(rows, "id long, text string")
    want = sorted([(key or 0, wanted(key, text)) for key, text in rows])
    assert len({lang for _, lang in want}) >= 4
    assert sorted((r.id or 0, r.language) for r in language.identify(texts, "id", model).collect()) == want
    # A model that is too large to be sent is joined, with the same result.
    monkeypatch.setattr(language, "small", lambda df: False)
    assert sorted((r.id or 0, r.language) for r in language.identify(texts, "id", model).collect()) == want


def test_language_blocks_and_large_alphabets(monkeypatch):
    texts = ["ab cd", "", "\u4e2d\u6587 ab", "x" * 50, None, "cd"]
    bounds = [ord("a"), ord("z") + 1, 0x4E00, 0x9FFD]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, None, 2, 3]), pa.array(texts), pa.array([True] * 6)], names=["id", "text", "counts"])
    grams, weights = [" ab", "cd ", " \u4e2d\u6587"], np.array([[0, 5, 7, 11], [0, 1, 0, 2]])

    def both():
        counted = Counter()
        for part in language._counter("id", bounds)(iter([batch])):
            for row in part.to_pylist():
                counted[row["id"], row["gram"]] += row["n"]
        scored = [r for part in language._scorer("id", grams, weights, ["w0", "w1"], bounds)(iter([batch])) for r in part.to_pylist()]
        return counted, scored

    counted, scored = both()
    assert counted[1, " ab"] == 1 and counted[2, "\u4e2d\u6587 "] == 1 and counted[None, "xxx"] == 48 and counted[3, "cd "] == 1
    assert [(r["letters"], r["matched"], r["w0"], r["w1"]) for r in scored] == [
        (4, 2, 12, 1), (0, 0, 0, 0), (4, 2, 16, 3), (50, 0, 0, 0), (None, 0, 0, 0), (2, 1, 7, 0)]
    monkeypatch.setattr(language, "BLOCK_CHARS", 8)
    assert both() == (counted, scored)
    monkeypatch.setattr(language, "MAX_CELLS", 0)
    assert both() == (counted, scored)


def test_term_vectors(spark):
    docs = spark.createDataFrame([(1, "The cats", "sat on cats, sitting")], "id long, title string, body string")
    got = {r.term: r.positions for r in indexing.term_vectors(docs, "id").collect()}
    assert got == {"cat": [2, 5], "sat": [3], "sit": [6]}


def exchanged(frame, column):
    """Whether a shuffle of the plan carries ``column``."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and column in line]


def test_term_vectors_do_not_shuffle_words(spark, monkeypatch):
    # Rows of one key are one document's; with one frequent word the others are stemmed where they stand.
    monkeypatch.setattr(indexing, "FREQUENT_WORDS", 1)
    rows = [(1, "running dogs", "dogs ran and runs"), (2, None, "dogs"), (1, "runs", None), (None, "flies", "flying")]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    vectors = indexing.term_vectors(docs, "id")
    assert sorted((r.id or 0, r.term, r.positions) for r in vectors.collect()) == [
        (0, "fli", [1]), (0, "fly", [2]), (1, "dog", [2, 3]), (1, "ran", [4]), (1, "run", [1, 1, 6]), (2, "dog", [1]),
    ]
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1, final  # the texts, by key


def test_a_small_batch_leaves_the_large_side_where_it_is(spark, tmp_path):
    names = schemas.PAGES.fieldNames()
    given = {"id": F.col("id"), "url": F.concat(F.lit("u"), F.col("id")), "domain": F.lit("d"), "depth": F.lit(0), "body_text": F.lit("big")}
    pages = spark.range(1000).select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGES
    ])
    path = str(tmp_path / "pages")
    pages.write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.read.schema(schemas.PAGES).parquet(path)
        few = spark.createDataFrame([(1, "u1"), (2, "u2")], "id long, url string")
        write = {"url": F.col("url"), "title": F.lit("new"), "body_text": F.lit("new"), "is_stub": F.lit(False), "seq": F.lit(1),
                 "depth": F.lit(0), "crawled_at": F.lit("2024-01-01")}
        more = few.select("url").union(spark.createDataFrame([("fresh",)], "url string"))
        writes = more.select(*[write.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGE_WRITES])
        results = {
            "delete": page_table.soft_delete(pages, few, F.lit("2024-01-01").cast("timestamp")),
            "mark": page_table.set_index_mark(pages, few, F.lit("2024-01-01").cast("timestamp")),
            "values": page_table.set_columns_by_id(pages, few.withColumn("title", F.lit("t")), ["title"]),
            "documents": indexing.delete_documents(indexing.documents(pages), few),
            "upsert": page_table.upsert(pages, writes),
        }
        for name, frame in results.items():
            assert not exchanged(frame, "rank_score") and "SortMergeJoin" not in frame._jdf.queryExecution().executedPlan().toString() or name == "upsert", name
        assert results["upsert"].count() == 1001
        assert results["upsert"].filter("title = 'new'").count() == 3
        assert results["delete"].filter("deleted_at is not null").count() == 2
        assert results["documents"].count() == 998 and results["values"].filter("title = 't'").count() == 2
        assert set(results["values"].columns) == set(names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_pending_page_is_indexed(spark):
    rows = [(i, f"u{i}") for i in range(2500)]
    given = {"id": F.col("i"), "url": F.col("u"), "domain": F.lit("d"), "depth": F.lit(0), "raw_html_path": F.col("u")}
    pages = spark.createDataFrame(rows, "i long, u string").select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGES
    ])
    html = spark.createDataFrame([("u1", "<p>" + "text " * 40 + "</p>")], "raw_html_path string, html string")
    after, index = corpus.index_cycle(pages, html, spark.createDataFrame([], schemas.INDEX_DOCUMENTS), F.lit("2024-01-01").cast("timestamp"))
    assert index.count() == 2500 and after.filter("indexed_at is null").count() == 0
    after, index = corpus.index_cycle(pages, html, spark.createDataFrame([], schemas.INDEX_DOCUMENTS), F.lit("2024-01-01").cast("timestamp"), 10)
    assert index.count() == 10
