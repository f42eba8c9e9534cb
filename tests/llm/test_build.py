"""Archive, chat format, mix, packing and the pipeline against brute force and round trips."""

import hashlib
import json
import math
import random
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import chat, common, mixing, packing, queries, warc
from pagemill.session import work_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, "r", 2) for d, t, s in rows], DOCS)


# Archive ------------------------------------------------------------------------------------------------------


def test_archive_keeps_bytes_once_and_gives_every_record_back(spark, tmp_path):
    long, other = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1200, "y" * 999
    rows = [(1, "http://a/1", long), (5, "http://a/5", long), (3, "http://a/3\r\nX: y", long), (2, "u", other), (4, "u", other),
            (6, None, None), (7, "v", ""), (8, "z", "z" * 1000), (None, "n", long), (9, "q", "p" * 2000), (9, "r", "p" * 2000)]
    df = spark.createDataFrame([(i, u, h, "no") for i, u, h in rows + rows[:2]], "page_id long, url string, html string, digest string")
    place = str(tmp_path / "archive")
    warc.write(df, place)
    assert warc.payloads(spark, place).count() == len({h or "" for _, _, h in rows})
    records = warc.read(spark, place).collect()
    assert len(records) == len(rows)
    by = {(r.id, r.url): r for r in records}
    for i, u, h in rows:
        r = by[i, (u or "").replace("\r\n", "%0D%0A")]
        body = (h or "").encode()
        assert r.payload == body and r.sha1 == hashlib.sha1(body).hexdigest()
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert len(block) == r.content_length
        assert block.endswith(body if r.type == "response" else b"\r\n\r\n")
    kinds = {(r.id, r.url): (r.type, r.refers_to) for r in records}
    assert kinds[5, "http://a/5"] == ("response", None)
    assert kinds[1, "http://a/1"] == kinds[3, "http://a/3%0D%0AX: y"] == kinds[None, "n"] == ("revisit", 5)
    assert kinds[2, "u"] == kinds[4, "u"] == kinds[8, "z"] == ("response", None)
    assert sorted([kinds[9, "q"], kinds[9, "r"]], key=str) == [("response", None), ("revisit", 9)]
    # A plain reader finds the same records in the files.
    warc.export(spark, place, str(tmp_path / "files"))
    seen = []
    for file in (tmp_path / "files").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            seen.append(head + b"\r\n\r\n" + rest[:size])
            data = rest[size + 4:]
    assert sorted(seen) == sorted(bytes(r.record) for r in records)


def test_archive_query_has_a_record_for_every_row(spark, tmp_path):
    rows = [(1, "http://a/1", "x" * 1200), (5, "http://a/5", "x" * 1200), (5, "http://a/5", "x" * 1200), (5, "http://a/5", "x" * 1200),
            (7, "http://a/7\r\n", "y" * 1500), (7, "http://a/7\n", "y" * 1500), (2, "u", "z"), (2, "u", "z"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op3_warc_archive(spark, str(tmp_path)).collect()
    want = [(1, "revisit", 5), (5, "response", None), (5, "revisit", 5), (5, "revisit", 5), (7, "response", None), (7, "revisit", 7)]
    want += [(2, "response", None)] * 2 + [(None, "response", None)] * 2
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    bodies = sorted((h or "").encode() for _, _, h in rows)
    assert sorted((r.payload_bytes, r.payload_digest) for r in got) == sorted((len(b), hashlib.sha1(b).hexdigest()) for b in bodies)
    warc.write(df, place := str(tmp_path / "archive"), repeats=True)
    heads = [r.header for r in warc.read_headers(spark, place).collect()]
    names = [h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads]
    assert len(set(names)) == len(rows) and warc.payloads(spark, place).count() == 4
    firsts = {n for n, h in zip(names, heads) if "WARC-Type: response" in h}
    assert all(h.split("WARC-Refers-To: ")[1].split("\r\n")[0] in firsts for h in heads if "WARC-Type: revisit" in h)


def test_archive_query_rebuilds_records_and_checks_their_length(spark, tmp_path, monkeypatch):
    rows = [(1, "http://é/1", "é" * 900), (2, "u", "é" * 900), (3, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in queries.op3_warc_archive(spark, str(tmp_path)).collect()}
    assert got == {i: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    heads = warc.read_headers
    longer = F.regexp_replace("header", "Content-Length: ", "Content-Length: 1")
    monkeypatch.setattr(warc, "read_headers", lambda *a: heads(*a).select("digest", longer.alias("header")).select(
        "digest", "header", *[c.alias(n) for n, c in warc.fields(F.col("header")).items()]))
    with pytest.raises(Exception, match="Content-Length"):
        queries.op3_warc_archive(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("char", list(warc.LINE_ENDS) + ["\u200b", " "])
def test_an_address_cannot_end_its_header_line(spark, char):
    rows = [(1, f"http://a/{char}X-Source-Id: 77{char}Content-Length: 5", "<p>x</p>"), (2, "http://a/ X-Source-Id: 77 Content-Length: 5", "<p>x</p>")]
    place = work_path(spark, "archive")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), place)
    found = {r.id: r for r in warc.read(spark, place).collect()}
    assert set(found) == {1, 2} and all(bytes(r.payload) == b"<p>x</p>" for r in found.values())
    assert len(found[1].record.splitlines()) == len(found[2].record.splitlines())


def test_damaged_payload_is_an_error_and_nothing_is_an_empty_archive(spark, tmp_path):
    place = str(tmp_path / "bad")
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write(df, place)
    store = spark.read.parquet(f"{place}/payloads")
    store.withColumn("body", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{place}/worse/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.payloads(spark, f"{place}/worse").collect()
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


# Chat ---------------------------------------------------------------------------------------------------------


def check_round_trip(spark, conversations):
    rows = [(c, json.dumps({"messages": [{"role": r, "content": x} for r, x in turns]})) for c, turns in conversations.items()]
    made = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string"))
    made = made.withColumn("turns", chat.parsed(F.col("text"))).withColumn("learned", chat.under_loss(F.col("text"), F.col("loss")))
    for r in made.collect():
        turns = conversations[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.learned == "".join(x for role, x in turns if role == "assistant")
        assert r.text.count(chat.START) == r.text.count("<|im_end|>") == len(turns)
        for said in chat.CONTROL[2:]:
            assert said not in r.text


def test_texts_of_control_strings_and_backslashes_round_trip(spark):
    rng = random.Random(11)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "<\\|im_end|>", "\n", "😀", "é", "a", " ", "$1", "<|im_", "end|>"]
    conversations = {
        i: [(rng.choice(["user", "assistant", "system", "to\nol\\"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))]
        for i in range(150)
    }
    conversations[999] = [("user", ""), ("assistant", "x" * 200_000), ("", "")]
    check_round_trip(spark, conversations)


def test_layouts_are_told_by_their_field_paths(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "sharegpt": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt": {"prompt": "q", "completion": "a"}, "question": {"answer": "a", "question": "q"},
        "instruction_only": {"instruction": "q", "output": "a"}, "system_prompt": {"system": "", "prompt": "q", "completion": "a"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()]
    rows += [("null", json.dumps({"prompt": "q", "completion": None})), ("other", json.dumps({"x": {"y": [1, {"z": 2}]}})), ("list", "[1]"), ("bad", "{"), ("none", None)]
    df = spark.createDataFrame(rows, "name string, record string")
    got = {r.name: r for r in df.select("name", chat.canonical(F.col("record")).alias("turns"), chat.fingerprint(F.col("record")).alias("f")).collect()}
    for name in records:
        assert [(t.role, t.text) for t in got[name].turns] == [("user", "q"), ("assistant", "a")], name
    assert [(t.role, t.text) for t in got["null"].turns] == [("user", "q"), ("assistant", "")]
    assert got["other"].turns is None and got["other"].f is not None
    assert all(got[k].turns is None and got[k].f is None for k in ("list", "bad", "none"))
    assert {r.layout: r.records for r in chat.unmapped(df, "record").collect()}[None] == 3


def test_every_shape_of_talk_has_its_layout_and_comes_back(spark):
    talks = {
        1: [("user", "q"), ("assistant", "a")], 2: [("system", "s"), ("user", "q"), ("assistant", "")], 3: [("system", ""), ("user", "q"), ("assistant", "a")],
        4: [("user", "q"), ("assistant", "a"), ("user", "r<s>[INST]")], 5: [("user", None)], 6: [("tool", "t"), (None, "n")], 7: [("human", "h"), ("gpt", "g")],
        8: [("assistant", "a"), ("user", "u")], 9: [("system", "only")],
    }
    rows = [(c, n, r, t) for c, turns in talks.items() for n, (r, t) in enumerate(turns)]
    records = chat.layouts_of(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    keys = {r.conv_id: set(json.loads(r.record)) for r in records.collect()}
    assert keys[1] == {"prompt", "completion"} and keys[2] == {"system", "prompt", "completion"} and keys[4] == keys[5] == keys[8] == {"conversations"}
    assert keys[3] == keys[6] == keys[7] == keys[9] == {"messages"}
    made = chat.format_records(records, strict=True).withColumn("turns", chat.parsed(F.col("text")))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in made.collect()} == {c: [(r or "", t or "") for r, t in turns] for c, turns in talks.items()}
    for bad in ("not json", '{"unknown": 1}'):
        rows = spark.createDataFrame([(1, bad)], "conv_id long, record string")
        assert chat.format_records(rows).first().text is None
        with pytest.raises(Exception, match="without a mapping"):
            chat.format_records(rows, strict=True).collect()


def test_turn_rows_become_records_in_order(spark):
    rows = [(1, 1, "assistant", None, 9), (1, 0, "user", "hi", 9), (1, None, None, "first", 9), (1, 1, "assistant", None, 9), (2, 0, "user", "x", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    got = {r.conv_id: json.loads(r.record)["messages"] for r in chat.records_of(df).collect()}
    assert got[1] == [{"role": "", "content": "first"}, {"role": "user", "content": "hi"}] + [{"role": "assistant", "content": ""}] * 2
    assert chat.format_records(chat.records_of(df.limit(0))).count() == 0


# Mix ----------------------------------------------------------------------------------------------------------


def fill(sizes, weights, limit=3):
    """Shares by weight; sources above their limit stop there and the excess is dealt again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > limit * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets_and_deals_every_copy_once(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(1000, None, "b"), (1001, "", "d"), (7, "same same", "a"), (7, "same same", "a"), (None, "no id", "a"), (None, "no id", "a")]
    df = docs(spark, rows)
    weights = [5.0, 2.0, 1.0]
    places = mixing.placed(mixing.rows_of(df, ["doc_id"]), weights).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes, weights)
    assert len(places) == len(rows)
    taken = {}
    for r in places:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.repeats <= 3
        taken[r.source] = taken.get(r.source, 0) + r.repeats * r["size"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    options = dict(block_words=40, shard_words=400)
    copies = mixing.mix(df, weights, **options).collect()
    assert len(copies) == sum(r.repeats for r in places)
    again = mixing.mix(df, weights, **options).collect()
    assert sorted(map(str, copies)) == sorted(map(str, again))
    assert len({r.shard for r in copies}) > 5
    assert mixing.mixed_rows(df, weights, **options).columns == df.columns


def test_blocks_of_the_mix_are_sent_to_all_tasks_only_if_few(spark, monkeypatch):
    df = docs(spark, [(i, "w " * 20, "ab"[i % 2] if i % 7 else None) for i in range(200)])
    taken = mixing.placed(mixing.rows_of(df, ["doc_id"]), [5.0, 2.0])
    seen = {}
    for most in (200_000, 3):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        copies = mixing.dealt(taken, block_words=40, shard_words=400)
        # What Spark sizes on its own is no part of this test.
        joins = [x for x in copies._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "of_block" in x]
        seen[most] = (sorted(map(tuple, copies.collect())), "strategy=broadcast" in joins[0], "strategy=merge" in joins[0])
    assert seen[200_000][0] == seen[3][0] and len(seen[3][0]) > 100
    assert seen[200_000][1:] == (True, False) and seen[3][1:] == (False, True)


def test_splitting_tree_deals_exact_quotas_without_overlap():
    quotas, shards = [100, 0, 7, 33], 9
    leaves = [mixing.leaf(quotas, shards, k, 1) for k in range(shards)]
    for s, quota in enumerate(quotas):
        assert sorted(b for leaf in leaves for b in range(leaf[s][0], leaf[s][0] + leaf[s][1])) == list(range(quota))
    totals = [sum(n for _, n in leaf) for leaf in leaves]
    assert max(totals) - min(totals) <= 4
    big = [mixing.leaf([3 * 10**9, 2 * 10**9], 2, k, 1) for k in range(2)]
    assert [sum(leaf[s][1] for leaf in big) for s in range(2)] == [3 * 10**9, 2 * 10**9]


def test_mix_carries_columns_of_maps(spark):
    rows = [(i, f"{i} word " * 30, "ab"[i % 2], {"k": i}) for i in range(40)] + [(3, "3 word " * 30, "b", {"k": 3})]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, about map<string,int>")
    mixed = mixing.mixed_rows(df, [5.0, 2.0], max_repeats=3).collect()
    assert mixed and all(r.about == {"k": r.doc_id} for r in mixed)


def test_draws_from_large_urns_have_the_same_law(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(3))
    left = mixing.draw(rng, np.array([4 * 10**9, 5 * 10**9, 7]), 10**9)
    assert left.sum() == 10**9 and (left >= 0).all() and abs(left[0] / 10**9 - 4 / 9) < 1e-3
    monkeypatch.setattr(mixing, "LARGE", 0)
    small = np.bincount([mixing.hypergeometric(rng, 6, 5, 4) for _ in range(300)], minlength=5) / 300
    want = [math.comb(6, k) * math.comb(5, 4 - k) / math.comb(11, 4) for k in range(5)]
    assert np.abs(small - want).max() < 0.1


def test_mix_of_nothing(spark):
    df = docs(spark, [(1, None, None), (2, "", "a")])
    assert [r.repeats for r in mixing.placed(mixing.rows_of(df, ["doc_id"]), [1.0]).collect()] == [0, 0]
    assert mixing.mix(df, [1.0]).count() == 0 and mixing.mixed_rows(df.limit(0), [1.0]).count() == 0


# Packing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_bins_obey_every_capacity(score):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 500)
    capacity = packing.Capacity(tokens=100, documents=4, attention=5000)
    lengths = lengths[lengths**2 <= 5000]
    bins, offsets = packing.best_fit(lengths, capacity, score=score)
    for b in np.unique(bins):
        inside = lengths[bins == b]
        assert inside.sum() <= 100 and len(inside) <= 4 and (inside**2).sum() <= 5000
        order = np.argsort(offsets[bins == b])
        assert (np.concatenate([[0], np.cumsum(inside[order])[:-1]]) == offsets[bins == b][order]).all()
    plain, _ = packing.best_fit(lengths, packing.Capacity(100, 100, 10_000), score=score)
    assert len(np.unique(plain)) <= 1.03 * lengths.sum() / 100 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), capacity)


def test_ids_are_the_vocabulary_files(spark):
    from tokenizers import Tokenizer

    rng, encoder = random.Random(13), queries.byte_encoder()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["é", "ß", "the", " ", "  ", "\n", "\t", "'s", "123", "😀", " ", " ", "<|endoftext|>", "x" * 50, "\x00", "̈", "漢字", "!!", "İ", "퟿"]
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert encoder.ids(text) == whole.encode(text, add_special_tokens=False).ids, text
    long = " ".join(rng.choices(["ab", "cde ", "\n", "é", "word"], k=4000))
    assert "".join(packing.parts(long, 100)) == long
    joined = [i for p in packing.parts(long, 100) for i in encoder.ids(p)]
    assert joined == whole.encode(long, add_special_tokens=False).ids


def check_packed(rows, texts, capacity=1024):
    encoder, sequences, pieces = queries.byte_encoder(), {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.row), {}).setdefault(r.piece, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for (doc, _), own in pieces.items():
        at, ids = 0, None
        for n in range(len(own)):
            r = own[n][0]
            ids = next(i for i in ([*encoder.ids(t or ""), 2] for t in texts[doc]) if len(i) >= at + r.length) if ids is None else ids
            assert r.start == at and r.length <= capacity and (n == 0 or r.length == capacity)
            at += r.length
    return len(sequences)


def test_documents_are_packed_whole(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gam", "é"], k=rng.choice([1, 30, 300, 1500, 2500]))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (5, rows[5][1], "s"), (None, "no id", "s")]
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t)
    got = packing.pack_documents(docs(spark, rows), queries.byte_encoder(), group_pieces=32).collect()
    n = check_packed(got, texts)
    encoder = queries.byte_encoder()
    ids = [[*encoder.ids(t or ""), 2] for _, t, _ in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    assert n <= 1.1 * sum(map(len, ids)) / 1024 + 2
    crcs = sorted(zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in ids if len(x) <= 1024)
    assert crcs == sorted(r.ids_crc32 for r in got if r.piece == 0 and r.length < 1024 and (r.doc_id, r.row) not in
                          {(q.doc_id, q.row) for q in got if q.piece > 0})
    assert packing.pack_documents(docs(spark, rows).limit(0), encoder).count() == 0


# Pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages_follow_each_other(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    rows, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, data)
        seen.append((name, out.count()))
        if name != "packed":
            assert out.columns == documents.columns
            rows = out
    counts = dict(seen)
    assert documents.count() >= counts["quality_rules"] >= counts["near_duplicates"] == counts["personal_data"]
    assert counts["source_mix"] > 0 and counts["packed"] >= counts["source_mix"]
    ran = corpus_pipeline.run(spark, data)
    assert ran.count() == counts["packed"]
    texts = {}
    for r in rows.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    check_packed(ran.collect(), texts)


def test_pipeline_of_odd_documents(spark, tmp_path):
    rows = [(1, None, None), (2, "", "a"), (3, "only a few words", "a"), (None, " ".join(f"w{i}" for i in range(40)), None)]
    folder = tmp_path / "odd"
    docs(spark, rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert [r.doc_id for r in got] == [None] and Path(folder).exists()


def test_every_operator_has_one_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


def test_texts_reach_python_in_small_batches(spark):
    before = spark.conf.get(common.BATCH)
    rows = spark.range(0, 6000, 1, 1).withColumn("text", F.repeat(F.lit("word "), 400 + F.col("id").cast("int") % 2))
    rows = rows.unionByName(spark.range(-1, 0, 1, 1).withColumn("text", F.repeat(F.lit("word "), 1_000_000))).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(map(len, batch.column("text").to_pylist()))], "rows": [batch.num_rows]})

    @F.pandas_udf("long")
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.str.len() * 0 + int(batch.str.len().sum())

    whole = {r[0]: r[1] for r in rows.select("id", F.length("text")).collect()}
    mapped = common.stored(rows.mapInArrow(sizes, "n long, rows long"), "sizes").collect()
    assert sum(r.rows for r in mapped) == 6001 and sum(r.n for r in mapped) == sum(whole.values())
    most = common.BATCH_BYTES + 4096
    assert all(r.n <= most or r.n <= most + whole[-1] for r in mapped) and sum(r.n > most for r in mapped) <= 1
    asked = {r.id: r.n for r in common.stored(rows.select("id", total("text").alias("n")), "totals").collect()}
    assert asked.keys() == whole.keys() and asked[0] <= most
    assert spark.conf.get(common.BATCH) == before


def test_pipeline_hands_no_text_to_python_later(spark, data):
    """What a stage leaves to its caller's job, with the caller's batches, holds no Python step on texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plan = stage(spark, docs, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "masked" not in plan and "ArrowEvalPython" not in plan, name
