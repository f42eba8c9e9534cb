"""Quality rules, toxicity, personal data and duplicate passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import pii, quality, substring, toxicity

ODD = [None, "", " \n\t ", "one", "a b c d e " * 30, "x" * 100_000, "é ß z #$ | ! A\nA\nb\nb\n\nb", "q w e r t y u i o p " * 2]


def docs(spark, texts, more=()):
    rows = [(i, t, "s", 5, True) for i, t in enumerate(texts)] + list(more)
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int, kept boolean")


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n, again = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            again.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choices("abcdef", k=rng.randint(0, 60))) for _ in range(60)]
    got = {r.doc.doc_id: r for r in quality.measure(docs(spark, texts)).select("*", quality.base_failed().alias("failed")).collect()}
    for i, text in enumerate(texts):
        r, want = got[i], counts_of(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def prose(rng, n, mark=""):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) + mark for _ in range(n)).capitalize()


def test_quality_rules_reject_junk_and_keep_clean_documents(spark):
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(120)] + [prose(rng, 60, "$$$") for _ in range(40)] + [prose(rng, 60).upper() for _ in range(40)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 200, 2)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    result, rules = quality.judged(df, labels, ["doc_id"])
    kept = {r.doc.doc_id for r in result.filter("kept").collect()}
    assert kept == set(range(120)), str(rules)
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns and out.count() == 120


def test_quality_without_labels_is_the_base_rule(spark):
    df, none = docs(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    result, rules = quality.judged(df, none, ["doc_id"])
    assert rules.rules == []
    assert {r.doc.doc_id for r in result.filter("kept").collect()} == {
        i for i, t in enumerate(ODD) if counts_of(t)[0] >= 10 and 100 * counts_of(t)[4] <= 20 * counts_of(t)[0]
    }
    assert quality.keep_good(df.limit(0), none).count() == 0


def test_rules_read_as_ordered_conditions():
    c = quality.Condition("upper_share", True, 0.5)
    assert str(quality.RuleList([[c]])) == "reject if upper_share >= 0.5\nelse keep"


def test_quality_plan_has_no_python(spark):
    plan = quality.measure(docs(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Personal data ------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_fixed_patterns_match_the_plain_expressions():
    rng = random.Random(6)
    parts = ["a@b.c", "@", "+", "1", "22.", "4111111111111111", " ", "-", "(", ")", ".", "x", "é", "a.b%", "@b", ".c", "+1 (555) 123-4567", "1.2.3.4",
             "256.1.1.1", "0001.2.3.4", "\n", "5555 5555 5555 4444", "_", "12"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_patterns_are_fast_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "a.b" * 100_000 + "@", "+1 " + " " * 200_000, "1." * 50_000, "1 " * 100_000):
        pii.base_spans(text)


def test_learned_spans_are_added_and_fixed_ones_stay(spark):
    rng = random.Random(7)
    texts = []
    for i in range(60):
        words = prose(rng, 12).split()
        words.insert(4, rng.choice(["+1 (555) 123-4567", "4111111111111111", "joe.doe@mail.example.com", "10.20.30.40"]))
        words.insert(9, rng.choice(["12", "version 4.0", "no"]))
        texts.append(" ".join(words))
    odd = [None, "", "call (555) 123-4567 now", "é 4111.1111.1111.1111 x", "nothing here", "é 4111111111111112 x 4111-1111-1111-1113"]
    df = docs(spark, texts + odd)
    found = {r.doc.doc_id: r for r in pii.find(df).collect()}
    for i, text in enumerate(texts + odd):
        base = [(s.start, s.end, s.kind) for s in found[i].base]
        spans = [(s.start, s.end, s.kind) for s in found[i].spans]
        assert base == brute_spans(text or "") and set(base) <= set(spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert [(s.start, s.end, s.kind) for s in found[63].spans] == [(2, 21, "card")]
    assert found[65].spans == []  # a wrong check digit is no card
    clean = pii.redact(df)
    assert clean.columns == df.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[60] is None and kept[61] == "" and kept[64] == "nothing here" and kept[63] == "é [card] x"
    assert not any(EMAIL.search(t or "") for t in kept.values())


def test_personal_data_without_anything_to_learn(spark):
    assert [r.spans for r in pii.find(docs(spark, ["a b", None])).collect()] == [[], []]
    assert pii.find(docs(spark, []).limit(0)).count() == 0


def test_marginals_are_those_of_all_segmentations():
    text = "a 12 34 b@c.d"
    lat = pii.lattice(text, 0, len(text))
    rng = np.random.default_rng(1)
    model = pii.SemiMarkovField(rng.normal(size=(4, 28)), -0.3)
    scores, n = lat.features @ model.weights.T, len(lat.bounds)
    total, span_sum, best = 0.0, np.zeros_like(scores), (-np.inf, None)

    def walk(at, value, used):
        nonlocal total, best
        if at == n:
            total += np.exp(value)
            for k, kind in used:
                span_sum[k, kind] += np.exp(value)
            best = max(best, (value, used), key=lambda x: x[0])
            return
        walk(at + 1, value + (model.outside if lat.seed[at] else 0.0), used)
        for k, (i, j) in enumerate(lat.candidates):
            if i == at:
                for kind in range(4):
                    walk(j, value + scores[k, kind], [*used, (k, kind)])

    walk(0, 0.0, [])
    assert np.allclose(model.marginals(lat)[0], span_sum / total)
    want = [(lat.bounds[lat.candidates[k][0]][0], lat.bounds[lat.candidates[k][1] - 1][1], pii.KINDS[kind]) for k, kind in best[1]]
    assert model.decode(lat) == want


# Toxicity ---------------------------------------------------------------------------------------------------


def test_toxic_documents_are_told_apart_on_held_out_rows(spark):
    rng = random.Random(8)
    bad, rows, labels = ["vile", "nastyish", "nastyest", "rotten"], [], []
    for i in range(600):
        words = prose(rng, 80).lower().split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!!"]))
        rows.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    texts = rows + [None, "", "Vile!! rotten vile"]
    df = docs(spark, texts)
    known = spark.createDataFrame(labels + [(0, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc.doc_id: r for r in toxicity.scored(df, known, F.col("doc_id") % 4 != 2).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    right = sum((found[i].score >= 0.3) == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert found[600].score == found[601].score < 0.3 and all(0 <= r.score <= 1 for r in found.values())
    spans = found[602].spans
    assert "".join(texts[602][s.start:s.end] for s in spans)[:4] == "Vile"


def test_toxicity_without_labels_is_zero(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scored(docs(spark, ["a", None]), none, F.lit(True)).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs(spark, []).limit(0), none, F.lit(True)).count() == 0


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    model = toxicity.ToxicField({}, rng.normal(size=(2, 2)))
    chains = [rng.normal(size=n) * 3 for n in (4, 1, 7)]
    got = model.marginals(chains, np.ones(3, dtype=bool), np.ones(3, dtype=bool))
    for chain, p in zip(chains, got):
        total, on = 0.0, np.zeros(len(chain))
        for code in range(2 ** len(chain)):
            y = [code >> k & 1 for k in range(len(chain))]
            value = np.exp(model.transitions)[:, y[0]].sum() / 2 * np.exp(chain[0] * y[0])
            for t in range(1, len(chain)):
                value *= np.exp(model.transitions[y[t - 1], y[t]] + chain[t] * y[t])
            total += value
            on += value * np.array(y)
        assert np.allclose(p, on / total)


def test_a_stretch_cut_from_a_long_text_has_the_marginals_of_the_whole():
    model = toxicity.ToxicField({"=bad": 6.0}, np.array([[2.0, -3.0], [0.5, 0.5]]))
    words = ["fine"] * 500
    words[250] = words[253] = "bad"
    values = np.array([6.0 if w == "bad" else 0.0 for w in words])
    whole = model.marginals([values], np.array([True]), np.array([True]))[0]
    (start, part), = toxicity.token_probabilities([" ".join(words)], model, toxicity.Emissions(model.weights))[0]
    assert start > 0 and np.allclose(whole[start:start + len(part)], part, atol=1e-6)


# Duplicate passages -----------------------------------------------------------------------------------------


def brute_dedup(rows, width=13):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - width + 1):
            key = tuple(words[i:i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if d is not None and first[tuple(words[i:i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 3])
def test_passages_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "the", "the", "the"]
    passages = [rng.choices(vocabulary, k=rng.randint(10, 40)) for _ in range(5)]
    rows = []
    for i in range(50):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((100 - i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, None), (201, ""), (202, "the " * 60), (150, "the " * 40), (None, rows[3][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[7][1]),
             (300, rows[8][1] + " tail"), (301, rows[8][1].replace(" ", " "))]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, starts string, n int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicated(df).collect()), key=repr)
    assert got == brute_dedup(rows)


def test_words_that_a_sum_of_powers_cannot_tell_apart_are_different(spark):
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join([*words[:6], x, *words[6:]]) for x in (thue, thue.translate(str.maketrans("ab", "ba")))]
    assert {r.n_removed for r in substring.deduplicated(docs(spark, texts)).collect()} == {0}
    ids, of, first = substring.hashed_words(["x " * (substring.CHUNK // 2) + " y", "", "y"])
    assert len(ids) == substring.CHUNK // 2 + 2 and ids[-1] == ids[-2] and first.tolist() == [0, len(ids) - 1, len(ids) - 1] and of[-1] == 2


def test_no_passages(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.deduplicated(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in substring.deduplicated(one).collect()] == [(1, 3, 0, "a b c")]


def test_index_counts_match_a_scan():
    rng = np.random.default_rng(3)
    sequence = rng.integers(1, 6, 400)
    sequence[[50, 120, 399]] = 0
    index = substring.FMIndex(sequence)
    ends = np.array([e for e in range(8, 400) if (sequence[e - 7: e + 1] > 0).all()])
    length, low, high = index.statistics(sequence, ends, 8)
    text = sequence.tolist()
    for e, n, a, b in zip(ends, length, low, high):
        def seen(k):
            return sum(text[i:i + k] == text[e - k + 1:e + 1] for i in range(400 - k + 1))
        assert n == max(k for k in range(0, 9) if k == 0 or seen(k) >= 2)
        assert n == 0 or b - a == seen(n)


def test_smallest_documents_of_windows_above_sixteen_words():
    rng, width = np.random.default_rng(9), 40
    base = np.tile(rng.integers(0, 2, 7), 12)
    words = [base.copy() for _ in range(12)]
    for w in words:
        w[rng.integers(0, len(w), 2)] ^= 1
    owners = rng.permutation(12).astype(np.int64)
    found = substring.smallest_documents([w.astype("<i8").tobytes() for w in words], owners, width)
    least = {}
    for w, o in zip(words, owners):
        for i in range(len(w) - width + 1):
            k = w[i:i + width].tobytes()
            least[k] = min(least.get(k, o), o)
    for w, got in zip(words, found):
        assert list(got) == [least[w[i:i + width].tobytes()] for i in range(len(w) - width + 1)]
