"""Personal data: fixed patterns, and spans that a semi-Markov conditional random field adds.

The field scores whole candidate segments by features of the span (digit counts, groups, separators,
check digits, what stands beside it) and a bounded-entity dynamic program (at most ``MAX_TOKENS`` tokens)
chooses boundaries and types of all segments together. It is trained on the spans that the fixed patterns find
in a bounded sample of snippets, and on variants of them that the patterns miss (no plus sign, other
separators, a wrong check digit). An entity must hold a digit or an at sign, so words away from those are
outside in every segmentation and the program runs on windows around them, with the same optimum.

Defined results: a null or empty text has no spans. Offsets are code points, ends exclusive. Spans of
different fixed patterns may overlap and all stay; an added span never overlaps a fixed one. Repeated
rows give repeated results. With no pattern in the sample nothing is learned and nothing is added. Extra columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:int,end:int,kind:string>>"
MAX_TOKENS = 16
#: Characters beside a seed that its window holds.
REACH = 64
#: Most snippets of each kind in the training sample.
SAMPLE_PER_KIND = 80

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)


def _luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the at signs, so a long run without one costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            # A run that belongs to no address is not read again.
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    if not _SEED.search(text):
        return []
    found = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, merged where they touch."""
    out: list[list[int]] = []
    for m in _SEED.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_COUNT_EDGES = (7, 10, 11, 14, 16, 17, 20)


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[float]:
    """Features of a whole candidate segment."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    at = span.count("@")
    left, right = text[start - 1:start], text[end:end + 1]
    f = [0.0] * 28
    f[sum(len(digits) >= edge for edge in _COUNT_EDGES)] = 1.0
    f[8 + min(len(groups), 5)] = 1.0
    f[14] = float(at == 1)
    f[15] = float(at == 1 and "." in span[span.index("@"):])
    f[16] = float(span[0] == "+")
    f[17] = float("(" in span and ")" in span)
    f[18] = float(len(groups) == 4 and re.fullmatch(r"[0-9.]+", span) is not None and all(map(_small, groups)))
    f[19] = float(14 <= len(digits) <= 19 and _luhn(digits))
    f[20] = float(any(c.isalpha() for c in span))
    f[21] = float(len(groups) > 1 and all(len(g) == 4 for g in groups))
    f[22] = float(left == "" or left.isspace())
    f[23] = float(right == "" or right.isspace() or right in ".,;:!?")
    f[24] = float(" " in span or "-" in span)
    f[25] = float(re.fullmatch(r"[0-9]+(\.[0-9]+)*", span) is not None)
    f[26] = n_tokens / MAX_TOKENS
    f[27] = 1.0
    return f


@dataclass
class Lattice:
    """Tokens of a window and its candidate segments (first token, last token + 1, features)."""

    bounds: list[tuple[int, int]]
    seed: list[bool]
    candidates: list[tuple[int, int]]
    features: np.ndarray


def lattice(text: str, start: int, end: int) -> Lattice:
    """Candidates begin and end at whole words or numbers, hold a seed and no line end; with spaces they hold no letters."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    tokens = [text[a:b] for a, b in spans]
    solid = [t[0].isalnum() for t in tokens]
    seed = [t == "@" or "0" <= t[0] <= "9" for t in tokens]
    pairs, rows = [], []
    for i, first in enumerate(tokens):
        if not (solid[i] or first in "+(") or (i and solid[i - 1] and solid[i]):
            continue
        letters = spaces = has_seed = False
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            token = tokens[j]
            if token[0].isalpha() or token == "@":
                letters = True
            elif token.isspace():
                if token != " " or tokens[j - 1] == " ":
                    break
                spaces = True
            elif not solid[j] and token not in "+().-_%":
                break
            if letters and spaces:
                break
            has_seed |= seed[j]
            if has_seed and solid[j] and not (j + 1 < len(tokens) and solid[j + 1]):
                pairs.append((i, j + 1))
                rows.append(span_features(text, spans[i][0], spans[j][1], j + 1 - i))
    return Lattice(spans, seed, pairs, np.array(rows, dtype=float).reshape(len(rows), 28))


@dataclass
class SemiMarkovField:
    """Weights of the span features by kind, and of a seed token left outside."""

    weights: np.ndarray
    outside: float = 0.0

    def _by_end(self, lat: Lattice) -> dict[int, list[int]]:
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(lat.candidates):
            ends.setdefault(j, []).append(k)
        return ends

    def decode(self, lat: Lattice) -> list[tuple[int, int, str]]:
        """The best segmentation's entities, in code points."""
        scores = lat.features @ self.weights.T
        kind, best = (scores.argmax(1), scores.max(1)) if len(scores) else ([], [])
        value, back = [0.0], [-1]
        ends = self._by_end(lat)
        for j in range(1, len(lat.bounds) + 1):
            top, via = value[j - 1] + (self.outside if lat.seed[j - 1] else 0.0), -1
            for k in ends.get(j, ()):
                if (x := value[lat.candidates[k][0]] + best[k]) > top:
                    top, via = x, k
            value.append(top)
            back.append(via)
        out, j = [], len(lat.bounds)
        while j > 0:
            if (k := back[j]) < 0:
                j -= 1
            else:
                i = lat.candidates[k][0]
                out.append((lat.bounds[i][0], lat.bounds[j - 1][1], KINDS[kind[k]]))
                j = i
        return out[::-1]

    def marginals(self, lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every candidate and kind, and of every token outside, by the forward-backward sums."""
        scores, n = lat.features @ self.weights.T, len(lat.bounds)
        any_kind = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        ends = self._by_end(lat)
        begins: dict[int, list[int]] = {}
        for k, (i, _) in enumerate(lat.candidates):
            begins.setdefault(i, []).append(k)
        alone = [self.outside if s else 0.0 for s in lat.seed]
        for j in range(1, n + 1):
            terms = [ahead[j - 1] + alone[j - 1], *(ahead[lat.candidates[k][0]] + any_kind[k] for k in ends.get(j, ()))]
            top = max(terms)
            ahead[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        for i in range(n - 1, -1, -1):
            terms = [behind[i + 1] + alone[i], *(behind[lat.candidates[k][1]] + any_kind[k] for k in begins.get(i, ()))]
            top = max(terms)
            behind[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        spans = np.array([[ahead[i] + behind[j] - ahead[n]] for i, j in lat.candidates]).reshape(-1, 1)
        single = np.array([ahead[i] + alone[i] + behind[i + 1] - ahead[n] for i in range(n)])
        return np.exp(spans + scores), np.exp(single)


def _variants(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """The snippet, and for one span each the spellings that the fixed patterns miss.

    A card number with a wrong check digit is no card: such a number is a lesson without its span.
    """
    yield text, spans
    for n, (start, end, kind) in enumerate(spans):
        span, other = text[start:end], []
        if kind == "phone":
            other = [(span[1:], True), (re.sub(r"[ ().-]+", ".", span[1:]), True)]
        elif kind == "card":
            digits = _digits(span)
            wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
            other = [(".".join(re.findall(r".{1,4}", digits)), True), (wrong, False), ("-".join(re.findall(r".{1,4}", wrong)), False)]
        for new, still in other:
            shift = len(new) - len(span)
            moved = [(s + shift * (s > start), e + shift * (e >= end), k) for s, e, k in spans]
            yield text[:start] + new + text[end:], moved[:n] + [(start, start + len(new), kind)] * still + moved[n + 1:]


def fit(snippets: list[str], rounds: int = 12, rate: float = 0.6) -> SemiMarkovField | None:
    """Weights of largest likelihood, by adaptive gradient steps over the sample in its order."""
    lessons = []
    for text in snippets:
        spans = base_spans(text)
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
            continue
        for changed, gold in _variants(text, spans):
            lat = lattice(changed, 0, len(changed))
            place = {(lat.bounds[i][0], lat.bounds[j - 1][1]): k for k, (i, j) in enumerate(lat.candidates)}
            if all((s, e) in place for s, e, _ in gold):
                lessons.append((lat, [(place[s, e], KINDS.index(kind)) for s, e, kind in gold]))
    if not any(gold for _, gold in lessons):
        return None
    model = SemiMarkovField(np.zeros((len(KINDS), 28)))
    seen_w, seen_o = np.full(model.weights.shape, 1e-6), 1e-6
    for _ in range(rounds):
        for lat, gold in lessons:
            spans, single = model.marginals(lat)
            inside = set()
            delta = -spans
            for k, kind in gold:
                delta[k, kind] += 1.0
                inside.update(range(*lat.candidates[k]))
            grad = delta.T @ lat.features - 1e-3 * model.weights
            out = sum(float(i not in inside) - single[i] for i in range(len(single)) if lat.seed[i])
            seen_w += grad ** 2
            seen_o += out ** 2
            model.weights += rate * grad / np.sqrt(seen_w)
            model.outside += rate * out / math.sqrt(seen_o)
    return model


def all_spans(text: str, model: SemiMarkovField | None) -> tuple[list, list]:
    """Fixed spans, and fixed and added ones."""
    base = base_spans(text)
    if model is None or not _SEED.search(text):
        return base, base
    taken = sorted((s, e) for s, e, _ in base)
    added, at, reach = [], 0, -1
    for start, end in windows(text):
        for span in model.decode(lattice(text, start, end)):
            while at < len(taken) and taken[at][0] < span[1]:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= span[0]:
                added.append(span)
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def train(df: DataFrame, text: str = "text", per_kind: int = SAMPLE_PER_KIND) -> SemiMarkovField | None:
    """The field fitted on a sample of at most ``per_kind`` different snippets for each kind, and as many without any.

    Snippets (a window each, at most 600 characters) are chosen by their hash, so copies count once and
    reruns agree.
    """

    @F.pandas_udf("array<struct<snippet:string,kind:string>>")
    def snippets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for x in batch:
                cut = [x[a:b] for a, b in windows(x or "") if b - a <= 600]
                out.append([{"snippet": s, "kind": next((k for _, _, k in base_spans(s)), "none")} for s in cut])
            yield pd.Series(out)

    found = df.filter(F.col(text).rlike("[0-9@]")).select(F.explode(snippets(F.col(text))).alias("x")).select("x.*")
    order = Window.partitionBy("kind").orderBy("h", "snippet")
    sample = found.distinct().withColumn("h", F.xxhash64("snippet")).withColumn("n", F.row_number().over(order))
    with small_batches(df.sparkSession):
        rows = sample.filter(F.col("n") <= per_kind).orderBy("h", "snippet").select("snippet").collect()
    return fit([r[0] for r in rows])


def scan(text: Column, model: SemiMarkovField | None) -> Column:
    """Struct of ``base`` and ``spans``."""

    @F.pandas_udf(f"base {SPANS}, spans {SPANS}")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def named(spans: list) -> list[dict]:
            return [{"start": s, "end": e, "kind": k} for s, e, k in spans]

        for batch in batches:
            both = [all_spans(x or "", model) for x in batch]
            yield pd.DataFrame({"base": [named(b) for b, _ in both], "spans": [named(s) for _, s in both]})

    return compute(text)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` as the struct ``doc`` with ``base`` and ``spans`` of its text."""
    model = train(df, text)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    return rows.select("doc", scan(F.col(f"doc.{text}"), model).alias("pii")).select("doc", "pii.base", "pii.spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets; overlapping spans become one. ``n_chars``, if there, follows.

    A null text stays null.
    """
    model = train(df, text)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def mask(x: str | None) -> str | None:
            if not x:
                return x
            out, done = [], 0
            for start, end, kind in all_spans(x, model)[1]:
                if start >= done:
                    out += [x[done:start], f"[{kind}]"]
                done = max(done, end)
            return "".join([*out, x[done:]])

        for batch in batches:
            yield batch.map(mask)

    # A Python column is computed for every row: only texts that may change are handed over.
    seeded = F.col(text).rlike("[0-9@]")
    changed = F.when(seeded, masked(F.when(seeded, F.col(text)))).otherwise(F.col(text))
    out = df.withColumn(text, changed)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in df.columns else out
