"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents carry labels, so tokens get theirs from statistics of the labelled documents: a word form or prefix that
occurs in at least ``MIN_DOCS`` toxic documents and almost nowhere else marks a token of a toxic document as toxic; every
token of a clean document is clean. The field (two states; emissions from word forms and prefixes,
transitions between neighbours) is fitted to windows of those documents. For every whole text the forward-backward
sums give each token's probability; tokens above one half join to offending spans, and the sum and the largest of the probabilities give
the document's score by a logistic curve fitted to the same labelled documents.

A token without any weighted feature far from those with one has the chain's resting probability, so the sums run on
stretches that reach ``MARGIN`` tokens beyond weighted tokens, from and into the resting messages.

What is fitted sees a bounded sample: about ``SAMPLE_DOCS`` labelled documents chosen by a hash of the id, ``SAMPLE_WINDOWS`` windows.

Defined results: a null or empty text scores like a text without any weighted word. Without toxic labels every score is 0. A document
with several labels is toxic if one says so; null labels say nothing. Repeated rows get equal scores. Extra columns are carried along.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

SAMPLE_DOCS, SAMPLE_WINDOWS = 8_000, 6_000
WINDOW, MARGIN = 32, 16
#: A feature takes part from this share of toxic documents among those that have it, and marks tokens from the second.
MIN_DOCS, MIN_SHARE, MARK_SHARE = 4, 0.5, 0.9
PREFIXES = (4, 5, 6, 7)
SPANS = "array<struct<start:int,end:int,probability:double>>"
_EDGES = string.punctuation + "“”«»…¿¡–—"


def features(word: str) -> list[str]:
    """Word form and prefixes of a lower-case token."""
    form = word.strip(_EDGES)
    return [f"={form}", *(form[:k] for k in PREFIXES if len(form) > k)] if form else []


class Emissions(dict):
    """Weight of a token, remembered by its spelling; 0.0 exactly if no feature has a weight."""

    def __init__(self, weights: dict[str, float], limit: int = 500_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = float(sum(self.weights.get(f, 0.0) for f in features(word)))
        self[word] = value
        return value


@dataclass
class ToxicField:
    """Weights by feature, transitions [from][to] in logs (the state's own bias is in the column), and the curve."""

    weights: dict[str, float]
    transitions: np.ndarray
    curve: tuple[float, float, float] = (-4.0, 2.0, 4.0)

    def resting(self) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages of an endless run of tokens without a weight."""
        matrix = np.exp(self.transitions)
        ahead, behind = np.ones(2) / 2, np.ones(2) / 2
        for _ in range(200):
            ahead, behind = ahead @ matrix, matrix @ behind
            ahead, behind = ahead / ahead.sum(), behind / behind.sum()
        return ahead, behind

    def marginals(self, chains: list[np.ndarray], opens: np.ndarray, closes: np.ndarray) -> list[np.ndarray]:
        """Probability of the toxic state of every token; chains in step, longest first.

        ``opens`` and ``closes`` tell chains that begin or end with their text from those cut out of a resting stretch.
        """
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        sizes = np.array([len(chains[i]) for i in order])
        if not len(order):
            return []
        width, matrix = int(sizes[0]), np.exp(self.transitions)
        ahead_rest, behind_rest = self.resting()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([chains[i] for i in order])
        # Emissions as a pair of factors, of which the larger is 1.
        on, off = np.exp(np.minimum(flat, 0.0)), np.exp(np.minimum(-flat, 0.0))
        ahead = np.empty((len(flat), 2))
        first = opens[order][:, None]
        message = np.where(first, 0.5, ahead_rest)
        active = [int((sizes > t).sum()) for t in range(width)]
        for t in range(width):
            at = starts[:-1][: active[t]] + t
            message = message[: active[t]] @ matrix
            message = message * np.stack([off[at], on[at]], axis=1)
            message = message / message.sum(1, keepdims=True)
            ahead[at] = message
        out = np.empty(len(flat))
        message = np.where(closes[order][:, None], 0.5, behind_rest)
        for t in range(width - 1, -1, -1):
            at, n = starts[:-1][: active[t]] + t, active[t]
            both = ahead[at] * message[:n]
            out[at] = both[:, 1] / both.sum(1)
            # A chain that ends later keeps its closing message until its own last token.
            step = (message[:n] * np.stack([off[at], on[at]], axis=1)) @ matrix.T
            message[:n] = step / step.sum(1, keepdims=True)
        found: list[np.ndarray] = [np.empty(0)] * len(chains)
        for place, i in enumerate(order):
            found[i] = out[starts[place]: starts[place + 1]]
        return found


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Token ranges around weighted tokens."""
    hits = np.flatnonzero(values)
    if not len(hits):
        return []
    cuts = np.flatnonzero(np.diff(hits) > 2 * MARGIN)
    first, last = hits[np.concatenate([[0], cuts + 1])], hits[np.concatenate([cuts, [len(hits) - 1]])]
    return [(max(0, int(a) - MARGIN), min(len(values), int(b) + MARGIN + 1)) for a, b in zip(first, last)]


def token_probabilities(texts: list[str], model: ToxicField, emissions: Emissions) -> list[list[tuple[int, np.ndarray]]]:
    """For each text, (number of the first token, probabilities) of every stretch."""
    chains, opens, closes, of = [], [], [], []
    for n, text in enumerate(texts):
        words = text.lower().split()
        values = np.array([emissions[w] for w in words])
        for a, b in stretches(values):
            chains.append(values[a:b])
            opens.append(a == 0)
            closes.append(b == len(values))
            of.append((n, a))
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    for (n, a), p in zip(of, model.marginals(chains, np.array(opens, dtype=bool), np.array(closes, dtype=bool))):
        out[n].append((a, p))
    return out


def summary(parts: list[tuple[int, np.ndarray]]) -> tuple[float, float]:
    """Sum and largest of a document's token probabilities."""
    return sum(float(p.sum()) for _, p in parts), max((float(p.max()) for _, p in parts), default=0.0)


def offending(text: str, parts: list[tuple[int, np.ndarray]], least: float = 0.5) -> list[tuple[int, int, float]]:
    """Spans (code points) of neighbouring tokens of at least ``least``, with their largest probability."""
    hot = {a + int(i): float(p[i]) for a, p in parts for i in np.flatnonzero(p >= least)}
    if not hot:
        return []
    out: list[list] = []
    for n, m in enumerate(re.finditer(r"\S+", text)):
        if n in hot:
            if out and out[-1][3] == n - 1:
                out[-1][1:] = [m.end(), max(out[-1][2], hot[n]), n]
            else:
                out.append([m.start(), m.end(), hot[n], n])
    return [(a, b, p) for a, b, p, _ in out]


def _curve(model: ToxicField, total: float, most: float) -> float:
    a, b, c = model.curve
    return float(1.0 / (1.0 + np.exp(-np.clip(a + b * np.log1p(total) + c * most, -50, 50))))


def score(text: Column, model: ToxicField | None) -> Column:
    """Struct of ``score``, ``total``, ``most`` and ``spans`` of a text."""

    @F.pandas_udf(f"score double, total double, most double, spans {SPANS}")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(model.weights) if model else None
        for batch in batches:
            texts, rows = [x or "" for x in batch], []
            for start in range(0, len(texts), 1_000):
                part = texts[start:start + 1_000]
                found = token_probabilities(part, model, emissions) if model else [[]] * len(part)
                for x, p in zip(part, found):
                    total, most = summary(p)
                    spans = [{"start": a, "end": b, "probability": q} for a, b, q in offending(x, p)]
                    rows.append((_curve(model, total, most) if model else 0.0, total, most, spans))
            yield pd.DataFrame(rows, columns=["score", "total", "most", "spans"])

    return compute(text)


def _train_field(windows: list[tuple[list[list[int]], list[int]]], names: list[str], steps: int = 80, rate: float = 0.3) -> ToxicField:
    """Weights of largest penalised likelihood over windows of (feature numbers per token, states), by Adam steps."""
    size = len(windows)
    states = np.zeros((size, WINDOW), dtype=np.int64)
    live = np.zeros((size, WINDOW), dtype=bool)
    places, numbers = [], []
    for i, (tokens, marks) in enumerate(windows):
        states[i, : len(marks)], live[i, : len(marks)] = marks, True
        for t, known in enumerate(tokens):
            places += [i * WINDOW + t] * len(known)
            numbers += known
    places, numbers = np.array(places, dtype=np.int64), np.array(numbers, dtype=np.int64)
    n = len(names)
    theta = np.concatenate([np.zeros(n), [0.0, -3.0, 0.0, 0.0]])
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    pairs = live[:, 1:] & live[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (states[:, :-1][pairs], states[:, 1:][pairs]), 1.0)
    for step in range(1, steps + 1):
        emit = np.bincount(places, weights=theta[numbers], minlength=size * WINDOW).reshape(size, WINDOW)
        matrix = np.exp(theta[n:].reshape(2, 2))
        on, off = np.exp(np.minimum(emit, 0)), np.exp(np.minimum(-emit, 0))
        local = np.where(live[..., None], np.stack([off, on], axis=-1), 1.0)
        ahead, behind = np.empty((size, WINDOW, 2)), np.ones((size, WINDOW, 2)) / 2
        ahead[:, 0] = local[:, 0] * (np.ones(2) / 2 @ matrix)
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for t in range(1, WINDOW):
            ahead[:, t] = np.where(live[:, t, None], (ahead[:, t - 1] @ matrix) * local[:, t], ahead[:, t - 1])
            ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            behind[:, t] = np.where(live[:, t + 1, None], (behind[:, t + 1] * local[:, t + 1]) @ matrix.T, behind[:, t + 1])
            behind[:, t] /= behind[:, t].sum(1, keepdims=True)
        both = ahead * behind
        marginal = both[..., 1] / both.sum(-1)
        joint = ahead[:, :-1, :, None] * matrix * (behind[:, 1:] * local[:, 1:])[:, :, None, :]
        joint = joint / joint.sum((2, 3), keepdims=True)
        grad = np.bincount(numbers, weights=(states - marginal).reshape(-1)[places], minlength=n) if n else np.zeros(0)
        grad = np.concatenate([grad, (seen - joint[pairs].sum(0)).reshape(-1)]) - 0.05 * theta
        mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return ToxicField(dict(zip(names, map(float, theta[:n]))), theta[n:].reshape(2, 2))


def _train_curve(rows: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """Logistic curve over the logarithm of the sum and the largest probability, by Newton steps with a small penalty."""
    x = np.array([[1.0, np.log1p(total), most] for _, total, most in rows])
    y = np.array([toxic for toxic, _, _ in rows], dtype=float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return tuple(float(v) for v in w)


def _sample(df: DataFrame, labels: DataFrame, use: Column, text: str) -> DataFrame:
    """``text`` and ``toxic`` of about ``SAMPLE_DOCS`` labelled documents."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(use)
    n = known.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # About SAMPLE_DOCS rows of two numbers, whatever the input.
    rows = df.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"))
    return stored(rows.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")


def train(df: DataFrame, labels: DataFrame, use: Column, text: str = "text") -> ToxicField | None:
    """A field fitted to labelled documents; ``use`` (a condition on doc_id) says whose labels may be seen."""
    sample = _sample(df, labels, use, text)
    spark = df.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter(f for x in batch["text"] for f in {f for w in set((x or "").lower().split()) for f in features(w)})
            yield pd.DataFrame(counts.items(), columns=["feature", "n"])

    def totals(part: DataFrame) -> DataFrame:
        return part.mapInPandas(counted, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    toxic = stored(totals(sample.filter("toxic = 1").select("text")).filter(F.col("n") >= MIN_DOCS), "toxic")
    clean = totals(sample.filter("toxic = 0").select("text")).withColumnRenamed("n", "clean")
    shares = toxic.join(clean, "feature", "left").withColumn("share", F.col("n") / (F.col("n") + F.coalesce("clean", F.lit(0))))
    rows = shares.filter(F.col("share") >= MIN_SHARE).select("feature", "share", "n").orderBy("feature").collect()
    if not rows:
        return None
    names = [r["feature"] for r in rows]
    number = {f: i for i, f in enumerate(names)}
    marking = {r["feature"] for r in rows if r["share"] >= MARK_SHARE}

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, is_toxic in zip(batch["text"], batch["toxic"]):
                words = (x or "").lower().split()
                known = [[f for f in features(w) if f in number] for w in words]
                # Stretches of a text that hold weighted tokens, and one in sixteen of the others.
                for at in range(0, len(words), WINDOW):
                    part = known[at:at + WINDOW]
                    if any(part) or (at // WINDOW + len(words)) % 16 == 0:
                        marks = [int(bool(is_toxic) and any(f in marking for f in fs)) for fs in part]
                        out.append(([[number[f] for f in fs] for fs in part], marks))
            yield pd.DataFrame(out, columns=["tokens", "marks"])

    made = stored(sample.mapInPandas(windows, "tokens array<array<int>>, marks array<int>"), "windows")
    chosen = made.orderBy(F.xxhash64(F.to_json("tokens"), "marks")).limit(SAMPLE_WINDOWS).collect()
    model = _train_field([(r["tokens"], r["marks"]) for r in chosen], names)
    summed = sample.select("toxic", score(F.col("text"), model).alias("s")).select("toxic", "s.total", "s.most").collect()
    model.curve = _train_curve([tuple(r) for r in summed])
    return model


def scored(df: DataFrame, labels: DataFrame, use: Column, text: str = "text") -> DataFrame:
    """``df`` as the struct ``doc`` with ``score`` and offending ``spans`` of every text."""
    model = train(df, labels, use, text)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    return rows.select("doc", score(F.col(f"doc.{text}"), model).alias("s")).select("doc", "s.score", "s.spans")
