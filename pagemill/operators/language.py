"""Language identification with character trigrams, trained on labelled text.

A task counts the trigrams of its texts in numpy, and the shuffle of the training carries one row per language and trigram
of a block of texts. A language keeps all its trigrams, and a text takes the
language with the best naive Bayes sum. Weights are whole millionths, so sums do not depend on the order of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.sizing import sized, small
from pagemill.session import cut_lineage

# Shortest text that is classified, and the label of any other.
MIN_CHARS = 50
UNKNOWN = "unknown"

SCALE = 1_000_000
MAX_LANGUAGES = 1_000
# Characters that a task takes apart at once, and cells of a table with a place for every trigram of an alphabet.
BLOCK_CHARS, MAX_CELLS = 1 << 20, 1 << 23
CODE_POINTS, BLANK = 0x110000, 32
# Bytes of texts that are handed to a task's Python process at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@functools.cache
def _letter_bounds(spark: SparkSession) -> list[int]:
    r"""Code points at which ``\p{L}`` of Spark's regular expressions begins or ends to hold, in order: some 1,300."""

    def letter(code: Column) -> Column:
        surrogate = code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(surrogate, BLANK).otherwise(code)), 8, "0")), "UTF-32")
        return char.rlike(r"^\p{L}$")

    codes = spark.range(1, CODE_POINTS).filter(letter(F.col("id")) != letter(F.col("id") - 1))
    return sorted(row["id"] for row in codes.collect())


def _is_letter(bounds: list[int]) -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    steps = np.zeros(CODE_POINTS, dtype=bool)
    steps[bounds] = True
    return np.logical_xor.accumulate(steps)


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BLOCK_CHARS`` characters, or one longer text each."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
        yield first, last
        first = last


def _taken_apart(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of the rows of a batch, each with the code points of its texts in one row and where each text starts.

    A text is followed by a blank, so no word reaches into the next one. A null is an empty text.
    """
    lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    for first, last in _blocks(lengths):
        block = batch.slice(first, last - first)
        texts = [t or "" for t in block.column("text").to_pylist()]
        codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
        yield block, codes, np.cumsum(lengths[first:last]) - lengths[first:last]


def _ranks(alphabet: np.ndarray) -> np.ndarray:
    """The place of each code point in ``alphabet``, which starts with the blank; 0 for any other."""
    rank = np.zeros(CODE_POINTS, dtype=np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    return rank


def _around(ranks: np.ndarray, base: int) -> np.ndarray:
    """The trigram around each character as one number, of three ranks below ``base``."""
    wide = np.zeros(len(ranks) + 2, dtype=np.int64)
    wide[1:-1] = ranks
    return (wide[:-2] * base + wide[1:-1]) * base + wide[2:]


def _counter(key: str, bounds: list[int]) -> Callable:
    """For ``mapInArrow`` over ``(key, text)``: ``(key, gram, n)``, a row per key and trigram of a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = _is_letter(bounds)
        for block, codes, starts in (part for batch in batches for part in _taken_apart(batch)):
            keys = block.column(key).dictionary_encode("encode")
            owners = np.repeat(keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts, append=len(codes)))
            # The letters of a block are few different ones; the blank, of rank 0, stands for all else.
            present = np.zeros(CODE_POINTS, dtype=bool)
            present[codes] = True
            alphabet = np.concatenate([[BLANK], np.flatnonzero(present & is_letter)]).astype(np.uint32)
            base = len(alphabet)
            ranks = _ranks(alphabet)[codes]
            grams = _around(ranks, base)
            if len(keys.dictionary) * base**3 <= MAX_CELLS:
                cells = np.bincount(owners * base**3 + grams)
                places = np.flatnonzero(cells)
                places = places[places // base % base > 0]
                owners, grams, times = places // base**3, places % base**3, cells[places]
            else:
                kinds, grams = np.unique(grams[ranks > 0], return_inverse=True)
                places, times = np.unique(owners[ranks > 0] * len(kinds) + grams, return_counts=True)
                owners, grams = (places // len(kinds), kinds[places % len(kinds)]) if len(kinds) else (places, places)
            letters_of = alphabet[np.stack([grams // base**2, grams // base % base, grams % base], axis=1)].tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([
                keys.dictionary.take(pa.array(owners, pa.int64())),
                pa.array([letters_of[i:i + 3] for i in range(0, len(letters_of), 3)], pa.string()), pa.array(times, pa.int64()),
            ], names=[key, "gram", "n"])

    return count


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """``(key, gram, n)`` of ``(key, text)``: trigrams of the lower-case words with a blank on either side; a pair may have several rows."""
    given = rows.filter(F.col("text").isNotNull()).select(key, F.lower("text").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return given.mapInArrow(_counter(key, _letter_bounds(rows.sparkSession)), f"`{key}` {kind}, gram string, n long")


def _stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of a result of ``mapInArrow`` that is handed texts in batches of few bytes."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, BATCH_BYTES)
    try:
        return cut_lineage(df)
    finally:
        conf.set(BATCH, before)


def train(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model tables ``(language, gram, weight)`` and ``(language, floor)`` from ``(text, language)``.

    The floor is the weight of a trigram that the language does not have; ``weight`` is what one that it has
    adds to it. Every trigram counts once more than it was seen (Laplace).
    """
    grams = _stored(_grams(labelled, "language").groupBy("language", "gram").agg(F.sum("n").alias("n")))
    totals = grams.groupBy("language").agg((F.sum("n") + F.count("*")).alias("total"))

    def scaled(share: Column) -> Column:
        return F.round(F.ln(share) * SCALE).cast("long")

    floors = totals.select("language", scaled(F.lit(1.0) / F.col("total")).alias("floor"))
    weights = grams.join(sized(totals), "language").select(
        "language", "gram",
        (scaled((F.col("n") + 1) / F.col("total")) - scaled(F.lit(1.0) / F.col("total"))).alias("weight"),
    )
    return weights, floors


def _scorer(key: str, grams: list[str], weights: np.ndarray, columns: list[str], bounds: list[int]) -> Callable:
    """For ``mapInArrow`` over ``(key, text, counts)``: per text its letters, and if it counts its known trigrams and sums of weights."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = _is_letter(bounds)
        of_model = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).reshape(-1, 3)
        alphabet = np.concatenate([[BLANK], np.setdiff1d(of_model, [BLANK])]).astype(np.uint32)
        # One more rank for the letters that the model has not.
        base = len(alphabet) + 1
        rank = np.where(is_letter, base - 1, 0)
        rank[alphabet] = np.arange(base - 1)
        known = rank[of_model] @ np.array([base**2, base, 1])
        # The row of a trigram in the weights; row 0 is that of an unknown one.
        if base**3 <= MAX_CELLS:
            rows = np.zeros(base**3, dtype=np.int64)
            rows[known] = np.arange(1, len(known) + 1)
            find = rows.__getitem__
        else:
            order = np.argsort(known)
            ordered = known[order]

            def find(wanted: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
                return np.where(ordered[at] == wanted, order[at] + 1, 0)

        for block, codes, starts in (part for batch in batches for part in _taken_apart(batch)):
            row = find(_around(rank[codes], base))
            counts = pc.fill_null(block.column("counts"), False).to_numpy(zero_copy_only=False)
            sums = [np.add.reduceat(x, starts) * counts for x in ((row > 0).astype(np.int64), *(w[row] for w in weights))]
            letters = np.add.reduceat(is_letter[codes].astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([
                block.column(key), pa.array(letters, pa.int64(), mask=block.column("text").is_null().to_numpy(zero_copy_only=False)),
                *[pa.array(x, pa.int64()) for x in sums],
            ], names=[key, "letters", "matched", *columns])

    return score


def identify(texts: DataFrame, key: str, model: tuple[DataFrame, DataFrame], min_chars: int = MIN_CHARS) -> DataFrame:
    """``(key, language)`` for every ``(key, text)`` row, over whole texts.

    The weights are stored once with a column per language. If their size was checked they are sent to the tasks, and a
    text is weighed and summed where it is read; a larger model is joined to the trigrams of the texts. The shuffle carries one row
    per text, or per trigram of a text. A model of more than ``MAX_LANGUAGES`` languages is an error.
    """
    weights, floors = model
    known = floors.orderBy("language").limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    columns = [f"w{i}" for i in range(len(known))]
    wide = cut_lineage(weights.groupBy("gram").agg(*[
        F.coalesce(F.sum(F.when(F.col("language") == row["language"], F.col("weight"))), F.lit(0)).alias(c)
        for c, row in zip(columns, known)
    ]))
    if known and small(wide):
        rows = wide.toArrow()  # BROADCAST_ROWS rows
        sent = np.zeros((len(columns), rows.num_rows + 1), dtype=np.int64)
        for i, c in enumerate(columns):
            sent[i, 1:] = rows.column(c).to_numpy()
        score = _scorer(key, rows.column("gram").to_pylist(), sent, columns, _letter_bounds(texts.sparkSession))
        given = texts.select(key, F.lower("text").alias("text"), (F.length("text") > min_chars).alias("counts"))
        names = ", ".join(f"{c} long" for c in ["letters", "matched", *columns])
        letters = _stored(given.mapInArrow(score, f"`{key}` {texts.schema[key].dataType.simpleString()}, {names}"))
        sums = letters.groupBy(key).agg(*[F.sum(c).alias(c) for c in ["matched", *columns]])
    else:
        letters = texts.select(key, F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).alias("letters"))
        sums = _grams(texts.filter(F.length("text") > min_chars), key).join(wide, "gram").groupBy(key).agg(
            F.sum("n").alias("matched"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in columns]
        )
    # Equal sums fall to the language first in the alphabet.
    best = F.array_min(F.array(*[
        F.struct((-(F.col(c) + F.col("letters") * F.lit(row["floor"]).cast("long"))).alias("loss"), F.lit(row["language"]).alias("language"))
        for c, row in zip(columns, known)
    ]))["language"] if known else F.lit(None).cast("string")
    return letters.select(key, "letters").join(sums, key, "left").select(
        key, F.coalesce(F.when(F.col("matched") > 0, best), F.lit(UNKNOWN)).alias("language")
    )
