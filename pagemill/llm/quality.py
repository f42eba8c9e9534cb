"""Quality rules: a decision list learned from labelled statistics, as Spark conditional expressions.

``measure`` computes counts of a text inside its row, ``learn`` finds rules by sequential
covering and ``RuleList.verdict`` is the ordered CASE expression. Nothing leaves the JVM but
the statistics of the labelled rows, which are at most ``2 * 8 ** len(FEATURES)`` counts.

Defined results: a null or empty text has no words and fails the base rule. A null label takes
no part in learning, a repeated label row counts as often as it is there. Without labels of both
kinds no rule is learned and the base rule alone decides. Ties between conditions go to the one
listed first. Extra columns are carried along by ``judged`` and clash with nothing, since the
caller's row is kept in a struct of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, words_of

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Shares that rules may test, in this order.
FEATURES = ["symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "mean_length"]
#: Quantiles of the good and of the bad rows that become thresholds: at most seven of a feature.
GOOD_QUANTILES, BAD_QUANTILES = [0.01, 0.05, 0.95, 0.99], [0.1, 0.5, 0.9]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass
class RuleList:
    """Rules in order, each a conjunction that rejects; a row that none matches is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def number(self) -> Column:
        """The first matching rule's number from 1, or null."""
        chosen = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            chosen = F.when(reduce(and_, [c.column() for c in rule]), F.lit(number)).otherwise(chosen)
        return chosen

    def verdict(self) -> Column:
        return self.number().isNull()

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nelse keep"


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df``'s row as the struct ``doc``, and the counts and shares of its text.

    Repeated windows are found by sorting the window hashes of one text with their places, so a text of
    n words costs n log n and no shuffle.
    """
    content = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    base = base.withColumn("words", words_of(F.col(f"doc.{text}")))
    base = base.withColumn(
        "lines", F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    n = F.size("words")
    hashed = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    ))
    base = base.select(
        "doc",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(content) - _without(content, r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _without(content, r"[^\p{Lu}]+").alias("n_upper"),
        (F.length(content) - _without(content, r"[!?]+")).cast("long").alias("n_marks"),
        hashed.alias("windows"),
    )
    # Only texts that repeat a window are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    base = base.withColumn("pairs", F.when(repeats, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    )))
    again = F.filter("pairs", lambda x, i: (
        (F.get("pairs", i - 1)["h"] == x["h"]) | (F.get("pairs", i + 1)["h"] == x["h"])
    ))
    base = base.withColumn("places", F.sort_array(F.transform(again, lambda x: x["at"])))
    covered = F.transform("places", lambda x, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - x, F.lit(WINDOW))
    ))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    base = base.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))

    def share(over: str, under: str) -> Column:
        return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))

    return base.select(
        "doc", *COUNTS,
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "n_words").alias("mark_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_length"),
    )


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _cells(labelled: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """Thresholds per feature, and counts of the labelled rows by fold and bin of every feature."""
    found = labelled.agg(*[
        F.percentile_approx(F.when(F.col("good") == good, F.col(f)), at, 10_000).alias(f"{f}_{good}")
        for f in FEATURES for good, at in ((1, GOOD_QUANTILES), (0, BAD_QUANTILES))
    ]).first()
    cuts = {f: sorted({*(found[f"{f}_1"] or []), *(found[f"{f}_0"] or [])}) for f in FEATURES}
    bins = [
        sum((F.when(F.col(f) >= cut, 1).otherwise(0) for cut in cuts[f]), F.lit(0)).alias(f"bin_{f}") for f in FEATURES
    ]
    fold = (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).cast("int").alias("fold")
    counts = labelled.select(fold, *bins, "good").groupBy("fold", *[f"bin_{f}" for f in FEATURES]).agg(
        F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")
    )
    return cuts, [tuple(r) for r in counts.collect()]


def _covers(rule: list[tuple[int, bool, int]], cell: tuple) -> bool:
    """A rule over bins: (place of the feature, whether above, number of the cut)."""
    return all((cell[1 + f] > cut) == above for f, above, cut in rule)


def _total(cells: list[tuple]) -> tuple[int, int]:
    return sum(c[-2] for c in cells), sum(c[-1] for c in cells)


def _best_condition(cells: list[tuple], cuts: dict[str, list[float]]) -> tuple[float, tuple[int, bool, int] | None]:
    """The condition of the largest information gain among the bad rows it keeps."""
    from math import log2

    bad, good = _total(cells)
    before, best = log2(bad / (bad + good)), (1e-9, None)
    for f, name in enumerate(FEATURES):
        size = len(cuts[name]) + 1
        sums = [[0, 0] for _ in range(size)]
        for cell in cells:
            sums[cell[1 + f]][0] += cell[-2]
            sums[cell[1 + f]][1] += cell[-1]
        for cut in range(size - 1):
            for above in (True, False):
                part = sums[cut + 1:] if above else sums[:cut + 1]
                b, g = sum(x[0] for x in part), sum(x[1] for x in part)
                gain = b * (log2(b / (b + g)) - before) if b else 0.0
                if gain > best[0]:
                    best = (gain, (f, above, cut))
    return best


def _margin(rule: list[tuple[int, bool, int]], cells: list[tuple], cuts: dict[str, list[float]], spare: float) -> list[Condition]:
    """The rule with each threshold halfway to the farthest one that loses at most the share ``spare`` of its bad rows.

    Clean rows near a boundary stay clean.
    """
    bad, out = _total([c for c in cells if _covers(rule, c)])[0], []
    for at, (f, above, cut) in enumerate(rule):
        edge, far = cuts[FEATURES[f]], cut
        while 0 <= (step := far + (1 if above else -1)) < len(edge):
            moved = [*rule[:at], (f, above, step), *rule[at + 1:]]
            if _total([c for c in cells if _covers(moved, c)])[0] < (1 - spare) * bad:
                break
            far = step
        out.append(Condition(FEATURES[f], above, (edge[cut] + edge[far]) / 2))
    return out


def learn(
    measured: DataFrame, good: Column, key: Column, *,
    max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_bad: int = 5, spare: float = 0.02,
) -> RuleList:
    """Rules that reject, by sequential covering over labelled rows.

    A rule grows on two thirds of the rows by information gain, is pruned on the rest from its end, and
    is taken while at least ``min_precision`` of what it rejects, in both parts together, is bad. Its thresholds
    then move away from the good rows (``spare``). All labelled rows count. ``good`` is 1, 0 or null; ``key`` deals rows into the two parts.
    """
    labelled = measured.select(*FEATURES, good.cast("int").alias("good"), key.alias("key")).filter(
        F.col("good").isin(0, 1)
    )
    cuts, cells = _cells(labelled)
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        rule: list[tuple[int, bool, int]] = []
        grown, held = [c for c in cells if not c[0]], [c for c in cells if c[0]]
        while len(rule) < max_conditions and min(_total(grown)) > 0:
            _, condition = _best_condition(grown, cuts)
            if condition is None:
                break
            rule.append(condition)
            grown = [c for c in grown if _covers([condition], c)]
        if not rule:
            break

        def worth(length: int) -> float:
            bad, fine = _total([c for c in held if _covers(rule[:length], c)])
            return (bad - fine) / (bad + fine) if bad + fine else -1.0

        # The shortest of the best prefixes.
        rule = rule[:max(range(1, len(rule) + 1), key=lambda n: (round(worth(n), 9), -n))]
        bad, fine = _total([c for c in cells if _covers(rule, c)])
        if bad < min_bad or bad < min_precision * (bad + fine):
            break
        rules.append(_margin(rule, cells, cuts, spare))
        cells = [c for c in cells if not _covers(rule, c)]
    return RuleList(rules)


def judged(df: DataFrame, labels: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, RuleList]:
    """``doc`` (a struct of the columns ``keep``), the counts, ``base_failed``, ``kept`` and ``rule`` of every row.

    Texts are read and measured once; what is stored are the counts and the columns asked for.
    """
    measured = measure(df, text)
    measured = stored(
        measured.withColumn("doc", F.struct(*[F.col("doc")[c].alias(c) for c in keep])), "quality"
    )
    marks = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label_quality"))
    # Rows that fail the base rule are decided; the rules are for the rest.
    labelled = measured.filter(~base_failed()).join(marks, F.col("doc.doc_id") == F.col("labelled_id"))
    rules = learn(labelled, F.col("label_quality"), F.col("labelled_id"))
    failed = base_failed()
    result = measured.select(
        "*", failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"),
        F.when(failed, F.lit(0)).otherwise(rules.number()).alias("rule"),
    )
    return result, rules


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the base rule and the learned rules keep, with ``df``'s columns."""
    result, _ = judged(df, labels, df.columns, text)
    return result.filter("kept").select("doc.*")
