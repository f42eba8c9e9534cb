"""Histograms and windowed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the score histogram and of the latency histogram, in seconds.
SCORE_BOUNDS = [0.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0]
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def histogram(df: DataFrame, value: str, bounds: list[float] = SCORE_BOUNDS) -> DataFrame:
    """Cumulative histogram: ``(le, n, total, observations)``, one row per bound and one for all.

    One pass computes every bound; the unpivot that follows works on a single row.
    """
    v = F.col(value).cast("double")
    totals = df.agg(
        *[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(v).alias("observations"), F.sum(v).alias("total"),
    )
    rows = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("observations").alias("n")),
    )
    return totals.select(F.inline(rows), "total", "observations")


def window_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events per ``event_type`` and time window; ``late`` sets the watermark of a stream."""
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n"
    )
