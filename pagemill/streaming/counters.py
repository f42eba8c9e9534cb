"""Windowed crawl counters over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import stats
from pagemill.sources import tables


def count_windows(
    events: DataFrame, path: str, checkpoint: str, width: str = "1 day", late: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the counts of every closed window to a log; rows later than ``late`` are dropped.

    A watermark needs a timestamp with time zone, so ``ts`` is cast to one.
    """
    typed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = stats.window_counts(typed, width, late)
    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(lambda batch, number: tables.append_batch(batch, path, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
