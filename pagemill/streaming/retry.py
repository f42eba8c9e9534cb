"""Retry state of urls over a stream of fetch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import outcomes


def track_retries(
    log: DataFrame, on_change, checkpoint: str, max_retries: int = outcomes.MAX_RETRIES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Call ``on_change(df, batch)`` with the urls whose failure count changed.

    The state is a running count per url, held by a native streaming aggregate. Its map
    side adds up a batch first, so a url that fails again and again is one row per task.
    """
    changed = outcomes.retry_state(log.filter(log["outcome"] == outcomes.ERROR), max_retries)
    return (
        changed.writeStream.outputMode("update").foreachBatch(on_change)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
