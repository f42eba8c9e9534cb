"""Retry state that forgets: failures count while they follow each other, and a url that is quiet for long has no state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagemill.operators import outcomes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_run(times: np.ndarray, run: tuple[int, int, int] | None, quiet: int) -> tuple[int, int, int]:
    """First, last and number of the latest failures of which none follows the one before after more than ``quiet``.

    ``run`` is that of earlier failures; times are whole numbers.
    """
    times = np.sort(times)
    starts = np.append(0, np.flatnonzero(np.diff(times) > quiet) + 1)
    ends = np.append(starts[1:], len(times))
    runs = [(int(times[a]), int(times[b - 1]), int(b - a)) for a, b in zip(starts, ends)]
    merged: list[tuple[int, int, int]] = []
    for one in sorted(runs + ([run] if run else [])):
        if merged and one[0] - merged[-1][1] <= quiet:
            last = merged[-1]
            merged[-1] = (last[0], max(last[1], one[1]), last[2] + one[2])
        else:
            merged.append(one)
    return merged[-1]


class RecentFailures(StatefulProcessor):
    """One value per url, the latest run of failures, with a timer that clears it once nothing can follow."""

    def __init__(self, quiet_micros: int, max_retries: int):
        self.quiet, self.max_retries = quiet_micros, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        run = tuple(self.run.get()) if self.run.exists() else None
        for chunk in rows:  # a url of very many failures comes in chunks
            run = latest_run(chunk["micros"].to_numpy(), run, self.quiet)
        self.run.update(run)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((run[1] + self.quiet) // 1000 + 1)
        decision = "requeue" if run[2] <= self.max_retries else "failed"
        yield pd.DataFrame({"url": [key[0]], "failures": [run[2]], "decision": [decision]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.run.clear()
        yield pd.DataFrame({"url": [], "failures": [], "decision": []}).astype({"url": str, "failures": "int64", "decision": str})

    def close(self) -> None:
        pass


def track_recent_retries(
    log: DataFrame, on_change, checkpoint: str, quiet: str = "30 days", late: str = "1 hour",
    max_retries: int = outcomes.MAX_RETRIES, trigger: dict | None = None,
) -> StreamingQuery:
    """Call ``on_change(df, batch)`` with the urls ``(url, failures, decision)`` that failed again.

    ``log`` has ``url``, ``outcome`` and ``ts``. Failures count from the last pause of more than ``quiet`` on; a url that was quiet
    for so long, by the watermark of ``late``, leaves the state, so the state holds the urls that failed of late and no others.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what keyed state with timers needs
    micros = int(pd.Timedelta(quiet).total_seconds() * 1_000_000)
    failures = log.filter(F.col("outcome") == outcomes.ERROR).select(
        "url", F.col("ts").cast("timestamp").alias("ts")
    ).withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    changed = failures.groupBy("url").transformWithStateInPandas(
        statefulProcessor=RecentFailures(micros, max_retries), outputStructType="url string, failures long, decision string",
        outputMode="Update", timeMode="EventTime",
    )
    return (
        changed.writeStream.outputMode("update").foreachBatch(on_change)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
