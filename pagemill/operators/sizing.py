"""Broadcast hints behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side within both is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, a stored table, has at most ``limit`` rows and about ``max_bytes`` bytes.

    Rows are counted up to the limit without any column; only those of a table within it are measured, each where it lies.
    """
    if df.select(F.lit(1)).limit(limit + 1).count() > limit:
        return False
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= max_bytes


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if its rows and bytes were checked to be few, else as it is."""
    return F.broadcast(df) if small(df, limit) else df
