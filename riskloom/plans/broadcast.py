"""Broadcast only behind a size bound.

Callers pass a row bound they have measured or derived (for example the number of
groups counted by a partial aggregate). Below the limit the side is broadcast;
above it, or when no bound is known, the plain join is kept and Spark shuffles
both sides (AQE may still turn it into a broadcast at run time from real sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows we are willing to ship to every executor (a few tens of MB at our widths).
BROADCAST_ROW_LIMIT = 200_000


def broadcast_if_small(df: DataFrame, row_bound: int | None, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    if row_bound is not None and row_bound <= limit:
        return F.broadcast(df)
    return df


def bounded_count(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> int:
    """Count rows, stopping early: returns at most ``limit + 1``."""
    return df.limit(limit + 1).count()
