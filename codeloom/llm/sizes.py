"""Joins against a side whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # of a few numbers each: some tens of MB on every executor


def small_enough(side: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most `rows` rows; reads no more than that."""
    return side.limit(rows + 1).count() <= rows


def join_checked(big: DataFrame, side: DataFrame, on: str | list[str], how: str,
                 rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with the stored `side` sent to all executors if it is small, by a shuffle otherwise."""
    return big.join(F.broadcast(side) if small_enough(side, rows) else side, on, how)
