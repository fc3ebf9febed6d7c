"""Joins whose small side is broadcast only if it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(large: DataFrame, small: DataFrame, on, limit: int, how: str = "inner") -> DataFrame:
    """Joins; broadcasts `small` if it has at most `limit` rows, else leaves it to the planner (a shuffle that can split
    skewed keys). The check reads at most limit + 1 rows."""
    few = small.limit(limit + 1).count() <= limit
    return large.join(F.broadcast(small) if few else small, on, how)
