"""Decisions that need a size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to all tasks.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it is counted to have at most ``rows`` rows; else leaves the join to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crowded_keys(df: DataFrame, key: str, share: float = 0.005) -> list:
    """The values of ``key`` with at least ``share`` of the rows of ``df``, at most 1 / share."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    whole = per.agg(F.sum("_n").alias("_all"))
    return [r[0] for r in per.crossJoin(F.broadcast(whole)).where(F.col(key).isNotNull() & (F.col("_n") >= F.col("_all") * share)).select(key).collect()]  # one row


def join_crowded(left: DataFrame, right: DataFrame, key: str, how: str = "inner", crowded: list | None = None) -> DataFrame:
    """Inner or left_semi join on one key of which a few values may hold most rows of ``left``; ``right`` has each key once.

    ``crowded`` are the ``crowded_keys`` of ``left``, counted at once if not given; their
    rows of ``right`` are sent to all tasks, so they stay where they are. The rest is
    shuffled. Null keys join nothing.
    """
    crowded = crowded_keys(left, key) if crowded is None else crowded
    if not crowded:
        return left.join(right, key, how)
    hot = F.col(key).isin(crowded)
    return left.where(~hot).join(right, key, how).unionByName(left.where(hot).join(F.broadcast(right.where(hot)), key, how))
