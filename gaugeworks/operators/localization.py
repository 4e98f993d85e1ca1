"""Priority scores from gradients, spatial logits and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import entropy, norm, softmax

METHODS = ("gradient_norm", "spatial_entropy", "influence")


def gradient_norm(df: DataFrame) -> DataFrame:
    """(id, score) from (id, grad): length of the gradient."""
    return df.select("id", norm(F.col("grad")).alias("score"))


def spatial_entropy(df: DataFrame) -> DataFrame:
    """(id, score) from (id, cells): mean over the cells of the softmax entropy in bits."""
    each = F.transform("cells", lambda c: entropy(softmax(c), base2=True))
    return df.select("id", F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size("cells")).alias("score"))


def influence(train: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """(id, score) from (id, loss): the loss itself, or scaled by its range when validation losses are given.

    The values of the validation losses have no part in it.
    """
    if validation is None:
        return train.select("id", F.col("loss").cast("double").alias("score"))
    ends = train.agg(F.min("loss").cast("double").alias("_lo"), F.max("loss").cast("double").alias("_hi"))
    return train.crossJoin(F.broadcast(ends)).select("id", ((F.col("loss") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).alias("score"))  # one row


def scores(method: str, *, gradients: DataFrame | None = None, spatial_logits: DataFrame | None = None, train_losses: DataFrame | None = None, val_losses: DataFrame | None = None) -> DataFrame:
    """(id, score); raises ValueError for an unknown method or missing input."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    needed = {"gradient_norm": gradients, "spatial_entropy": spatial_logits, "influence": train_losses}[method]
    if needed is None:
        raise ValueError(f"{method} lacks its input")
    if method == "gradient_norm":
        return gradient_norm(needed)
    return spatial_entropy(needed) if method == "spatial_entropy" else influence(needed, val_losses)


def ranked(scored: DataFrame) -> DataFrame:
    """(id, priority_score), highest first, higher id on ties."""
    return scored.select("id", F.col("score").alias("priority_score")).orderBy(F.desc("priority_score"), F.desc("id"))


def query(scored: DataFrame, budget: int) -> DataFrame:
    return ranked(scored).limit(max(0, budget))
