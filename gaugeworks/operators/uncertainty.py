"""Uncertainty scores of predicted probabilities. Input rows: (id, probs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import argmax, entropy, top_two_gap

METHODS = ("entropy", "margin", "least_confidence", "bald")


def _known(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")


def score_column(method: str = "entropy") -> Column:
    """Uncertainty in terms of column probs; bald needs samples and counts as entropy here."""
    _known(method)
    if method == "margin":
        return 1.0 - top_two_gap(F.col("probs"))
    if method == "least_confidence":
        return 1.0 - F.array_max("probs").cast("double")
    return entropy(F.col("probs"))


def _clipped(p: Column) -> Column:
    return F.transform(p.cast("array<double>"), lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12)))


def bald(samples: DataFrame) -> DataFrame:
    """(id, score) from rows (pass, id, probs): entropy of the mean less mean entropy, at least 0.

    Both are of probabilities clipped to [1e-12, 1] and scaled to sum one.
    """
    each = samples.groupBy("id").agg(F.avg(entropy(_clipped(F.col("probs")))).alias("_e"), F.count(F.lit(1)).alias("_n"))
    mean = samples.select("id", F.posexplode("probs").alias("k", "p")).groupBy("id", "k").agg(F.avg("p").alias("p"))
    mean = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda r: r.p).alias("m"))
    return mean.join(each, "id").select("id", F.greatest(entropy(_clipped(F.col("m"))) - F.col("_e"), F.lit(0.0)).alias("score"))


def scores(df: DataFrame, method: str = "entropy", mc_samples: DataFrame | None = None) -> DataFrame:
    """(id, score, predicted_label, max_prob)."""
    _known(method)
    base = df.select("id", score_column(method).alias("score"), argmax(F.col("probs")).alias("predicted_label"), F.array_max("probs").alias("max_prob"))
    if method == "bald" and mc_samples is not None:
        return base.drop("score").join(bald(mc_samples), "id").select("id", "score", "predicted_label", "max_prob")
    return base


def query(df: DataFrame, budget: int, method: str = "entropy", mc_samples: DataFrame | None = None) -> DataFrame:
    """The ``budget`` most uncertain rows, highest id first on ties."""
    return ranked(df, method, mc_samples).limit(max(0, budget))


def ranked(df: DataFrame, method: str = "entropy", mc_samples: DataFrame | None = None) -> DataFrame:
    return scores(df, method, mc_samples).orderBy(F.desc("score"), F.desc("id"))
