"""Label quality from predicted probabilities. Input rows: (id, label, probs); labels count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import argmax, at, entropy

METHODS = ("self_confidence", "normalized_margin", "entropy_weighted")


def validate(df: DataFrame) -> int:
    """Number of classes; raises ValueError for uneven rows and labels out of range. One aggregate job."""
    r = df.agg(F.min(F.size("probs")).alias("lo"), F.max(F.size("probs")).alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.count_if(F.col("probs").isNull() | F.col("label").isNull()).alias("nulls")).first()
    if r["nulls"]:
        raise ValueError(f"{r['nulls']} rows without probabilities or label")
    if r["lo"] != r["hi"]:
        raise ValueError(f"rows have between {r['lo']} and {r['hi']} probabilities")
    if r["lo"] is not None and not (0 <= r["l0"] and r["l1"] < r["lo"]):
        raise ValueError(f"labels lie between {r['l0']} and {r['l1']} for {r['lo']} classes")
    return r["lo"] or 0


def score(method: str = "self_confidence") -> Column:
    """Quality in terms of columns label and probs; low is suspicious. Raises ValueError for unknown methods."""
    own = at(F.col("probs"), F.col("label"))
    if method == "self_confidence":
        return own.cast("double")
    if method == "normalized_margin":
        # at most 0.5, reached where the label is the most probable class
        return (own - F.array_max("probs") + 1.0) / 2.0
    if method == "entropy_weighted":
        return own * (1.0 - entropy(F.col("probs")) / F.ln(F.size("probs") + F.lit(1e-9)))
    raise ValueError(f"method must be one of {METHODS}, not {method!r}")


def quality_scores(df: DataFrame, method: str = "self_confidence") -> DataFrame:
    return df.select("id", "label", score(method).alias("score"))


def issue_mask(df: DataFrame, threshold: float = 0.5, method: str = "self_confidence") -> DataFrame:
    """(id, is_issue): score strictly below the threshold."""
    return df.select("id", (score(method) < threshold).alias("is_issue"))


def ranked_issues(df: DataFrame, method: str = "self_confidence", top_k: int | None = None) -> DataFrame:
    """(id, given_label, predicted_label, score, confidence), lowest score first, lower id on ties."""
    rows = df.select("id", F.col("label").alias("given_label"), argmax(F.col("probs")).alias("predicted_label"), score(method).alias("score"), F.array_max("probs").alias("confidence")).orderBy("score", "id")
    return rows if top_k is None else rows.limit(top_k)


def class_thresholds(df: DataFrame, n_classes: int) -> DataFrame:
    """(label, threshold): mean probability of a class over the rows labelled so; 0.5 where there is none."""
    seen = df.groupBy("label").agg(F.avg(at(F.col("probs"), F.col("label"))).alias("_t"))
    classes = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    return classes.join(seen, "label", "left").select("label", F.coalesce("_t", F.lit(0.5)).alias("threshold"))


def confident_joint(df: DataFrame, n_classes: int) -> DataFrame:
    """(given, likely, n, share) of the dense grid: rows given one label whose probability of another reaches its threshold.

    A row counts for every class that reaches its threshold. The thresholds are one value
    a class, so they travel as one array.
    """
    limits = class_thresholds(df, n_classes).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "threshold"))), lambda r: r.threshold).alias("_t"))
    hits = df.crossJoin(F.broadcast(limits)).select("label", F.posexplode(F.zip_with("probs", "_t", lambda p, t: p >= t)).alias("likely", "_hit")).where("_hit")  # one row
    found = hits.groupBy(F.col("label").cast("int").alias("given"), "likely").agg(F.count(F.lit(1)).alias("n"))
    found = found.crossJoin(F.broadcast(found.agg(F.sum("n").alias("_all"))))  # one row
    found = found.select("given", "likely", "n", (F.col("n") / F.col("_all")).alias("share"))
    cells = df.sparkSession.range(n_classes * n_classes).select(F.floor(F.col("id") / n_classes).cast("int").alias("given"), (F.col("id") % n_classes).cast("int").alias("likely"))
    return cells.join(found, ["given", "likely"], "left").select("given", "likely", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def quality_summary(df: DataFrame, n_classes: int, method: str = "self_confidence") -> DataFrame:
    """One row: n_samples, mean_score, estimated_error_rate, flagged_count, flagged_fraction; flagged is below 0.5.

    Without any count in the joint the error rate is 1.
    """
    error = confident_joint(df, n_classes).agg(F.round(1 - F.sum(F.when(F.col("given") == F.col("likely"), F.col("share")).otherwise(0.0)), 6).alias("estimated_error_rate"))
    s = df.select(score(method).alias("s")).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("s").alias("mean_score"), F.count_if(F.col("s") < 0.5).alias("flagged_count"))
    return s.crossJoin(error).withColumn("flagged_fraction", F.round(F.try_divide("flagged_count", "n_samples"), 6))  # one row each
