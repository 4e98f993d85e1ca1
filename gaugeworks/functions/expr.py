"""Column helpers for vectors, distributions and boxes; all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is, as its length counts as 1e-12 at least."""
    return F.aggregate(doubles(v), F.struct(F.lit(0.0).alias("s")), lambda a, x: F.struct((a.s + x * x).alias("s")), lambda a: F.transform(doubles(v), lambda x: x / F.greatest(F.sqrt(a.s), F.lit(1e-12))))


def entropy(p: Column, base2: bool = False) -> Column:
    """Entropy of the row scaled to sum one, in nats or bits; 0 * log 0 counts as 0."""
    log = F.log2 if base2 else F.ln
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    # -sum(p/S * log(p/S)) = log S - sum(p log p) / S, in one pass
    step = lambda a, x: F.struct((a.s + x).alias("s"), (a.t + F.when(x > 0, x * log(x)).otherwise(0.0)).alias("t"))
    return F.aggregate(doubles(p), start, step, lambda a: F.when(a.s > 0, log(a.s) - a.t / a.s))


def argmax(p: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(p: Column, index: Column) -> Column:
    """Element at a zero-based index; null out of range."""
    return F.get(p, index)


def top_two_gap(p: Column) -> Column:
    s = F.sort_array(doubles(p), asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def softmax(z: Column) -> Column:
    """Stable softmax of one row."""
    peak = F.array_max(doubles(z))
    e = F.transform(doubles(z), lambda x: F.exp(x - peak))
    return F.transform(e, lambda x: x / total(e))


def box(bbox: str | Column) -> tuple[Column, Column, Column, Column]:
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    return F.get(b, F.lit(0)), F.get(b, F.lit(1)), F.get(b, F.lit(2)), F.get(b, F.lit(3))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two [x, y, w, h] arrays; 0 unless both have four values and the union is positive."""
    ax, ay, aw, ah = box(a)
    bx, by, bw, bh = box(b)
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    union = aw * ah + bw * bh - w * h
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (union > 0), w * h / union).otherwise(0.0)
