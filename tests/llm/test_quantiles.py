import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import quantiles as qt

FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def frame(spark, groups):
    rows = [(g, d, v) for (g, d), vs in groups.items() for v in vs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g long, day long, v double").repartition(5)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(4)
    out = {(1, d): rng.lognormal(6, 2, 4000).tolist() for d in range(3)}
    out[2, 0] = rng.normal(0, 50, 500).tolist() + [0.0, -0.0, 1e-30, 1e300, -1e300]
    out[3, 1] = [5.0] * 300 + [8.0]
    out[4, 2] = [2.0**k for k in range(-70, 62)]
    out[None, 0] = [7.0, 9.0]
    out[5, 0] = [float("nan"), float("inf"), float("-inf"), None]
    return out


def check(rows, values, eps):
    """Bounds hold the true value; the estimate's rank is within eps of the wanted one, but for the cell's width."""
    for r in rows:
        v = np.sort(values[r["g"]])
        true = np.quantile(v, r["fraction"]) if np.isfinite(v).all() else None
        assert r["n_values"] == len(v)
        assert r["lower"] <= true <= r["upper"], (r, true)
        at, width = r["fraction"] * (len(v) - 1), 2.0**-6
        low, high = np.searchsorted(v, r["estimate"] - abs(r["estimate"]) * width, "left"), np.searchsorted(v, r["estimate"] + abs(r["estimate"]) * width, "right")
        assert low - eps * len(v) - 1 <= at <= high + eps * len(v) + 1, (r, at, low, high)


def by_group(groups):
    out: dict = {}
    for (g, _), vs in groups.items():
        known = [v for v in vs if v is not None and np.isfinite(v)]
        if known:
            out.setdefault(g, []).extend(known)
    return out


@pytest.mark.parametrize("eps", [0.005, 0.1])
def test_bounds_and_merging(spark, groups, eps):
    df, values = frame(spark, groups), by_group(groups)
    whole = qt.percentiles(qt.digest(df, ["g"], F.col("v"), eps), ["g"], FRACTIONS, eps).collect()
    assert len(whole) == len(values) * len(FRACTIONS)
    check(whole, values, eps)
    daily = qt.digest(df, ["g", "day"], F.col("v"), eps)
    merged = qt.percentiles(qt.merge(daily, ["g"], eps), ["g"], FRACTIONS, eps).collect()
    assert len(merged) == len(whole)
    check(merged, values, eps)


def test_digests_are_small_and_complete(spark, groups):
    eps = 0.05
    for r in qt.digest(frame(spark, groups), ["g"], F.col("v"), eps).collect():
        assert sum(r["counts"]) == r["n_values"] and len(set(r["nodes"])) == len(r["nodes"])
        limit = r["n_values"] // (-(-qt.DEPTH // eps))
        assert all(c <= max(limit, 0) for v, c in zip(r["nodes"], r["counts"]) if 1 < v < (1 << qt.DEPTH))
        assert len(r["nodes"]) <= 3 * (qt.DEPTH / eps + 1)


def test_cells_are_ordered_and_bound_their_values(spark):
    rng = np.random.default_rng(0)
    v = np.unique(np.concatenate([rng.normal(0, 1, 300), 2.0 ** np.arange(-80, 80), -(2.0 ** np.arange(-80, 80)), rng.lognormal(0, 30, 300), [0.0]]))
    cells = [r[0] for r in spark.createDataFrame([(float(x),) for x in v], "v double").select(qt.cell(F.col("v"))).collect()]
    assert cells == sorted(cells) and 0 < min(cells) and max(cells) < 1 << qt.DEPTH
    low, high = qt.cell_bounds(np.array(cells))
    assert (low <= v).all() and (v <= high).all()


def test_groups_split_over_batches_and_empty(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i % 9, i % 2, float(i)) for i in range(900)], "g long, day long, v double")
        d = qt.digest(df, ["g", "day"], F.col("v"), 0.2).collect()
        assert len(d) == 18 and {r["n_values"] for r in d} == {50} and all(sum(r["counts"]) == 50 for r in d)
        none = qt.digest(df.where("false"), ["g"], F.col("v"))
        assert none.count() == 0 and qt.percentiles(none, ["g"], (0.5,)).count() == 0 and qt.merge(none, ["g"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
