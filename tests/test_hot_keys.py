import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import hot_keys as hk


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(1, rng.randrange(200)) for _ in range(3000)] + [(k, rng.randrange(5)) for k in range(2, 40) for _ in range(20)] + [(None, 3)] * 10 + [(7, None)] * 5
    return data, spark.createDataFrame(data, "k long, v long").repartition(6)


def test_profile_matches_brute_force(rows):
    data, df = rows
    got = {r["k"]: r for r in hk.key_profile(hk.compress_values(df, ["k"], "v"), ["k"], "v").collect()}
    for k in {k for k, _ in data if k is not None}:
        values = [v for q, v in data if q == k]
        known = [v for v in values if v is not None]
        mode = min(known, key=lambda v: (-known.count(v), v))
        assert (got[k]["n_rows"], got[k]["n_null"], got[k]["n_distinct"], got[k]["mode"], got[k]["mode_rows"]) == (len(values), len(values) - len(known), len(set(known)), mode, known.count(mode))
    assert None not in got


@pytest.mark.parametrize("interpolate", [True, False])
def test_percentiles_match_numpy(rows, interpolate):
    data, df = rows
    fractions = (0.0, 0.1, 0.5, 0.93, 1.0)
    out = hk.weighted_percentiles(hk.compress_values(df, ["k"], "v"), ["k"], "v", fractions, interpolate).collect()
    assert len(out) == len(fractions) * len({k for k, _ in data if k is not None})
    for r in out:
        known = sorted(v for q, v in data if q == r["k"] and v is not None)
        want = np.quantile(known, r["fraction"]) if interpolate else known[max(0, math.ceil(r["fraction"] * len(known)) - 1)]
        assert r["percentile"] == pytest.approx(want) and r["n_rows"] == len(known)


def test_hot_keys_reports_each_field_by_itself(spark):
    df = spark.createDataFrame([(1, i % 7) for i in range(70)] + [(None, None)] * 30, "a long, b long")
    pairs = df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["key_field"], r["key_value"], r["n_rows"]) for r in hk.hot_keys(pairs, ("a", "b"), 0.1).collect()}
    assert got == {("a", 1, 70)} | {("b", v, 10) for v in range(7)}
    assert hk.hot_keys(pairs, ("a", "b"), 0.11).count() == 1


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k long, v long, n string, fraction string")
    c = hk.compress_values(empty, ["k"], "v")
    assert hk.key_profile(c, ["k"], "v").count() == 0
    assert hk.weighted_percentiles(c, ["k"], "v", (0.5,)).count() == 0
    full = spark.createDataFrame([(1, 5, "x", "y"), (1, 7, "x", "y")], empty.schema)
    assert hk.weighted_percentiles(hk.compress_values(full, ["k"], "v"), ["k"], "v", (0.5,)).first()["percentile"] == 6.0


def test_near_ranks_keep_the_percentiles_and_few_values(spark):
    rng = np.random.default_rng(4)
    values = [*rng.lognormal(3, 2, 300).tolist(), *(-rng.lognormal(0, 3, 300)).tolist(), *[0.0, -0.0, 7.5, 7.5] * 20, 1e-320, -1e-320, 1e308]
    rows = [("a", v) for v in values] + [("b", 2.0), ("b", 9.0), ("c", 5.0), ("c", float("inf")), ("b", None), (None, 1.0)]
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    buckets, compressed = hk.near_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", fractions)
    got = {(r["k"], r["fraction"]): r["percentile"] for r in hk.weighted_percentiles(compressed, ["k"], "v", fractions).collect()}
    assert [got["a", q] for q in fractions] == pytest.approx(np.percentile(values, [100 * q for q in fractions]))
    assert (got["b", 0.0], got["b", 0.5], got["b", 1.0], got["c", 0.0]) == (2.0, 5.5, 9.0, 5.0) and len(got) == 15
    whole = {r["k"]: r for r in buckets.groupBy("k").agg(F.sum("n").alias("n"), F.min("min").alias("lo"), F.max("max").alias("hi")).collect()}
    assert set(whole) == {"a", "b", "c"} and (whole["a"]["n"], whole["a"]["lo"], whole["a"]["hi"]) == (len(values), min(values), max(values)) and whole["b"]["n"] == 2 and whole["c"]["hi"] == float("inf")
    assert compressed.where("k = 'a'").agg(F.sum("n")).first()[0] == len(values)
