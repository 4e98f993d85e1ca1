import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import sampling as sp

TARGETS = "category long, target_share double, min_rows long, observed string, lo double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, 2).when(F.col("id") % 1000 == 2, 3).when(F.col("id") % 100 == 7, None).otherwise(4).cast("long").alias("category"), F.lit(1).alias("wanted"), F.lit("x").alias("u"))


def test_counts_are_exact_and_deficits_reported(spark, rows):
    targets = spark.createDataFrame([(1, 0.3, 20, "x", 0.5), (2, 0.2, 20, "x", 0.5), (3, 0.001, 500, "x", 0.5), (4, 0.4, 0, "x", 0.5), (9, 0.1, 5, "x", 0.5), (None, 0.1, 5, "x", 0.5), (4, None, None, "x", 0.5)], TARGETS)
    planned = sp.plan(rows, targets, size_share=1 / 4)
    sample = sp.draw(rows, planned, 7)
    seen = {r["category"]: r["observed"] for r in planned.collect()}
    assert sample.count() == sample.select("id").distinct().count()
    report = {r["category"]: r for r in sp.report(planned, sample).collect()}
    for c, share, least in ((1, 0.3, 20), (2, 0.2, 20), (3, 0.001, 500), (4, 0.4, 0), (9, 0.1, 5)):
        need = max(least, share * 5000)
        got = report[c]
        assert got["required"] == pytest.approx(need) and got["sampled"] == min(seen[c], -int(-need // 1)) and got["deficit"] == pytest.approx(max(0, need - got["sampled"]))
    assert set(report) == {1, 2, 3, 4, 9} and report[9]["observed"] == 0
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1)
    assert sample.join(rows, ["id", "category"], "left_anti").count() == 0


def test_same_seed_same_sample_and_spread(spark, rows):
    targets = spark.createDataFrame([(1, 0.5, 0), (4, 0.5, 0)], "category long, target_share double, min_rows long")
    planned = sp.plan(rows, targets, size=3000)
    a, b, c = ({r["id"] for r in sp.draw(rows, planned, s).collect()} for s in (1, 1, 2))
    assert a == b and a != c and len(a) == len(c) == 3000
    assert 0.4 < sum(i < 10_000 for i in a) / 3000 < 0.6


def test_empty(spark, rows):
    targets = spark.createDataFrame([(1, 0.5, 3)], "category long, target_share double, min_rows long")
    planned = sp.plan(rows.where("false"), targets, size_share=0.5)
    assert sp.draw(rows.where("false"), planned).count() == 0
    r = sp.report(planned, sp.draw(rows.where("false"), planned)).first()
    assert (r["observed"], r["sampled"], r["deficit"], r["reached_share"]) == (0, 0, 3.0, None)
    assert sp.plan(rows, targets.where("false"), size_share=0.5).count() == 0
