import random

import pytest
from test_coco_stats import ANN, dataset

from gaugeworks.functions.expr import iou
from gaugeworks.operators import checks as ck
from gaugeworks.sources.coco import read_coco


def kinds(data, **options):
    return sorted((r["ann_id"], r["issue_type"]) for r in ck.all_issues(data, **options).collect())


def test_clean_data_has_no_errors(spark, coco_file):
    assert ck.all_issues(read_coco(spark, coco_file)).where("severity = 'error'").count() == 0


def test_each_issue(spark):
    boxes = [
        [90.0, 90.0, 50.0, 50.0], [10.0, 10.0, 1.0, 1.0], None, [1.0, 2.0, 3.0], [5.0, 5.0, 0.0, 3.0], [0.0, 0.0, 101.0, 101.0],
        [0.0, 0.0, 101.1, 5.0], [-0.1, 0.0, 5.0, 5.0], [], [1.0, None, 2.0, 2.0], [9.0, 9.0, -1.0, -2.0], [40.0, 40.0, 2.0, 2.0],
    ]
    data = dataset(spark, [(1, 100, 100)], [(1, "a")], [(1, 1, b) for b in boxes])
    assert kinds(data) == sorted([(0, "out_of_bounds"), (1, "tiny_box"), (2, "missing_bbox"), (3, "malformed_bbox"), (4, "degenerate_bbox"), (6, "out_of_bounds"), (7, "out_of_bounds"), (8, "malformed_bbox"), (10, "tiny_box"), (10, "degenerate_bbox")])


def test_sizes_unknown_images_and_categories(spark):
    far = [90.0, 90.0, 50.0, 50.0]
    data = dataset(spark, [(1, None, 100)], [(1, "a")], [(1, 1, far), (2, 1, far), (1, 5, far), (1, None, far), (None, 1, far)])
    assert kinds(data) == [(2, "unknown_category"), (3, "unknown_category")]


def brute_pairs(rows, least):
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[2] == b[2] and None not in (a[1], a[2]):
                (x, y, w, h), (u, v, s, t) = a[3], b[3]
                i = max(0, min(x + w, u + s) - max(x, u)) * max(0, min(y + h, v + t) - max(y, v))
                if w > 0 and h > 0 and s > 0 and t > 0 and i / (w * h + s * t - i) >= least:
                    out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("least", [0.2, 0.5, 0.85, 1.0])
def test_overlaps_match_brute_force(spark, least):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        if rows and rng.random() < 0.6:
            b = [v + rng.uniform(-3, 3) * (rng.random() < 0.8) for v in rng.choice(rows)[3]]
        else:
            b = [rng.uniform(-50, 200), rng.uniform(-50, 200), rng.uniform(0.5, 120), rng.uniform(0.5, 120)]
        rows.append((n, rng.choice([1, 1, 1, 2, None]), rng.choice([1, 2]), b))
    df = spark.createDataFrame([(n, i, c, b, None, 0, n) for n, i, c, b in rows], ANN)
    got = [(r["ann_id"], r["partner_id"]) for r in ck.overlapping_pairs(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, least)


def test_iou_values(spark):
    pairs = [([0.0, 0.0, 2.0, 2.0], [0.0, 0.0, 2.0, 2.0], 1.0), ([0.0, 0.0, 1.0, 1.0], [5.0, 5.0, 1.0, 1.0], 0.0), ([0.0, 0.0, 2.0, 2.0], [1.0, 0.0, 2.0, 2.0], 1 / 3), ([], [], 0.0), ([0.0] * 4, [0.0] * 4, 0.0)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in pairs], "a array<double>, b array<double>, w double")
    for r in df.withColumn("got", iou("a", "b")).collect():
        assert r["got"] == pytest.approx(r["w"])


def test_duplicates_report_and_bad_threshold(spark):
    data = dataset(spark, [(1, 500, 500)], [(1, "a"), (2, "b")], [(1, 1, [10.0, 10.0, 100.0, 100.0]), (1, 1, [11.0, 11.0, 99.0, 99.0]), (1, 2, [10.0, 10.0, 100.0, 100.0])])
    r = ck.near_duplicates(data, 0.5).collect()
    assert [(x["ann_id"], x["partner_id"], x["severity"]) for x in r] == [(0, 1, "warning")]
    report = ck.check_report(ck.all_issues(data))
    assert report["total_issues"] == 1 and report["by_type"] == {"near_duplicate": 1} and report["by_severity"] == {"warning": 1}
    with pytest.raises(ValueError):
        ck.overlapping_pairs(data.annotations, 0.0)


def test_crowded_image_gives_the_same_issues(spark):
    data = dataset(spark, [(i, 100, 100) for i in range(50)], [(1, "a")], [(0 if n % 2 else n % 50, 1, [99.0, 99.0, 5.0, float(n % 3)]) for n in range(600)])
    got = ck.simple_issues(data).groupBy("issue_type").count().collect()
    assert {r["issue_type"]: r["count"] for r in got} == {"out_of_bounds": 600, "degenerate_bbox": 200}


def test_streamed_checks_equal_batch(spark, tmp_path):
    from gaugeworks.streaming.issues import stream_issues

    data = dataset(spark, [(1, 100, 100)], [(1, "a")], [(1, 1, [90.0, 90.0, 50.0, 50.0]), (1, 7, None)])
    data.annotations.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.annotations.schema).parquet(str(tmp_path / "in"))
    q = stream_issues(stream, data.images, data.categories).writeStream.format("memory").queryName("issues").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["ann_id"], r["issue_type"]) for r in spark.table("issues").collect())
    assert got == kinds(data) == [(0, "out_of_bounds"), (1, "missing_bbox"), (1, "unknown_category")]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.85, 1.0])
def test_overlaps_on_crowded_images_match_brute_force(spark, least):
    rng = random.Random(8)
    rows = []
    for n in range(500):
        if rows and rng.random() < 0.6:
            b = [v + rng.uniform(-3, 3) * (rng.random() < 0.5) for v in rng.choice(rows)[3]]
        else:
            b = [rng.uniform(-50, 200), rng.uniform(-50, 200), rng.uniform(0.5, 120), rng.uniform(0.5, 120)]
        rows.append((n, rng.choice([1, 1, 1, 2]), rng.choice([1, 2]), b))
    df = spark.createDataFrame([(n, i, c, b, None, 0, 500 - n) for n, i, c, b in rows], ANN)
    got = [(r["partner_id"], r["ann_id"]) for r in ck.overlapping_pairs(df, least, crowded=150).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, least)


def test_boxes_of_a_crowded_image_are_not_repeated_for_each_size(spark):
    # the rows that are shuffled: at 0.5 each box was sent to some thirty cells
    rng = random.Random(2)
    rows = [(n, n // 5, 1, [rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(20, 90), rng.uniform(20, 90)], None, 0, n) for n in range(1000)]
    pairs = ck.overlapping_pairs(spark.createDataFrame(rows, ANN), 0.5)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_near_duplicates_join_no_grid_of_cells(spark):
    # of a pair either box may be the left one; the plan joins images only, not boxes with boxes
    boxes = [[10.0, 10.0, 50.0, 50.0], [8.0, 11.0, 50.0, 50.0], [10.0, 10.0, 50.0, 50.0], [200.0, 10.0, 50.0, 50.0], [float("nan"), 1.0, 2.0, 2.0]]
    data = dataset(spark, [(1, 400, 400)], [(1, "a")], [(1, 1, b) for b in boxes] + [(2, 1, boxes[0]), (2, 1, boxes[0])])
    found = ck.near_duplicates(data, 0.85)
    assert sorted((r["ann_id"], r["partner_id"]) for r in found.collect()) == [(0, 1), (0, 2), (1, 2)]
    assert "explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
