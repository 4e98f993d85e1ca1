import math

import numpy as np
import pytest

from gaugeworks.operators import label_quality as lq
from gaugeworks.operators import mislabel as ml
from gaugeworks.operators import neighbors as nn

PROBS = "id long, label int, probs array<double>"


def frame(spark, p, labels):
    return spark.createDataFrame([(i, int(y), [float(v) for v in r]) for i, (r, y) in enumerate(zip(p, labels))], PROBS)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(42)
    p = rng.dirichlet(np.ones(5), 100)
    return p, rng.integers(0, 5, 100), None


def test_scores_match_numpy(spark, case):
    p, y, _ = case
    df = frame(spark, p, y)
    own, n = p[np.arange(100), y], np.arange(100)
    h = -(p * np.log(p)).sum(axis=1)
    want = {"self_confidence": own, "normalized_margin": (own - p.max(axis=1) + 1) / 2, "entropy_weighted": own * (1 - h / math.log(5 + 1e-9))}
    for method in lq.METHODS:
        got = {r["id"]: r["score"] for r in lq.quality_scores(df, method).collect()}
        assert np.allclose([got[i] for i in n], want[method])
    assert lq.issue_mask(df, 0.2).where("is_issue").count() == int((own < 0.2).sum())
    ranked = lq.ranked_issues(df, top_k=20).collect()
    assert [r["id"] for r in ranked] == np.argsort(own, kind="stable")[:20].tolist()
    assert all(r["predicted_label"] == p[r["id"]].argmax() for r in ranked)


def test_joint_and_summary_match_numpy(spark, case):
    p, y, _ = case
    t = np.array([p[y == k, k].mean() if (y == k).any() else 0.5 for k in range(5)])
    joint = np.zeros((5, 5))
    for r, k in zip(p, y):
        joint[k] += r >= t
    df = frame(spark, p, y)
    got = {(r["given"], r["likely"]): (r["n"], r["share"]) for r in lq.confident_joint(df, 5).collect()}
    assert all(got[i, j] == (joint[i, j], pytest.approx(joint[i, j] / joint.sum())) for i in range(5) for j in range(5)) and len(got) == 25
    s = lq.quality_summary(df, 5).first()
    assert s["estimated_error_rate"] == pytest.approx(1 - np.trace(joint) / joint.sum(), abs=1e-6)


def test_perfect_labels_zero_probabilities_and_errors(spark):
    eye = np.eye(4)[np.arange(40) % 4]
    df = frame(spark, eye, np.arange(40) % 4)
    assert {r["score"] for r in lq.quality_scores(df, "entropy_weighted").collect()} == {1.0}
    assert lq.validate(df) == 4
    assert {r["threshold"] for r in lq.class_thresholds(df, 6).collect()} == {1.0, 0.5}
    for bad in ([(1, 0, [0.5, 0.5]), (2, 0, [1.0])], [(1, 2, [0.5, 0.5])], [(1, -1, [0.5, 0.5])], [(1, None, [1.0])]):
        with pytest.raises(ValueError):
            lq.validate(spark.createDataFrame(bad, PROBS))
    with pytest.raises(ValueError):
        lq.score("none")
    none = spark.createDataFrame([], PROBS)
    assert lq.validate(none) == 0 and lq.quality_summary(none, 3).first()["estimated_error_rate"] == 1.0


def vectors(spark, x, y):
    return spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (r, k) in enumerate(zip(x, y))], "id long, label int, embedding array<float>")


@pytest.mark.parametrize("block", [4096, 37])
def test_neighbours_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nn, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(150, 8)).astype("float32"), rng.integers(0, 4, 150)
    x[20] = x[3]
    x[90] = x[3]
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -np.inf)
    want = {i: np.lexsort((np.arange(150), -s[i]))[:6].tolist() for i in range(150)}
    rows = nn.exact_neighbours(vectors(spark, x, y), 6, "euclidean").collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    assert got == want


def test_detector(spark):
    rng = np.random.default_rng(99)
    y = np.arange(80) % 4
    x = np.eye(4)[y] + rng.normal(size=(80, 4)) * 0.01
    y = y.copy()
    y[5] = (y[5] + 1) % 4
    d = ml.MislabelDetector(vectors(spark, x, y), 10)
    knn = {r["id"]: r["knn_score"] for r in ml.knn_quality(d.neighbours).collect()}
    assert np.mean(list(knn.values())) > 0.9 and knn[5] == 0.0
    top = d.candidates(3).collect()
    assert top[0]["id"] == 5 and top[0]["suggested_label"] == 1 and top[0]["given_label"] == y[5] and sum(top[0]["neighbour_counts"]) == 10
    assert [r["score"] for r in top] == sorted(r["score"] for r in top)
    assert d.scores("prototype").count() == 80 and d.scores("anything").count() == 80
    assert d.summary()["flagged_count"] == 1 and len(d.summary()["top_candidates"]) == 10
    d.close()
    p = np.abs(x) / np.abs(x).sum(axis=1)[:, None]
    assert ml.MislabelDetector.from_probabilities(frame(spark, p, y), 5).scores("knn").count() == 80


def test_neighbour_errors(spark):
    df = vectors(spark, np.eye(3), [0, 1, 2])
    with pytest.raises(ValueError):
        nn.exact_neighbours(df, 3)
    with pytest.raises(ValueError):
        nn.exact_neighbours(df, 1, "manhattan")
    assert nn.exact_neighbours(df.where("false"), 3).count() == 0
