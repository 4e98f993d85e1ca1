import numpy as np
import pytest

from gaugeworks.operators import diversity as dv
from gaugeworks.operators import neighbors as nn
from gaugeworks.operators import vector_blocks as vx

DIM = 8
SCHEMA = "id long, label int, embedding array<float>, v string, rep int"


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.normal(size=(12, DIM)), 20, axis=0) + rng.normal(size=(240, DIM)) * 0.1, rng.normal(size=(160, DIM))]).astype("float32")
    x[100:110] = x[7]
    return x


@pytest.fixture(scope="module")
def frame(spark, points):
    rows = [(i, i % 4, [float(a) for a in r], "x", 1) for i, r in enumerate(points)]
    rows += rows[:30]
    bad = [None, [], [1.0] * 7, [0.0] * DIM, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]
    rows += [(9000 + i, None, b, "x", 1) for i, b in enumerate(bad)] + [(None, 1, [1.0] * DIM, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def cosines(x):
    u = x.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T


@pytest.mark.parametrize("blocks", [4096, 100])
@pytest.mark.parametrize("all_pairs", [16_384, 0])
def test_neighbours_of_dirty_rows(frame, points, monkeypatch, blocks, all_pairs):
    monkeypatch.setattr(nn, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(nn, "ALL_PAIRS_ROWS", all_pairs)
    monkeypatch.setattr(vx, "CELL_CLASSES", 20)
    monkeypatch.setattr(vx, "REGION_CLASSES", 50)
    s = np.round(cosines(points), 9)
    np.fill_diagonal(s, -np.inf)
    got: dict = {}
    for r in sorted(nn.exact_neighbours(frame, 6).collect(), key=lambda r: (r["id"], r["rank"])):
        assert r["similarity"] == pytest.approx(s[r["id"], r["neighbour_id"]], abs=1e-6) and r["label"] == r["id"] % 4 and r["neighbour_label"] == r["neighbour_id"] % 4
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    assert set(got) == set(range(400)) and all(len(set(v)) == 6 for v in got.values())
    for i, found in got.items():
        assert np.allclose(np.sort(s[i, found])[::-1], np.sort(s[i])[::-1][:6], atol=1e-9)
    assert got[100][:6] == [7, 101, 102, 103, 104, 105]


@pytest.mark.parametrize("all_pairs", [16_384**2, 0])
def test_distances_and_picks_of_dirty_rows(frame, points, monkeypatch, all_pairs):
    monkeypatch.setattr(dv, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(vx, "CELL_CLASSES", 20)
    monkeypatch.setattr(dv, "OFFERS", 3)
    monkeypatch.setattr(dv, "FAN_IN", 2)
    monkeypatch.setattr(dv, "WRITE_AFTER", 4)
    some, others = frame.where("coalesce(id, 9001) % 5 = 0"), frame.where("coalesce(id, 9001) % 5 <> 0")
    a, b = [i for i in range(400) if i % 5], [i for i in range(400) if i % 5 == 0]
    want = (1 - np.clip(cosines(points)[np.ix_(a, b)], -1, 1)).min(axis=1)
    got = {r["id"]: r["distance"] for r in dv.min_distance(others, some).collect()}
    assert set(got) == set(a) and np.allclose([got[i] for i in a], want, atol=1e-6)
    d, picks, u = want.copy(), [], points[a].astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    for _ in range(12):
        at = int(d.argmax())
        picks.append(a[at])
        d = np.minimum(d, 1 - np.clip(u @ u[at], -1, 1))
        d[at] = -np.inf
    assert [r["id"] for r in dv.coreset(others, 12, some).orderBy("pick").collect()] == picks
    assert dv.minmax(frame, 999).count() == 400 and dv.coreset(frame.where("id >= 9000"), 3, some, DIM).count() == 0


def test_sizes_and_no_rows(spark, frame):
    assert nn.vector_size(frame) == DIM and nn.vector_size(frame.where("false")) == 0
    none = frame.where("false")
    assert nn.exact_neighbours(none, 3).count() == 0 and dv.min_distance(frame, none).count() == 0 and dv.min_distance(none, frame, DIM).count() == 0
    rows = frame.selectExpr("id", "embedding as v")
    assert nn.nearest(rows.where("false"), rows, 2, DIM).count() == 0


@pytest.mark.parametrize("wide, width", [(True, 1e-3), (False, 0.05)])
def test_codes_bound_cosines(points, wide, width):
    u = points.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    b = vx.Block(np.arange(len(u)), [p.tobytes() for p in vx.encode(u, wide)], DIM)
    s = cosines(points)
    np.fill_diagonal(s, -1)
    i, j, sims, bound = vx.tile_pairs(b, b, 0.7, None)
    assert (np.abs(sims - s[i, j]) <= bound).all() and bound.max() < width
    assert set(zip(*np.nonzero(s >= 0.7))) <= set(zip(i.tolist(), j.tolist()))
    i, j, _, _ = vx.tile_pairs(b, b, None, 4)
    for a in range(len(u)):
        assert set(np.flatnonzero(s[a] > np.sort(s[a])[-4] + 1e-9)) <= set(j[i == a].tolist())


def test_cells_are_divided_only_beyond_the_pivots(points):
    u = points.astype("float64") / np.linalg.norm(points, axis=1)[:, None]
    assert vx.directions(u[:30], 30 * 2 * vx.CELL_CLASSES - 1) is None
    turned, step = vx.directions(u[:30], 30 * 5 * vx.CELL_CLASSES)
    assert turned.shape == (5, DIM) and np.allclose((turned**2).sum(axis=1), 1) and step > 0


@pytest.mark.parametrize("few", [0.01, 1.0, 0.0])
@pytest.mark.parametrize("wide", [True, False])
def test_first_values_bound_products(monkeypatch, wide, few):
    monkeypatch.setattr(vx, "FEW_PAIRS", few)
    rng = np.random.default_rng(9)
    u = np.concatenate([rng.normal(size=(600, 64)), np.repeat(rng.normal(size=(30, 64)), 10, axis=0) + rng.normal(size=(300, 64)) * rng.choice([0.05, 0.3], 300)[:, None]])
    u[:40, 24:] = 0
    u[40:80, :24] = 0
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    b = vx.Block(np.arange(len(u)), [p.tobytes() for p in vx.encode(u, wide)], 64)
    i, j, sims, bound = vx.tile_pairs(b, b, 0.9, None)
    assert (np.abs(sims - s[i, j]) <= bound).all() and set(zip(*np.nonzero(s >= 0.9))) <= set(zip(i.tolist(), j.tolist()))
    i, j, _, _ = vx.tile_pairs(b, b, 0.9, 3)
    for a in range(len(u)):
        assert set(np.flatnonzero((s[a] > np.sort(s[a])[-3] + 1e-9) & (s[a] >= 0.9)).tolist()) <= set(j[i == a].tolist())
    assert len(vx.tile_pairs(b, b, 0.9, 3, others=False)[0]) >= len(u)
