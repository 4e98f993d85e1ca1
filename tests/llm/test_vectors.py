import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import neighbours as nb
from gaugeworks.llm import varied as vr
from gaugeworks.operators import vector_blocks as vx

DIM = 16
SCHEMA = "vid long, emb array<float>, lab boolean, id string, n int, rep string"


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, DIM))
    x = np.repeat(centres, 12, axis=0) + rng.normal(size=(480, DIM)) * np.repeat(rng.choice([0.02, 0.08, 0.2], 40), 12)[:, None]
    x = np.concatenate([x, rng.normal(size=(500, DIM))]).astype("float32")
    x[100] = x[5]
    x[900:930] = x[17]
    x[930] = x[3] * 4
    return x


@pytest.fixture(scope="module")
def frame(spark, points):
    rows = [(i, [float(v) for v in r], i % 5 == 0, "x", 1, "y") for i, r in enumerate(points)]
    rows += rows[:40]
    rows += [(5000, None, False, "x", 1, "y"), (5001, [], False, "x", 1, "y"), (5002, [1.0] * 15, False, "x", 1, "y"), (5003, [0.0] * 16, False, "x", 1, "y"), (5004, [float("nan")] + [1.0] * 15, False, "x", 1, "y")]
    rows += [(5005, [float("inf")] + [1.0] * 15, None, "x", 1, "y"), (5006, [None] + [1.0] * 15, None, "x", 1, "y"), (None, [1.0] * 16, None, "x", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def similarities(points):
    u = unit(points.astype("float64"))
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return s


def test_codes_bound_the_cosine(points):
    u = unit(points.astype("float64"))
    b = vx.Block(np.arange(len(u)), [p.tobytes() for p in vx.encode(u)], DIM)
    s = similarities(points)
    i, j, sims, bound = vx.tile_pairs(b, b, 0.5, None)
    assert (np.abs(sims - s[i, j]) <= bound + 1e-9).all() and bound.max() < 1e-3
    want = {(a, c) for a, c in zip(*np.nonzero(s >= 0.5 + 1e-3))}
    assert want <= set(zip(i.tolist(), j.tolist()))
    i, j, sims, bound = vx.tile_pairs(b, b, None, 3)
    for a in range(0, len(u), 37):
        best = np.sort(s[a])[::-1][:3]
        assert np.allclose(np.sort(s[a, j[i == a]])[::-1][:3], best)
    # sizes far from 1 neither overflow nor vanish
    import pyarrow as pa

    rows, m = vx.unpack_lists(pa.array([[1e38] * DIM, [1e-40] * DIM, [0.0] * DIM], pa.list_(pa.float32())), DIM)
    assert rows.tolist() == [0, 1] and np.allclose(vx.normalised(m), 0.25)


@pytest.mark.parametrize("cut", [8192, 40])
def test_mutual_neighbours(frame, points, monkeypatch, cut):
    monkeypatch.setattr(vx, "CELL_CLASSES", 64)
    monkeypatch.setattr(vx, "TILE_CLASSES", cut)
    s = np.round(similarities(points), 9)
    top = [set(np.lexsort((np.arange(len(s)), -s[i]))[:5].tolist()) for i in range(len(s))]
    want = {(i, j) for i in range(len(s)) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.9}
    rows = nb.mutual_neighbours(frame, "vid", "emb", 5, 0.9, DIM).collect()
    got = {(r["a"], r["b"]) for r in rows}
    assert len(got) == len(rows)
    # ties of equal vectors in either rounding may be ordered differently; all others must agree
    tied = set(range(900, 931)) | {17, 3, 5, 100}
    plain = lambda pairs: {p for p in pairs if not tied & set(p)}
    assert plain(got) <= plain(want) and len(plain(want) - plain(got)) <= 0.01 * len(plain(want))
    crowd = {(a, b) for a, b in got if a in range(900, 930) or b in range(900, 930)}
    assert crowd and all(a in (17, *range(900, 906)) and b in range(900, 906) for a, b in crowd)


@pytest.mark.parametrize("pivots", [2, 6])
def test_parts_of_cells_keep_neighbours_together(frame, points, monkeypatch, pivots):
    monkeypatch.setattr(vx, "CELL_CLASSES", 32)
    monkeypatch.setattr(vx, "MAX_PIVOTS", pivots)
    s = np.round(similarities(points), 9)
    top = [set(np.lexsort((np.arange(len(s)), -s[i]))[:5].tolist()) for i in range(len(s))]
    want = {(i, j) for i in range(len(s)) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.9 and i < 480}
    got = {(r["a"], r["b"]) for r in nb.mutual_neighbours(frame, "vid", "emb", 5, 0.9, DIM).collect()}
    assert len(want - got) <= 0.1 * len(want)


def test_directions():
    rng = np.random.default_rng(2)
    p = unit(rng.normal(size=(50, DIM)))
    turned, step = vx.directions(p, 50 * 4 * vx.CELL_CLASSES)
    assert len(turned) == 4 and np.allclose((turned**2).sum(axis=1), 1) and step > 0
    assert vx.directions(p, 50 * vx.CELL_CLASSES) is None and vx.directions(np.repeat(p[:1], 9, axis=0), 10**6) is None and vx.directions(p[:0], 10**6) is None


def test_search_recall(frame, points):
    s = similarities(points)
    rows = nb.nearest(frame, "vid", "emb", 5, F.col("vid") % 10 == 0, DIM, probes=48).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["a"], {})[r["b"]] = r["cosine"]
        assert r["cosine"] == pytest.approx(s[r["a"], r["b"]], abs=1e-6)
    assert set(got) == {i for i in range(len(s)) if i % 10 == 0}
    least = {a: np.sort(s[a])[::-1][4] for a in got}
    hits = sum(sum(c >= least[a] - 1e-9 for c in found.values()) for a, found in got.items())
    assert hits / (5 * len(got)) >= 0.9 and all(len(f) == 5 for f in got.values())


def test_label_agreement(spark):
    near = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1), (2, 9)], "a long, b long")
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 5), (4, 5), (9, None)], "id long, label long")
    got = {r["id"]: r for r in nb.label_agreement(near, labels).collect()}
    assert got[1]["agreement"] == pytest.approx(1 / 3) and got[1]["suggested"] == 5
    assert got[2]["agreement"] == 0.5 and got[2]["suggested"] == 7


@pytest.mark.parametrize("least, floor", [(8, 0.95), (11, 0.9), (1, 0.9)])
def test_crowded(frame, points, least, floor):
    s = similarities(points)
    want = {i for i in range(len(s)) if i % 5 and (s[i] >= floor).sum() >= least}
    got = [r["id"] for r in vr.crowded(frame, "vid", "emb", "lab", least, floor, DIM).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.01 * len(want)
    assert set(range(900, 930)) & {i for i in want} <= set(got)


def test_choose_covers_groups_and_passes_over_labelled_ones(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(DIM)[:10]
    sizes = [300, 40, 40, 20, 20, 10, 10, 10, 5, 5]
    rows, n = [], 0
    for g, size in enumerate(sizes):
        for _ in range(size):
            v = centres[g] + rng.normal(size=DIM) * 0.01
            rows.append((n, [float(a) for a in v], g in (1, 4) and n % 2 == 0, "x", g, "y"))
            n += 1
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    group = {r[0]: r[4] for r in rows}
    labelled = {r[0] for r in rows if r[2]}
    got = [r["id"] for r in vr.choose(df, "vid", "emb", "lab", 8, DIM).collect()]
    assert sorted(group[i] for i in got) == [0, 2, 3, 5, 6, 7, 8, 9] and not labelled & set(got)
    more = [r["id"] for r in vr.choose(df, "vid", "emb", "lab", 10, DIM).collect()]
    assert len(set(more)) == 10
    assert vr.choose(df, "vid", "emb", "lab", 0, DIM).count() == 0


@pytest.mark.parametrize("k, slices", [(150, 65_536), (150, 60), (300, 65_536), (5000, 65_536)])
def test_choose_gives_as_many_as_asked(frame, points, monkeypatch, k, slices):
    monkeypatch.setattr(vr, "MAX_ENTRIES", 512)
    monkeypatch.setattr(vr, "SLICE_ROWS", slices)
    rows = vr.choose(frame, "vid", "emb", "lab", k, DIM).collect()
    free = [i for i in range(len(points)) if i % 5]
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids)) == min(k, len(free)) and set(ids) <= set(free)
    # each unlabelled vector is about as near to a chosen or labelled one as farthest-first picks would be
    u = unit(points.astype("float64"))
    far = lambda chosen: np.sqrt(np.maximum(2 - 2 * (u[free] @ u[chosen].T).max(axis=1), 0))
    labelled = [i for i in range(len(points)) if i % 5 == 0]
    picks, d = [], far(labelled)
    for _ in range(len(ids)):
        picks.append(free[int(d.argmax())])
        d = np.minimum(d, far(picks[-1:]))
    assert far(labelled + ids).mean() <= 1.3 * far(labelled + picks).mean() + 1e-9


def test_records_next_to_centres_fill_up(frame, points):
    # all vectors are in two groups of copies
    assert vr.least_rank([(3, 2), (1, 5)], 9) == 2 and vr.least_rank([(3, 2), (1, 5)], 99) == 3 and vr.least_rank([], 4) == 1
    copies = frame.where("vid between 900 and 929 or vid = 17 or vid = 3 or vid = 930")
    ids = {r["id"] for r in vr.choose(copies, "vid", "emb", "lab", 20, DIM).collect()}
    assert len(ids) == 20 and not any(i % 5 == 0 for i in ids)


def test_ward_merges_nearest_first():
    n, c = np.array([1.0, 1, 1, 5]), np.array([[0.0, 0], [0, 0.1], [5, 5], [5, 5.2]])
    merges = vr.ward(n, c)
    assert [(a, b) for _, a, b in merges] == [(0, 1), (2, 3), (0, 2)]


def test_summary_keeps_crowded_places(points):
    s = vr.Summary(DIM, 60)
    u = unit(points.astype("float64"))
    for i in range(0, len(u), 100):
        part = u[i : i + 100]
        s.add(np.ones(len(part)), np.zeros(len(part)), part, np.full(len(part), vr.START_THRESHOLD))
    assert len(s.n) <= 60 and s.n.sum() == len(u) and np.allclose(s.ls.sum(axis=0), u.sum(axis=0))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nb.mutual_neighbours(none, "vid", "emb", 5, 0.9, DIM).count() == 0
    assert nb.nearest(none, "vid", "emb", 5, None, DIM).count() == 0
    assert vr.crowded(none, "vid", "emb", "lab", 2, 0.9, DIM).count() == 0
    assert vr.choose(none, "vid", "emb", "lab", 3, DIM).count() == 0


@pytest.fixture
def small_cells(monkeypatch):
    """Some 250 cells of four rows, as many cells as large tables have."""
    plain = vx.pivots_by_hash
    monkeypatch.setattr(vx, "pivots_by_hash", lambda *a: plain(*a, per_cell=4))
    monkeypatch.setattr(vx, "CELL_CLASSES", 4)
    monkeypatch.setattr(vx, "TILE_CLASSES", 200)
    monkeypatch.setattr(vx, "REGION_CLASSES", 50, raising=False)


def test_search_is_exact_with_many_cells(frame, points, small_cells):
    s = similarities(points)
    rows = nb.nearest(frame, "vid", "emb", 5, F.col("vid") % 10 == 0, DIM, probes=2).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["a"], []).append(s[r["a"], r["b"]])
    assert set(got) == {i for i in range(len(s)) if i % 10 == 0}
    for a, found in got.items():
        assert np.allclose(np.sort(found)[::-1], np.sort(s[a])[::-1][:5], atol=1e-9)


@pytest.mark.parametrize("least, floor", [(8, 0.9), (3, 0.8)])
def test_crowded_is_exact_with_many_cells_and_nothing_settled(frame, points, small_cells, monkeypatch, least, floor):
    monkeypatch.setattr(vr.Summary, "dense", lambda self: np.empty((0, DIM)))
    s = similarities(points)
    want = {i for i in range(len(s)) if i % 5 and (s[i] >= floor).sum() >= least}
    got = [r["id"] for r in vr.crowded(frame, "vid", "emb", "lab", least, floor, DIM).collect()]
    assert sorted(got) == sorted(want)
