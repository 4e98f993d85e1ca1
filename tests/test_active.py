import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import diversity as dv
from gaugeworks.operators import localization as lz
from gaugeworks.operators import uncertainty as un
from gaugeworks.plans import backends as bk
from gaugeworks.plans.loop import ActiveLearningLoop, LoopConfig, Strategy


def probs(spark, p):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(p)], "id long, probs array<double>")


def rows(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")


def test_uncertainty(spark):
    p = np.random.default_rng(0).dirichlet(np.ones(6), 60)
    s = np.sort(p, axis=1)
    want = {"entropy": -(p * np.log(p)).sum(axis=1), "margin": 1 - (s[:, -1] - s[:, -2]), "least_confidence": 1 - s[:, -1]}
    for method, w in want.items():
        got = [r["id"] for r in un.query(probs(spark, p), 10, method).collect()]
        assert got == sorted(range(60), key=lambda i: (-w[i], -i))[:10]
    flat = un.scores(probs(spark, [[0.2] * 5, [1.0, 0, 0, 0, 0]])).orderBy("id").collect()
    assert flat[0]["score"] == pytest.approx(np.log(5)) and flat[1]["score"] == pytest.approx(0)
    with pytest.raises(ValueError):
        un.scores(probs(spark, p), "none")
    assert un.query(probs(spark, p), 0).count() == 0 and un.query(probs(spark, p), 999).count() == 60


def test_bald(spark):
    m = np.random.default_rng(2).dirichlet(np.ones(4), (10, 30))
    df = spark.createDataFrame([(t, i, m[t, i].tolist()) for t in range(10) for i in range(30)], "pass int, id long, probs array<double>")
    mean = m.mean(axis=0)
    want = np.maximum(0, -(mean * np.log(mean)).sum(axis=1) - (-(m * np.log(m)).sum(axis=2)).mean(axis=0))
    got = {r["id"]: r["score"] for r in un.bald(df).collect()}
    assert np.allclose([got[i] for i in range(30)], want)
    assert un.scores(probs(spark, mean), "bald", df).count() == 30
    assert un.scores(probs(spark, mean), "bald").first()["score"] > 0


def greedy(x, budget, labeled=None, start=None):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.full(len(x), np.inf)
    if labeled is not None:
        v = labeled / np.linalg.norm(labeled, axis=1)[:, None]
        d = (1 - np.clip(u @ v.T, -1, 1)).min(axis=1)
    picks = []
    for _ in range(budget):
        at = start if not picks and start is not None else int(np.argmax(d))
        picks.append(at)
        d = np.minimum(d, 1 - np.clip(u @ u[at], -1, 1))
        d[picks] = -np.inf
    return picks


@pytest.mark.parametrize("offers", [64, 2])
def test_farthest_first_matches_greedy(spark, monkeypatch, offers):
    monkeypatch.setattr(dv, "OFFERS", offers)
    monkeypatch.setattr(dv, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    x, l = rng.normal(size=(120, 6)), rng.normal(size=(70, 6))
    x[50] = x[10]
    df = rows(spark, x).repartition(3)
    got = [r["id"] for r in dv.coreset(df, 12, rows(spark, l, 1000)).orderBy("pick").collect()]
    assert got == greedy(x, 12, l)
    assert [r["id"] for r in dv.coreset(df, 12).orderBy("pick").collect()] == greedy(x, 12, start=0)
    picks = [r["id"] for r in dv.minmax(df, 8, 3).orderBy("pick").collect()]
    assert picks == greedy(x, 8, start=picks[0])


def test_diversity_edges(spark):
    x = np.eye(3)
    df = rows(spark, x)
    assert dv.query(df, 99).count() == 3 and dv.query(df, 0).count() == 0 and dv.query(df, 0, "minmax").count() == 1
    same = rows(spark, np.ones((5, 3)))
    assert dv.query(same, 5).select("id").distinct().count() == 5
    with pytest.raises(ValueError):
        dv.query(df, 1, "none")
    with pytest.raises(ValueError):
        dv.query(df, 1, "cluster_margin")
    assert dv.coreset(df.where("false"), 3).count() == 0 and dv.minmax(df.where("false"), 3).count() == 0


def test_cluster_margin_takes_the_most_uncertain_of_each_cluster(spark):
    x = np.repeat(np.eye(4), 5, axis=0)
    p = np.tile([0.9, 0.1], (20, 1))
    p[[2, 7, 14, 16]] = [0.5, 0.5]
    got = {r["id"] for r in dv.cluster_margin(rows(spark, x), probs(spark, p), 4).collect()}
    assert len(got) <= 4 and got <= {2, 7, 14, 16}


def test_localization(spark):
    rng = np.random.default_rng(0)
    g = rng.normal(size=(20, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(g)], "id long, grad array<double>")
    got = {r["id"]: r["score"] for r in lz.scores("gradient_norm", gradients=df).collect()}
    assert np.allclose([got[i] for i in range(20)], np.linalg.norm(g, axis=1))
    z = rng.normal(size=(5, 9, 4)) * 50
    e = np.exp(z - z.max(axis=2, keepdims=True))
    q = e / e.sum(axis=2, keepdims=True)
    want = -(q * np.log2(np.where(q > 0, q, 1))).sum(axis=2).mean(axis=1)
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "id long, cells array<array<double>>")
    assert np.allclose([r["score"] for r in lz.spatial_entropy(cells).orderBy("id").collect()], want)
    losses = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 2])], "id long, loss double")
    assert [r["id"] for r in lz.query(lz.scores("influence", train_losses=losses), 3).collect()] == [0, 3, 2]
    assert [round(r["score"], 6) for r in lz.influence(losses, losses).orderBy("id").collect()] == [1, 0, 0.5, 0.5]
    for bad in ("none", "gradient_norm"):
        with pytest.raises(ValueError):
            lz.scores(bad)


@pytest.fixture(scope="module")
def backend(spark):
    rng = np.random.default_rng(5)
    features = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(60, 4)))], "id long, features array<double>")

    def forward(m, seed):
        w = np.arange(12).reshape(4, 3) / 10 - 0.5
        return m @ w * (1 if seed is None else 1 + 0.3 * np.cos(seed + np.arange(3)))

    return bk.BatchFunctionBackend(features, forward, gradient=lambda m: m * 2, train=lambda df: {"loss": 1.0, "rows": df.count()}, passes=3)


@pytest.mark.parametrize("family, method", [("uncertainty", "entropy"), ("uncertainty", "bald"), ("diversity", "coreset"), ("diversity", "cluster_margin"), ("localization", "gradient_norm"), ("localization", "influence")])
def test_loop_moves_rows(spark, backend, family, method):
    ids = backend.features.select("id")
    loop = ActiveLearningLoop(backend, ids, Strategy(family, method), LoopConfig(budget_per_round=7, max_rounds=2))
    history = loop.run()
    assert history[0].labeled_pool_size + history[0].unlabeled_pool_size == 60 and history[-1].metrics["train_loss"] == 1.0
    assert loop.labeled().intersect(loop.unlabeled()).count() == 0
    assert loop.pool.where(F.col("round_added") == 1).count() == history[1].n_queried
    assert [r["round"] for r in loop.summary()] == [1, 2]
    for n, r in enumerate(history):
        assert {x["id"] for x in r.queried.collect()} == {x["id"] for x in loop.pool.where(F.col("round_added") == n).collect()}


def test_loop_stops(spark, backend):
    ids = backend.features.select("id")
    flat = ActiveLearningLoop(backend, ids, Strategy("uncertainty", "margin"), LoopConfig(budget_per_round=5, patience=2), quality_metric=lambda b, v: 0.5, validation_ids=ids)
    assert len(flat.run()) == 3
    empty = ActiveLearningLoop(backend, ids, Strategy("uncertainty", "margin"), LoopConfig(budget_per_round=30))
    assert [r.unlabeled_pool_size for r in empty.run()] == [0]
    failing = ActiveLearningLoop(backend, ids, Strategy("localization", "spatial_entropy"), LoopConfig(budget_per_round=5), seed_ids=ids.limit(3))
    with pytest.raises(NotImplementedError):
        failing.run()
    with pytest.raises(TypeError):
        Strategy("none", "entropy")
    with pytest.raises(ValueError):
        Strategy("diversity", "entropy")


def test_table_backend(spark, backend):
    ids = backend.features.select("id")
    t = bk.TableBackend(backend.predict_proba(ids), backend.get_embeddings(ids))
    assert t.predict_proba(ids.limit(4)).count() == 4
    with pytest.raises(NotImplementedError):
        t.compute_gradients(ids)


class Layer:
    """A stand-in for a module: adds its number to its input and tells its hooks."""

    def __init__(self, n, parts=()):
        self.n, self.parts, self.hooks = n, list(parts), []

    def __getitem__(self, i):
        return self.parts[i]

    def register_forward_hook(self, f):
        self.hooks.append(f)
        return type("Hook", (), {"remove": lambda _: self.hooks.remove(f)})()

    def eval(self):
        return self

    def to(self, device):
        return self

    def __call__(self, x):
        out = x
        for part in self.parts:
            out = part(out)
        out = Tensor(np.asarray(out) + self.n)
        for f in list(self.hooks):
            f(self, (x,), out)
        return out


class Tensor(np.ndarray):
    def __new__(cls, x):
        return np.asarray(x).view(cls)

    def cpu(self):
        return self

    def numpy(self):
        return np.asarray(self)


def test_embeddings_of_a_named_layer(monkeypatch):
    import contextlib
    import sys
    import types

    torch = types.ModuleType("torch")
    torch.no_grad, torch.float32 = contextlib.nullcontext, None
    torch.as_tensor = lambda x, dtype=None, device=None: Tensor(x)
    monkeypatch.setitem(sys.modules, "torch", torch)
    module = Layer(100, [Layer(1), Layer(10, [Layer(2)])])
    module.body = module.parts[1]
    x = np.arange(6.0).reshape(2, 3)
    assert (bk.torch_embed(module, "body.0")(x) == x + 3).all() and (bk.torch_embed(module, "1")(x) == x + 13).all()
    assert not module.parts[1].hooks and not module.parts[1].parts[0].hooks
    assert (bk.torch_embed(module, "0")(x.reshape(2, 3, 1)) == x + 1).all()
    for missing in ("body.7", "head"):
        with pytest.raises(AttributeError):
            bk.torch_embed(module, missing)(x)


def test_one_epoch_in_batches(spark, backend):
    seen = []
    model = type("Model", (), {"train_on_batch": lambda self, x, y: seen.append((x.shape, y.tolist())) or [len(y) / 10, 0.5]})()
    labels = spark.range(50).selectExpr("id", "cast(id % 3 as int) as label")
    out = bk.keras_trainer(model, labels, batch_rows=20)(backend.features)
    assert [s for s, _ in seen] == [(20, 4), (20, 4), (10, 4)] and seen[0][1][:4] == [0, 1, 2, 0]
    assert out == {"loss": pytest.approx((2 + 2 + 1) / 3), "batches": 3}
    assert bk.keras_trainer(model, labels)(backend.features.where("false"))["batches"] == 0


def test_uneven_features_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, features array<double>").coalesce(1)
    b = bk.BatchFunctionBackend(df, lambda m, seed: m)
    with pytest.raises(Exception, match="between 1 and 2"):
        b.predict_proba(df).collect()
    assert b.get_embeddings(df.where("id <> 2")).count() == 1
