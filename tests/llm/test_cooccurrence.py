import itertools
import math
import random

import pytest

from gaugeworks.llm import cooccurrence as co


def brute(rows):
    sets: dict = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    pairs: dict = {}
    single: dict = {}
    for s in sets.values():
        for i in s:
            single[i] = single.get(i, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            pairs[p] = pairs.get(p, 0) + 1
    return {(a, b): (n, single[a], single[b], len(sets)) for (a, b), n in pairs.items()}


@pytest.mark.parametrize("dense, share, entries, chunk, sums", [(2048, 64, 500_000, 2_000_000, 4_000_000), (7, 64, 50, 30, 40), (3, 2, 1, 1, 1), (1, 1, 10_000, 5, 10**6)])
def test_matches_brute_force(spark, monkeypatch, dense, share, entries, chunk, sums):
    for name, value in (("DENSE_ITEMS", dense), ("DENSE_SHARE", share), ("BLOCK_ENTRIES", entries), ("CHUNK_PAIRS", chunk), ("MAX_SUMS", sums)):
        monkeypatch.setattr(co, name, value)
    rng = random.Random(2)
    rows = [(rng.choice([1, rng.randrange(80), None]), rng.choice([rng.randrange(-3, 40), None, 2**50])) for _ in range(2000)]
    df = spark.createDataFrame([(b, i, "x", 5) for b, i in rows], "basket long, item long, n string, items int").repartition(5)
    got = {(r["item_a"], r["item_b"]): r for r in co.cooccurrence(df, "basket", "item").collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for p, (n, a, b, t) in want.items():
        r = got[p]
        assert (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) == (n, a, b, t)
        assert r["lift"] == pytest.approx(n * t / (a * b)) and r["pmi"] == pytest.approx(math.log2(n * t / (a * b)))


def test_kept_baskets_and_empty(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 2)], "basket long, item long")
    keep = spark.createDataFrame([(2,), (2,), (9,)], "basket long")
    r = co.cooccurrence(df, "basket", "item", keep=keep).collect()
    assert [(x["n_ab"], x["n_baskets"]) for x in r] == [(1, 1)]
    assert co.cooccurrence(df.where("false"), "basket", "item").count() == 0
    assert co.cooccurrence(df.where("item = 1"), "basket", "item").count() == 0


def test_many_items_stay_sparse():
    import numpy as np

    rng = np.random.default_rng(5)
    baskets = [np.unique(np.concatenate(([-1], rng.integers(0, 1_000_000, 12), rng.integers(0, 5, 3)))) for _ in range(4000)]
    gram, found = co._Gram(), []
    for lo in range(0, 4000, 1000):
        part = baskets[lo : lo + 1000]
        found += list(gram.add(np.repeat(np.arange(1000), [len(b) for b in part]), np.concatenate(part), 1000))
    found.append(gram.drain())
    n = {}
    for batch in found:
        for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n[a, b] = n.get((a, b), 0) + c
    want = brute([(i, int(x)) for i, b in enumerate(baskets) for x in b])
    assert {p: c for p, c in n.items() if p[0] < p[1]} == {p: v[0] for p, v in want.items()} and n[-1, -1] == 4000
