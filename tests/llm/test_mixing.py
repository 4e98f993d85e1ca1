import pytest

from gaugeworks.llm import mixing as mx

DOCS = "doc_id long, sources array<string>, tokens long, repeats string"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, share=0.5):
    return mx.Mix(spark.createDataFrame([(i, s, t, "x") for i, (s, t) in enumerate(docs)], DOCS), spark.createDataFrame(targets, TARGETS), share)


def test_shares_repeats_and_deficits(spark):
    docs = [(["a"], 100)] * 50 + [(["b"], 100)] * 10 + [(["c"], 100)] * 40 + [([], 77), (None, 100), ([None], 5), (["a"], None)]
    m = mix(spark, docs, [("a", 0.4, 2), ("b", 0.4, 3), ("c", 0.1, 1), ("d", 0.05, 9), ("e", 0.0, 1), (None, 1.0, 1)])
    t = (10_000 + 77 + 105) / 2
    r = {x["source"]: x for x in m.report().collect()}
    assert r["a"]["planned_tokens"] == pytest.approx(0.4 * t) and r["a"]["deficit_tokens"] == 0 and r["a"]["selected_share"] == pytest.approx(0.4, abs=101 / t)
    assert r["b"]["planned_tokens"] == pytest.approx(0.4 * t) and r["b"]["mean_repeats"] == pytest.approx(0.4 * t / 1000)
    assert r["d"]["deficit_tokens"] == pytest.approx(0.05 * t) and r["e"]["deficit_tokens"] == 0 and set(r) == set("abcde")
    chosen = m.select().collect()
    for s in "abc":
        total = sum(x["repeats"] * x["tokens"] for x in chosen if x["source"] == s)
        assert 0 <= r[s]["planned_tokens"] - total < 100 + 1 and r[s]["selected_tokens"] == total
    assert max(x["repeats"] for x in chosen if x["source"] == "b") <= 3
    assert m.select().collect() and {tuple(x) for x in m.select().collect()} == {tuple(x) for x in chosen}


def test_source_that_cannot_reach_its_share(spark):
    m = mix(spark, [(["a"], 10)] * 10 + [(["b"], 100)] * 10, [("a", 0.5, 2), ("b", 0.5, 1)])
    r = {x["source"]: x for x in m.report().collect()}
    assert r["a"]["planned_tokens"] == 200 and r["a"]["deficit_tokens"] == pytest.approx(75) and r["b"]["deficit_tokens"] == 0
    assert {x["repeats"] for x in m.select().collect() if x["source"] == "a"} == {2}


def test_overlapping_documents_go_where_they_are_needed(spark):
    docs = [(["a", "b", "a"], 100)] * 10 + [(["b"], 100)] * 10
    m = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], 1.0)
    assert all(x["deficit_tokens"] == 0 for x in m.report().collect())
    assert m.flow[("a", "b"), "a"] == 1000 and m.flow[("b",), "b"] == 1000


def test_flow_prefers_fewer_repeats():
    f = mx.route({("a",): 100, ("a", "b"): 100}, {"a": (0.5, 3), "b": (0.0, 1)}, 400)
    assert f == {(("a",), "a"): 100, (("a", "b"), "a"): 100, (("a", "b"), "b"): 0}


def test_empty(spark):
    m = mix(spark, [], [("a", 1.0, 1)])
    assert m.report().first()["deficit_tokens"] == 0 and m.select().count() == 0
    assert mix(spark, [(["a"], 5)], []).report().count() == 0


def used(chosen):
    per, all_of = {}, {}
    for x in chosen:
        per[x["doc_id"], x["source"]] = per.get((x["doc_id"], x["source"]), 0) + x["repeats"]
        all_of[x["doc_id"]] = all_of.get(x["doc_id"], 0) + x["repeats"]
    return per, all_of


def test_sources_share_documents_within_their_caps(spark):
    m = mix(spark, [(["a", "b"], 50 + i % 7) for i in range(1000)], [("a", 0.5, 1), ("b", 0.5, 1)], 1.0)
    chosen = m.select().collect()
    per, all_of = used(chosen)
    assert len(all_of) == 1000 and set(all_of.values()) == {1}
    for r in m.report().collect():
        assert abs(r["selected_tokens"] - r["planned_tokens"]) < 57 and r["most_repeats"] == 1


def test_laps_of_different_caps(spark):
    import random

    rng = random.Random(4)
    kinds = [["a", "b"], ["a"], ["b", "c"], ["a", "b", "c"], ["c"]]
    docs = [(kinds[min(4, int(rng.expovariate(1.2)))], rng.choice([0, 1, 30, 400])) for _ in range(3000)]
    targets = [("a", 0.5, 3), ("b", 0.9, 2), ("c", 0.6, 1)]
    m = mix(spark, docs, targets, 1.0)
    per, all_of = used(m.select().collect())
    cap = {s: r for s, _, r in targets}
    assert all(n <= cap[s] and s in docs[i][0] for (i, s), n in per.items() if docs[i][1])
    assert all(n <= max(cap[s] for s in docs[i][0]) for i, n in all_of.items() if docs[i][1])
    for r in m.report().collect():
        assert abs(r["selected_tokens"] - r["planned_tokens"]) <= 400 * len(kinds)


def test_more_patterns_than_are_routed_whole(spark, monkeypatch):
    monkeypatch.setattr(mx, "MAX_PATTERNS", 2)
    docs = [(["a", "b"], 100)] * 20 + [(["a"], 90)] * 10 + [(["b", "c"], 10)] * 10 + [(["a", "c"], 20)] * 5
    m = mix(spark, docs, [("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.1, 2)], 1.0)
    assert set(m.sizes) == {("a", "b"), ("a",), ("c",)} and m.sizes["c",] == 200 and sum(m.sizes.values()) == 3100
    per, _ = used(m.select().collect())
    assert {i for i, s in per if s == "c"} == set(range(30, 45)) and max(per.values()) <= 2


def test_flow_fills_every_way_of_one_cost():
    f = mx.route({(a, b): 10 for a in "abcd" for b in "efgh"}, {s: (1 / 8, 1) for s in "abcdefgh"}, 160)
    assert sum(f.values()) == pytest.approx(160)
    want = {s: sum(x for (_, t), x in f.items() if t == s) for s in "abcdefgh"}
    assert all(x == pytest.approx(20) for x in want.values())
