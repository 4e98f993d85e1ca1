import datetime as dt
import random

from gaugeworks.operators import references as rf

T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=d) for d in range(100)]
REFS = "ref_id long, ref_field string, key long, at timestamp"
PARENTS = "ref_field string, key long, added_at timestamp, deleted_at timestamp"


def brute(refs, parents):
    out = set()
    for i, f, k, at in refs:
        if k is None:
            continue
        lives = [(a, d) for g, q, a, d in parents if g == f and q == k]
        begun = [(a, d) for a, d in lives if a is not None and at is not None and a <= at]
        if not any(d is None or d > at for _, d in begun):
            out.add((i, f, "missing" if not lives else "deleted" if begun else "late"))
    return out


def found(spark, refs, parents):
    rows = rf.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
    assert len(rows) == len({(r["ref_id"], r["ref_field"]) for r in rows})
    return {(r["ref_id"], r["ref_field"], r["ref_state"]) for r in rows}


def test_matches_brute_force_with_hot_key_gaps_and_second_lives(spark):
    rng = random.Random(1)
    parents = []
    for f in ("a", "b"):
        for k in list(range(-5, 60)) + [70, 90, 1 << 20, -(1 << 30)]:
            if rng.random() < 0.15:
                continue
            start = rng.randrange(60)
            parents.append((f, k, T[start], T[start + 20] if rng.random() < 0.4 else None))
            if rng.random() < 0.2:
                parents.append((f, k, T[min(99, start + 30)], None))
                parents.append(parents[-1])
    parents.append(("a", 91, None, None))
    parents += [("b", 33, T[d], T[d + 5]) for d in range(0, 90, 9)]
    keys = [7] * 400 + list(range(-8, 100)) * 3 + [None] * 5 + [1 << 20, 1 << 40]
    refs = [(n, f, rng.choice(keys), rng.choice([*T, None])) for n in range(900) for f in ("a", "b")]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_life_ends_before_the_moment_of_deletion(spark):
    parents = [("a", 1, T[1], T[5])]
    refs = [(i, "a", 1, T[d]) for i, d in enumerate((0, 1, 4, 5, 6))]
    assert found(spark, refs, parents) == {(0, "a", "late"), (3, "a", "deleted"), (4, "a", "deleted")}


def test_empty_sides(spark):
    assert found(spark, [], [("a", 1, T[0], None)]) == set()
    assert found(spark, [(1, "a", 5, T[0])], []) == {(1, "a", "missing")}


def test_runs_are_contiguous_within_blocks(spark):
    keys = [1, 2, 3, 5, 6, 9, 9, None, (1 << rf.BLOCK_BITS) - 1, 1 << rf.BLOCK_BITS, -1, 0]
    runs = rf.key_runs(spark.createDataFrame([(k,) for k in keys], "key long")).collect()
    edge = 1 << rf.BLOCK_BITS
    assert {(r["run_start"], r["run_end"]) for r in runs} == {(-1, -1), (0, 3), (5, 6), (9, 9), (edge - 1, edge - 1), (edge, edge)}


def test_annotation_references_read_redelivered_rows_once(spark):
    a = spark.createDataFrame([(1, 5, 8, T[3]), (1, 5, 8, T[3]), (2, None, 9, T[3]), (None, 5, 8, T[3])], "id long, image_id long, category_id long, created_at timestamp")
    p = spark.createDataFrame([(5, T[0], None)], "id long, added_at timestamp, deleted_at timestamp")
    refs, parents = rf.annotation_references(a, p, p.where("false"))
    rows = rf.orphan_references(refs, parents).collect()
    assert {(r["ref_id"], r["ref_field"], r["ref_state"]) for r in rows} == {(1, "category_id", "missing"), (2, "category_id", "missing")}
    months = rf.orphans_by_period(rf.orphan_references(refs, parents)).collect()
    assert [(r["n_refs"], r["n_keys"]) for r in months] == [(2, 2)]
