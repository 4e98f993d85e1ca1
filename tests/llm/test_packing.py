import os
import random

import pytest

from gaugeworks.llm import packing as pk
from gaugeworks.llm.tokens import byte_tokens, vocabulary_tokens

KINDS = "container_kind string, capacity_tokens long"


def plain_ffd(sizes, capacity):
    room, placed = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= sizes[i]
        placed[i] = at
    return placed


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 300])
def test_tournament_tree_is_first_fit_decreasing(n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 5, rng.randrange(101), 100]) for _ in range(n)]
    assert pk.first_fit_decreasing(sizes, 100) == plain_ffd(sizes, 100)


def test_every_piece_is_placed_once_within_capacity(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([0, None, 3, rng.randrange(50), 99, 100, 101, 1234])) for i in range(3000)] + [(None, 7), (None, 205), (2**62 + 1, 40), (5, 60), (5, 60)]
    items = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, tokens long, group_id string, piece int")
    kinds = spark.createDataFrame([("small", 100), ("large", 1000), ("none", 0), (None, 5), ("null", None)], KINDS)
    out = pk.pack(items, kinds, group_documents=256).collect()
    for kind, capacity in (("small", 100), ("large", 1000)):
        mine = [r for r in out if r["container_kind"] == kind]
        assert sum(r["tokens"] for r in mine) == sum(t or 0 for _, t in docs)
        assert sum(r["piece"] == 0 for r in mine) == len(docs)
        used: dict = {}
        for r in mine:
            key = r["group_id"], r["container_no"]
            used[key] = used.get(key, 0) + r["tokens"]
            assert r["pieces"] == 1 or r["tokens"] == capacity or r["piece"] == r["pieces"] - 1
        assert max(used.values()) <= capacity
        assert {r["doc_id"] for r in mine if r["pieces"] > 1} == {d for d, t in docs if (t or 0) > capacity}
        assert sum(r["doc_id"] == 2**62 + 1 for r in mine) == 1
    assert {r["container_kind"] for r in out} == {"small", "large"}
    use = {r["container_kind"]: r for r in pk.usage(pk.pack(items, kinds), kinds).collect()}
    assert use["small"]["documents"] == len(docs) and use["small"]["used_share"] > 0.9


def test_empty(spark):
    kinds = spark.createDataFrame([("a", 10)], KINDS)
    items = spark.createDataFrame([], "doc_id long, tokens long")
    assert pk.pack(items, kinds).count() == 0
    assert pk.pack(spark.createDataFrame([(1, 5)], items.schema), kinds.where("false")).count() == 0


def test_token_counts(spark):
    texts = [("ab",), ("é\U0001f600",), ("",), (None,), ("word " * 2000,)]
    df = spark.createDataFrame(texts, "text string")
    assert [r[0] for r in df.select(byte_tokens()).collect()] == [2, 6, 0, 0, 10_000]
    path = os.environ.get("TOKENIZER_JSON", "/opt/tokenizers/byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    counts = [r[0] for r in df.select(vocabulary_tokens(path)).collect()]
    assert counts[2:4] == [0, 0] and counts[0] >= 1 and counts[4] >= 2000
