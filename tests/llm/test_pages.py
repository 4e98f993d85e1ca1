import random

import pytest

from gaugeworks.llm import page_features as pf
from gaugeworks.llm import pages as pg
from gaugeworks.llm.page_labels import CLEAN as CLEAN_LABEL
from gaugeworks.llm.page_labels import SPAM as SPAM_LABEL
from gaugeworks.llm.page_labels import weak_label

HEAD = "commit 1234567890abcdef\nAuthor: A <a@b.example>\nDate:   2025-01-01\n\n    {subject}\n\ndiff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}\n@@ -1,3 +1,3 @@\n"


def change(lines, f="README.md", subject="Update file", sign="+"):
    return HEAD.format(f=f, subject=subject) + "\n".join(sign + line for line in lines)


SPAM = {
    "links": change([f"https://shop{i % 3}.example/blue-kettle-{i}" for i in range(30)]),
    "markdown": change([f"- [buy lamp](https://x{i}.example/abc)" for i in range(20)], "docs/x.html"),
    "comments": change([f"// https://x{i}.example/lamp-{i}" for i in range(20)], "src/a.c"),
    "keywords": change(["cheap lamp lamp buy lamp - Lamp Price - buy lamps - LAMP LAMP PRICE - cheap lamp"] * 6),
    "hidden": change(["l​amp buy lamp​ cheap lamp lamp buy cheap lamp buy lamp lamp"] * 6),
    "tags": change(["#lamp_buy #LampPrice #cheaplamp #lamp #buylamp #lamplamp"] * 5),
    "products": change([f"Item {i} red lamp | S M L XL | {i}.50 | lamp sale" for i in range(20)]),
    "places": change([f"Buy lamp in Town{i}. Best lamp Town{i}. Town{i} lamp shop near Town{i}." for i in range(12)]),
    "german": change(["Lampe kaufen - günstig Lampe - Lampe Lampe Preis - Angebot Lampe - Lampe bestellen"] * 5),
    "message": "\n".join(["update", *[f"https://a.example/offer-{i}" for i in range(12)]]),
    "meta": change(['<meta name="keywords" content="lamp,buy lamp,lamp price,cheap lamp,lamp lamp">'] * 4),
}
SENTENCES = ["The parser kept a stale handle after the cache was cleared, so the second request failed.", "We read the header first because two callers relied on the order.", "Measured on a laptop: 300 ms before, 12 ms after."]
CLEAN = {
    "prose": change(SENTENCES * 4, "docs/a.md"),
    "code": change(["for (int i = 0; i < n; i++) {", "    total += values[i];", "}", "return total;"] * 8, "src/a.c"),
    "removed": change([f"https://x{i}.example/lamp-{i}" for i in range(20)], sign="-"),
    "context": change([f"https://x{i}.example/lamp-{i}" for i in range(20)], sign=" ") + "\n+return 1;",
    "lock": change([f'  resolved "https://reg.example/p{i}.tgz#0123456789abcdef{i}"' for i in range(20)], "pkg.lock"),
    "table": change([f"{i},kettle,lamp,{i * 7},0.5" for i in range(60)], "data/a.csv"),
    "fixture": change([f'  {{"id": {i}, "title": "lamp kettle", "price": 8}},' for i in range(30)], "tests/fixtures/a.json"),
    "translation": change([x for i in range(12) for x in (f'msgid "stale cache {i}"', f'msgstr "alter Speicher {i}"')], "po/de.po"),
    "words": change([f"{a} {b}" for a in ("buy", "cheap", "best") for b in ("lamp", "kettle", "rake", "sled")], "filter/blocked_words.txt"),
    "changelog": change([f"* add cache {i} ([abc1234](https://g.example/p/commit/abc1234def{i}))" for i in range(12)], "CHANGELOG.md"),
    "reading": change([f"- [notes {i}](https://n{i}.example/a): The tensor used to retry every entry before the schema was ready." for i in range(8)], "docs/reading.md"),
    "empty": "",
    "null": None,
    "long": change(SENTENCES * 20_000),
}


def stuffing(text):
    x = dict(zip(pf.NAMES, pf.features(text)))
    return sum(x[f"{k}_share"] for k in pf.STUFFING)


def label(text):
    return weak_label(*pf.contributed(text or ""))


@pytest.mark.parametrize("name", SPAM)
def test_stuffing_prevails(name):
    assert stuffing(SPAM[name]) >= 0.62


@pytest.mark.parametrize("name", CLEAN)
def test_stuffing_does_not_prevail(name):
    assert len(pf.features(CLEAN[name])) == len(pf.NAMES) and stuffing(CLEAN[name]) <= 0.35


def test_weak_labels_are_mostly_right():
    assert sum(label(t) == CLEAN_LABEL for t in SPAM.values()) <= 1 and sum(label(t) == SPAM_LABEL for t in CLEAN.values()) <= 1
    assert sum(label(t) == SPAM_LABEL for t in SPAM.values()) >= len(SPAM) // 2
    assert sum(label(t) == CLEAN_LABEL for t in CLEAN.values()) >= len(CLEAN) // 2
    assert label("") is None and label(None) is None


def test_line_ends_and_sides_do_not_matter():
    for text in SPAM.values():
        assert pf.features(text.replace("\n", "\r\n")) == pytest.approx(pf.features(text), abs=0.05)


def test_pages_are_found(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        spam = rng.random() < 0.1
        name = rng.choice([n for n in (SPAM if spam else CLEAN) if n != "long"])
        rows.append((i, (SPAM if spam else CLEAN)[name], rng.choice(["a"] * 5 + ["b", "c", None]), spam, 0.5))
    df = spark.createDataFrame([(i, t, h, 1.0, "x") for i, t, h, _, _ in rows], "doc_id long, text string, repo string, score double, host string").repartition(3)
    out = {r["doc_id"]: r for r in pg.spam_pages(df).collect()}
    assert set(out) == {r[0] for r in rows}
    assert {i for i, r in out.items() if r["score"] >= 0.5} == {r[0] for r in rows if r[3]}
    empty = [i for i, t, _, _, _ in rows if not t]
    assert all(out[i]["probability"] == 0 for i in empty)


def test_one_class_and_no_rows(spark):
    schema = "doc_id long, text string, repo string"
    df = spark.createDataFrame([(1, SPAM["links"], None), (1, SPAM["links"], None)], schema)
    assert [r["score"] >= 0.5 for r in pg.spam_pages(df).collect()] == [True, True]
    assert pg.spam_pages(df.where("false")).count() == 0


def test_trees_separate_what_one_split_cannot():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    held = rng.uniform(size=(1000, 3))
    want = (held[:, 0] > 0.5) ^ (held[:, 1] > 0.5)
    assert ((pg.train(x, y).predict(held) >= 0.5) == want).mean() > 0.9


def test_trees_decide_not_the_weak_labels(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, (SPAM if i % 8 == 0 else CLEAN)[rng.choice(sorted(SPAM) if i % 8 == 0 else [n for n in CLEAN if n != "long"])], "a") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string").repartition(2)
    with_trees = {r["doc_id"] for r in pg.spam_pages(df).collect() if r["score"] >= 0.5}
    monkeypatch.setattr(pg, "train", lambda x, y: None)
    labels_only = {r["doc_id"] for r in pg.spam_pages(df).collect() if r["score"] >= 0.5}
    assert with_trees == {i for i, _, _ in rows if i % 8 == 0} and labels_only < with_trees


def test_hosts_move_doubtful_pages_only(spark):
    hosts = [("farm", 0.95 if i < 180 else 0.3) for i in range(200)] + [("plain", 0.02 if i < 195 else 0.6) for i in range(200)] + [("plain", 0.0)]
    df = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(hosts)], "doc_id long, host string, probability double")
    out = {r["doc_id"]: r for r in pg.smooth(df).collect()}
    assert all(out[i]["score"] >= 0.5 for i in range(200))
    assert all(out[i]["score"] < 0.5 for i in range(200, 401)) and out[400]["score"] == 0
    assert out[0]["host_rate"] > 0.8 and out[300]["host_rate"] < 0.1


def test_hosts_that_differ_by_chance_have_one_rate(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, f"h{i % 40}", float(rng.random() < 0.1)) for i in range(4000)], "doc_id long, host string, probability double")
    rates = [r["host_rate"] for r in pg.host_rates(df).collect()]
    assert len(rates) == 40 and max(rates) - min(rates) < 0.05


def test_many_hosts_are_joined_with_the_large_ones_apart(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else f"h{i % 7}" if i % 3 == 1 else f"s{i}", (i % 10) / 10) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, host string, probability double")
    want = sorted(map(tuple, pg.smooth(df).collect()))
    monkeypatch.setattr(pg, "BROADCAST_HOSTS", 3)
    assert sorted(map(tuple, pg.smooth(df).collect())) == want and len(want) == 600


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(pg, "TRAINING_PAGES", {1: 50, 0: 70})
    df = spark.range(20_000).selectExpr("id as doc_id", "'a' as host", "array(cast(id as double)) as x", "cast(id % 2 as int) as label")
    x, y = pg.sample_labelled(df)
    assert (y.count(1.0), y.count(0.0)) == (50, 70) and all(v[0] % 2 == c for v, c in zip(x, y))
