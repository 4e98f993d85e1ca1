"""Keyword-stuffed and link-list pages: bagged trees from weak labels, smoothed by host.

Content and link features are computed once for every whole text, and so is a weak label
from other signals (see ``page_labels``). A bounded sample of the weakly labelled pages
trains bagged decision trees. Every page's odds are then multiplied by those of its host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.page_features import NAMES, ODD, contributed, line_features
from gaugeworks.llm.page_labels import CLEAN, SPAM, weak_label
from gaugeworks.session import cut_lineage

#: Weakly labelled pages of each class that train the trees.
TRAINING_PAGES = {SPAM: 4_000, CLEAN: 12_000}
TREES, DEPTH, LEAF, BINS = 25, 6, 4, 24
CLASS_RATIO = 4
#: Power of a host's odds against those of all pages: 0 leaves pages as they are, 1 takes hosts as independent evidence.
HOST_POWER = 0.5
#: Odds of a page are between this and its inverse before its host is looked at.
LEAST_ODDS = 0.01
#: Pages with the overall rate that a host is given at least and at most; in between the hosts' own spread decides.
HOST_PRIOR = (2.0, 1e6)
#: Hosts whose rates are sent to all tasks; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def page_features(docs: DataFrame, ident: str, text: str, host: str) -> DataFrame:
    """(doc_id, host, x, label): features and weak label of every row; a null or empty text has zeros and no label."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, labels = [], []
            for t in batch.column(2).to_pylist():
                message, added, files = contributed(t or "")
                found.append(line_features(message, added, len(ODD.findall(t)) if t and not t.isascii() else 0))
                labels.append(weak_label(message, added, files))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["doc_id", "host", "x", "label"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, host string, x array<double>, label int")


class Forest:
    """Bagged decision trees; each is a list of (feature, threshold, left, right, share)."""

    def __init__(self, trees: list):
        self.trees = trees

    def predict(self, x):
        """Mean over the trees of the share of spam in the leaf."""
        import numpy as np

        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), dtype="int64")
            for _ in range(DEPTH):
                inner = left[at] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def train(x, y, seed: int = 7) -> Forest:
    """Bagged trees of Gini splits between quantile bins; constant labels give constant trees.

    Each tree draws from both classes apart, so that a rare class is drawn at least once for
    every CLASS_RATIO rows of the other.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    trees = []
    classes = [np.flatnonzero(y == c) for c in np.unique(y)]
    most = max((len(c) for c in classes), default=0)
    for _ in range(TREES):
        rows = np.concatenate([rng.choice(c, max(len(c), most // CLASS_RATIO)) for c in classes])
        nodes: list[list] = []

        def grow(rows, depth: int, nodes=nodes) -> int:
            here = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * LEAF:
                return here
            best = (len(rows) * share * (1 - share) - 1e-9, -1, -1)
            for f in range(x.shape[1]):
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                s = np.cumsum(np.bincount(b, weights=y[rows], minlength=BINS))[:-1]
                m, t = len(rows) - n, y[rows].sum() - s
                with np.errstate(invalid="ignore", divide="ignore"):
                    loss = np.where((n >= LEAF) & (m >= LEAF), s * (1 - s / n) + t * (1 - t / m), np.inf)
                at = int(loss.argmin())
                if loss[at] < best[0]:
                    best = (loss[at], f, at)
            if best[1] < 0:
                return here
            f, at = best[1:]
            low = binned[rows, f] <= at
            # halfway between the sides, so that values no training page has go to the nearer one
            nodes[here][:2] = [f, float(x[rows[low], f].max() + x[rows[~low], f].min()) / 2]
            nodes[here][2] = grow(rows[low], depth - 1)
            nodes[here][3] = grow(rows[~low], depth - 1)
            return here

        grow(rows, DEPTH)
        trees.append(tuple(np.array(c) for c in zip(*nodes)))
    return Forest(trees)


def sample_labelled(pages: DataFrame) -> tuple[list, list]:
    """(features, labels) of at most TRAINING_PAGES pages of each class, those of lowest hash.

    A bound on the hash lets through little more than the wanted rows before any are
    ordered, so what reaches the driver does not grow with the table.
    """
    held = {r["label"]: r["n"] for r in pages.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64("doc_id", "host", "x")
    x, y = [], []
    for label, n in sorted(held.items()):
        wanted = TRAINING_PAGES[label]
        share = min(1.0, (1.1 * wanted + 300) / n)
        rows = pages.where(F.col("label") == label)
        near = rows.where(h < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else rows
        x += [r["x"] for r in near.select("x", h.alias("_h"), "doc_id").orderBy("_h", "doc_id").limit(wanted).collect()]
        y += [float(label)] * (len(x) - len(y))
    return x, y


def host_rates(scored: DataFrame) -> DataFrame:
    """(_host, host_rate, overall) from (host, probability): spam rates drawn towards the overall rate.

    How far is told by the hosts themselves, by the moments of a beta-binomial: hosts that
    differ no more than chance lets them all get the overall rate, hosts that differ much
    keep their own. One row a host; the overall figures are one row.
    """
    per = scored.groupBy("host").agg(F.sum("probability").alias("_s"), F.count(F.lit(1)).alias("_n"))
    n, s = F.col("_n").cast("double"), F.col("_s")
    whole = per.agg(F.sum(n).alias("N"), F.sum(s).alias("S"), F.count(F.lit(1)).alias("H"), F.sum(n * n).alias("Q"), F.sum(s * s / n).alias("R"))
    rate = F.try_divide("S", "N")
    between = F.try_divide(F.col("R") - F.col("N") * rate * rate, F.col("H") - 1)
    within = F.try_divide(F.col("S") - F.col("R"), F.col("N") - F.col("H"))
    spread = F.try_divide(between - within, F.try_divide(F.col("N") - F.col("Q") / F.col("N"), F.col("H") - 1))
    prior = F.least(F.greatest(F.coalesce(F.try_divide(rate * (1 - rate), spread) - 1, F.lit(HOST_PRIOR[1])), F.lit(HOST_PRIOR[0])), F.lit(HOST_PRIOR[1]))
    whole = whole.select(rate.alias("overall"), F.when(F.coalesce(spread, F.lit(0.0)) > 0, prior).otherwise(HOST_PRIOR[1]).alias("_prior"))
    rates = per.crossJoin(F.broadcast(whole))  # one row
    return rates.select(F.col("host").alias("_host"), ((s + F.col("_prior") * F.col("overall")) / (n + F.col("_prior"))).alias("host_rate"), "overall")


def smooth(scored: DataFrame) -> DataFrame:
    """Adds ``host_rate`` and ``score`` to (doc_id, host, probability).

    The odds of the score are the page's odds times the power HOST_POWER of its host's odds
    over those of all pages. A probability of 0 stays 0, as of a page without text.
    """
    rates = cut_lineage(host_rates(scored))
    if rates.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = scored.join(F.broadcast(rates), F.col("host").eqNullSafe(F.col("_host")))
    else:
        # hosts with a hundredth of all pages are a hundred at most: they are sent, the others are joined by a shuffle
        big = scored.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        big = big.crossJoin(F.broadcast(big.agg(F.sum("_n").alias("_all")))).where(F.col("_n") * 100 >= F.col("_all")).select(F.col("host").alias("_big"))  # one row
        same = F.col("host").eqNullSafe(F.col("_big"))
        few = rates.join(F.broadcast(big), F.col("_host").eqNullSafe(F.col("_big")), "left_semi")
        hot = scored.join(F.broadcast(few), F.col("host").eqNullSafe(F.col("_host")))
        cold = scored.join(F.broadcast(big), same, "left_anti").join(rates, F.col("host").eqNullSafe(F.col("_host")))
        joined = hot.unionByName(cold)

    def odds(p):
        return F.least(F.greatest(F.coalesce(F.try_divide(p, 1 - p), F.lit(1 / LEAST_ODDS)), F.lit(LEAST_ODDS)), F.lit(1 / LEAST_ODDS))

    both = odds(F.col("probability")) * F.pow(odds(F.col("host_rate")) / odds(F.col("overall")), F.lit(HOST_POWER))
    score = F.when(F.col("probability") > 0, both / (1 + both)).otherwise(0.0)
    return joined.select("doc_id", "host", "probability", "host_rate", score.alias("score"))


def spam_pages(docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "repo") -> DataFrame:
    """(doc_id, host, probability, host_rate, score) of every row; spam has a score of 0.5 or more.

    A null or empty text has no features and is never spam. Pages with a null host are one
    host. Repeated ids are scored row by row. Without weak labels of both classes the weak
    label itself is the probability, 0 where there is none. An empty table gives no rows.
    """
    import numpy as np

    pages = cut_lineage(page_features(docs, ident, text, host))
    x, y = sample_labelled(pages)
    forest = train(np.array(x), np.array(y)) if len(set(y)) == 2 else None
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.empty((0, len(NAMES)))
            p = held.value.predict(x) if held.value else (pdf["label"] == SPAM).to_numpy().astype("float64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "host": pdf["host"], "probability": np.where(x[:, 0] > 0, p, 0.0)})

    return smooth(pages.mapInPandas(predict, "doc_id long, host string, probability double"))
