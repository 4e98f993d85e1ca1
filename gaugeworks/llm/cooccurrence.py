"""Items that appear together: blocked Gram matrix of binary baskets.

Each basket becomes one row with the set of its items. A record block, some thousand rows,
is a binary matrix: its frequent items are one dense item block, all others are sparse.
Its transpose-product is summed with those of the blocks before, and the partial sums of
all partitions are added by (item, item). Nothing leaves a worker per pair and record, and
no pair of baskets is ever joined.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import cut_lineage

#: Items of the dense block of a record block at most, and the share of records (one in so many) that an item must be in.
DENSE_ITEMS, DENSE_SHARE = 2_048, 64
#: Cells (rows times columns) of a binary matrix that is multiplied at once.
PRODUCT_CELLS = 4_000_000
#: Entries of one record block, unless a single record has more.
BLOCK_ENTRIES = 500_000
#: Pairs of entries formed at once, and sums held in a worker before they are passed on.
CHUNK_PAIRS, MAX_SUMS = 2_000_000, 4_000_000


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): the set of distinct items of every basket; null baskets and items are ignored.

    ``collect_set`` combines on the map side, so a basket with a third of all rows sends
    no more than its distinct items from each task.
    """
    known = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).cast("long").alias("item"))
    return known.groupBy("basket").agg(F.collect_set("item").alias("items"))


class _Gram:
    """Sums of transpose-products of one record block after another, as sparse (a, b, n) with a <= b.

    Items that many records of a block hold make one dense item block, multiplied at once.
    All others stay sparse: their entries meet the entries of the same record only, so work
    and memory follow the pairs that occur and not the number of items.
    """

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, rows, ids, n_rows: int) -> Iterator:
        """One block: ``ids`` of the entries and the ``rows`` they are in, by row; yields sums when too many are held."""
        import numpy as np

        items, column, often = np.unique(ids, return_inverse=True, return_counts=True)
        dense = np.zeros(len(items), dtype=bool)
        dense[np.argsort(-often, kind="stable")[:DENSE_ITEMS]] = True
        dense &= (often * DENSE_SHARE >= n_rows) | (len(items) <= DENSE_ITEMS // 8)
        place = np.cumsum(dense) - 1
        in_dense = dense[column]
        r, c = rows[in_dense], place[column[in_dense]]
        self._multiply(r, c, items[dense], n_rows)
        yield from self._drain_if_full()
        if in_dense.all():
            return
        # sparse entries with the sparse ones after them in their record, and with all dense ones of it
        sr, si, di = rows[~in_dense], ids[~in_dense], items[dense][c]
        at = np.arange(len(sr))
        for start, stop, other in ((at, np.searchsorted(sr, sr, side="right"), si), (np.searchsorted(r, sr), np.searchsorted(r, sr, side="right"), di)):
            length = stop - start
            ends = np.cumsum(length)
            cuts = [0, *np.unique(np.searchsorted(ends, np.arange(CHUNK_PAIRS, ends[-1], CHUNK_PAIRS), side="right")), len(sr)]
            for lo, hi in zip(cuts, cuts[1:]):
                n = length[lo:hi]
                right = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                a, b = np.repeat(si[lo:hi], n), other[right]
                self._put(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), dtype="int64"))
                yield from self._drain_if_full()

    def _multiply(self, r, c, items, n_rows: int) -> None:
        import numpy as np

        step = max(64, PRODUCT_CELLS // max(1, len(items)))
        sums = np.zeros((len(items), len(items)), dtype="int64") if len(items) else None
        for start in range(0, n_rows if len(items) else 0, step):
            lo, hi = np.searchsorted(r, [start, start + step])
            if hi > lo:
                m = np.zeros((min(step, n_rows - start), len(items)), dtype="float32")
                m[r[lo:hi] - start, c[lo:hi]] = 1
                sums += np.rint(m.T @ m).astype("int64")
        if sums is not None:
            # items ascend, so the upper triangle has a <= b
            a, b = np.nonzero(np.triu(sums))
            self._put(items[a], items[b], sums[a, b])

    def _put(self, a, b, n) -> None:
        if len(a):
            self.parts.append(_added(a, b, n))
            self.held += len(self.parts[-1][0])

    def _drain_if_full(self) -> Iterator:
        if self.held > MAX_SUMS:
            self.parts = [_added(*map(_joined, zip(*self.parts)))]
            self.held = len(self.parts[0][0])
            if self.held > MAX_SUMS // 2:
                yield self.drain()

    def drain(self):
        import numpy as np
        import pyarrow as pa

        none = np.empty(0, dtype="int64")
        a, b, n = _added(*map(_joined, zip(*self.parts))) if self.parts else (none, none, none)
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["item_a", "item_b", "n"])


def _joined(arrays):
    import numpy as np

    return np.concatenate(arrays)


def _added(a, b, n):
    """Sums of n by (a, b), sorted."""
    import numpy as np

    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, dtype="int64")
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def pair_counts(sets: DataFrame) -> DataFrame:
    """(item_a, item_b, n) with item_a <= item_b: baskets with both; equal items give the item's own count."""

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        gram = _Gram()
        for batch in batches:
            lists = batch.column(0)
            lists = lists if isinstance(lists, pa.ListArray) else lists.combine_chunks()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("int64")
            # records in blocks of a bounded number of entries
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(lengths):
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_ENTRIES, side="right")))
                if ends[hi - 1] > before:
                    yield from gram.add(np.repeat(np.arange(hi - lo), lengths[lo:hi]), ids[before : ends[hi - 1]], hi - lo)
                lo = hi
        yield gram.drain()

    return sets.select("items").mapInArrow(partial, "item_a long, item_b long, n long").groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def cooccurrence(df: DataFrame, basket: str, item: str, keep: DataFrame | None = None) -> DataFrame:
    """Pairs of items with how often they share a basket and how far that exceeds chance.

    Returns (item_a, item_b, n_ab, n_a, n_b, n_baskets, expected, lift, pmi), item_a < item_b,
    for pairs that share at least one basket. expected = n_a * n_b / n_baskets, lift =
    n_ab / expected, pmi = log2(lift). Repeated (basket, item) rows count once; null
    baskets and items are ignored; an empty table gives no rows. ``keep`` (column
    ``basket``) restricts the baskets. Items are integers.
    """
    sets = baskets(df, basket, item)
    if keep is not None:
        sets = sets.join(keep.select("basket").distinct(), "basket", "left_semi")
    # every basket also holds a mark, whose own count is the number of baskets
    mark = -(2**63)
    # written once, as pairs, their items' own counts and the number of baskets are all read from it
    counts = cut_lineage(pair_counts(sets.select(F.array_append("items", F.lit(mark).cast("long")).alias("items"))))
    own = counts.where((F.col("item_a") == mark) & (F.col("item_b") != mark)).select(F.col("item_b").alias("_item"), F.col("n").alias("_n"))
    whole = counts.where((F.col("item_a") == mark) & (F.col("item_b") == mark)).select(F.col("n").alias("n_baskets"))
    pairs = counts.where((F.col("item_a") != mark) & (F.col("item_a") < F.col("item_b"))).withColumnRenamed("n", "n_ab")
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("_item").alias(f"item_{side}"), F.col("_n").alias(f"n_{side}")), f"item_{side}")
    pairs = pairs.crossJoin(F.broadcast(whole))  # one row
    expected = F.col("n_a") * F.col("n_b").cast("double") / F.col("n_baskets")
    lift = F.col("n_ab") / F.col("expected")
    return pairs.withColumn("expected", expected).withColumn("lift", lift).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", "expected", "lift", F.log2("lift").alias("pmi"))
