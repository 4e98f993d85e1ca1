"""Diverse subsets: k-center, max-min and cluster margin. Input rows: (id, embedding).

Farthest-first picks depend on each other, but one pass over the rows serves many picks:
the farthest rows are offered, and a pick stands as long as no row that was not offered can
be farther. Distances only shrink, so this is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gaugeworks.functions.expr import normalised, top_two_gap
from gaugeworks.operators.neighbors import least_distance, usable_rows, vector_size
from gaugeworks.session import cut_lineage

METHODS = ("coreset", "cluster_margin", "minmax")
#: Rows that are offered in a pass.
OFFERS = 64
#: Lists of offers merged by one task.
FAN_IN = 16
#: Picks after which the rows are written anew with their distances.
WRITE_AFTER = 256
BLOCK_ROWS = 4096
#: Rows times references up to which all blocks meet; beyond, bounds leave most of them out.
ALL_PAIRS = 16_384**2


def _unit(matrix):
    import numpy as np

    return matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1e-12)[:, None]


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    """(id, v) of the usable vectors, one row per id."""
    return usable_rows(rows.select("id", "embedding"), dim).select("id", F.col("embedding").cast("array<double>").alias("v"))


def min_distance(rows: DataFrame, reference: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, distance): smallest cosine distance, 1 - cosine within [-1, 1], of each row to any reference row.

    Vectors that are null, of another size than ``dim`` (if None, the most frequent size of
    ``rows``), not finite or all zero are left out on both sides, as are null ids; repeated
    ids count once. No rows come out without references.
    """
    dim = dim or vector_size(rows)
    rows, reference = _usable(rows, dim), _usable(reference, dim)
    n, m = rows.count(), reference.count()
    if n * m > ALL_PAIRS:
        return least_distance(cut_lineage(rows), cut_lineage(reference), dim)
    bx, by = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_ROWS))
    h = F.xxhash64("id")
    x = rows.select(F.pmod(h, F.lit(bx)).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.lit(by - 1))).alias("by"), F.lit(True).alias("asks"), "id", "v")
    y = reference.select(F.explode(F.sequence(F.lit(0), F.lit(bx - 1))).alias("bx"), F.pmod(h, F.lit(by)).cast("int").alias("by"), F.lit(False).alias("asks"), "id", "v")

    def tile(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        a, b = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        u, w = (_unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)) for t in (a, b))
        best = np.concatenate([1 - np.clip(u[s : s + 1024] @ w.T, -1, 1).max(axis=1) for s in range(0, len(u), 1024)])
        return pa.table({"id": a.column("id").to_numpy(), "distance": best})

    return x.unionByName(y).groupBy("bx", "by").applyInArrow(tile, "id long, distance double").groupBy("id").agg(F.min("distance").alias("distance"))


_OFFER = "part int, id long, v array<double>, distance double, more double"


def _top(ids, v, d, more, part: int):
    """The OFFERS farthest rows as an Arrow table; ``more`` becomes the largest distance that is not offered."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((ids, -d))
    if len(order) > OFFERS:
        more = max(more, float(d[order[OFFERS]]))
    order = order[:OFFERS]
    flat = pa.array(np.ascontiguousarray(v[order]).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype="int32") * v.shape[1], pa.int32()), flat)
    n = len(order)
    return pa.table([pa.array([part] * n, pa.int32()), pa.array(ids[order], pa.int64()), lists, pa.array(d[order]), pa.array([more] * n, pa.float64())], names=["part", "id", "v", "distance", "more"])


def _offers(base: DataFrame, dim: int, matrix, done: list[int]) -> DataFrame:
    """The OFFERS farthest rows of ``base`` (id, v, distance) once ``matrix`` has been picked too, merged a few lists at a time."""
    parts = base.rdd.getNumPartitions()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        held, more = None, -np.inf
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            d = batch.column(2).to_numpy()
            if len(matrix):
                d = np.minimum(d, 1 - np.clip(_unit(v) @ matrix.T, -1, 1).max(axis=1))
            free = ~np.isin(ids, done)
            ids, v, d = ids[free], v[free], d[free]
            if held is not None:
                ids, v, d = np.concatenate((held[0], ids)), np.concatenate((held[1], v)), np.concatenate((held[2], d))
            order = np.lexsort((ids, -d))
            if len(order) > OFFERS:
                more = max(more, float(d[order[OFFERS]]))
            order = order[:OFFERS]
            held = ids[order], v[order], d[order]
        if held is not None and len(held[0]):
            yield from _top(*held, more, TaskContext.get().partitionId()).to_batches()

    def merge(table):
        ids, d = table.column("id").to_numpy(), table.column("distance").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)
        return _top(ids, v, d, float(table.column("more").to_numpy().max()), int(table.column("part")[0].as_py()) // FAN_IN)

    found = base.select("id", "v", "distance").mapInArrow(run, _OFFER)
    while parts > 1:
        found = found.groupBy(F.floor(F.col("part") / FAN_IN).alias("_to")).applyInArrow(merge, _OFFER)
        parts = -(-parts // FAN_IN)
    return found


def farthest_first(rows: DataFrame, budget: int, start: int | None = None, labeled: DataFrame | None = None, dim: int | None = None) -> list[tuple[int, float]]:
    """Picks [(id, distance at the time)], the farthest from all before, lower id on ties, no id twice.

    Begins with ``start`` (distance inf), or with the row farthest from ``labeled``.
    Unusable vectors are left out as in ``min_distance``. A pass sends the driver OFFERS
    rows in all; after WRITE_AFTER picks the rows are written with their distances, so later
    passes look at later picks only.
    """
    import numpy as np

    dim = dim or vector_size(rows)
    base = _usable(rows, dim)
    if labeled is not None:
        base = base.join(min_distance(rows, labeled, dim), "id")
    else:
        base = base.withColumn("distance", F.lit(float("inf")))
    base = cut_lineage(base.select("id", "v", "distance"))
    picked: list[tuple[int, float]] = []
    recent: list = []
    if start is not None and budget > 0:
        first = base.where(F.col("id") == start).select("v").first()
        picked.append((start, float("inf")))
        recent.append(_unit(np.array([first["v"]]))[0])
    while len(picked) < budget:
        if len(recent) > WRITE_AFTER:
            base, recent = _nearer(base, dim, np.array(recent)), []
        found = _offers(base, dim, np.array(recent), [i for i, _ in picked]).toPandas()
        if not len(found):
            break
        ids, unit, d = found["id"].to_numpy(), _unit(np.stack(found["v"].to_numpy())), found["distance"].to_numpy().copy()
        rest = found["more"].max()
        fresh = True
        while len(picked) < budget and len(ids):
            at = int(np.lexsort((ids, -d))[0])
            if not fresh and d[at] <= rest:
                break
            fresh = False
            picked.append((int(ids[at]), float(d[at])))
            recent.append(unit[at])
            d = np.minimum(d, 1 - np.clip(unit @ unit[at], -1, 1))
            keep = np.arange(len(ids)) != at
            ids, unit, d = ids[keep], unit[keep], d[keep]
    return picked


def _nearer(base: DataFrame, dim: int, matrix) -> DataFrame:
    """``base`` written anew with its distances after ``matrix`` was picked."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                d = np.minimum(batch.column(2).to_numpy(), 1 - np.clip(_unit(v) @ matrix.T, -1, 1).max(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["id", "v", "distance"])

    return cut_lineage(base.mapInArrow(run, "id long, v array<double>, distance double"))


def _frame(rows: DataFrame, picked: list[tuple[int, float]]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(i, n) for n, (i, _) in enumerate(picked, 1)], "id long, pick int")


def coreset(rows: DataFrame, budget: int, labeled: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """(id, pick): greedy k-center over the usable rows; without labelled rows it begins with the lowest id."""
    dim = dim or vector_size(rows)
    known = usable_rows(rows.select("id", "embedding"), dim).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest")).first()
    budget = min(max(0, budget), known["n"])
    none = labeled is None or usable_rows(labeled.select("id", "embedding"), dim).limit(1).count() == 0
    start = known["lowest"] if none and budget else None
    return _frame(rows, farthest_first(rows, budget, start, None if none else labeled, dim) if budget else [])


def minmax(rows: DataFrame, budget: int, seed: int = 42, dim: int | None = None) -> DataFrame:
    """(id, pick): farthest-first over the usable rows from a seeded one; a budget of 0 still gives one row, as long as there is any."""
    dim = dim or vector_size(rows)
    known = usable_rows(rows.select("id", "embedding"), dim)
    budget = min(max(1, budget), known.count())
    first = known.select("id", F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))).alias("_h")).orderBy("_h", "id").first()
    return _frame(rows, farthest_first(rows, budget, first["id"], None, dim)) if first else _frame(rows, [])


def cluster_margin(rows: DataFrame, probs: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """(id, pick): the most uncertain row by margin of each of ``budget`` k-means clusters, lower id on ties.

    Empty clusters give no row, so fewer than ``budget`` may come out. Unusable vectors are
    left out, repeated ids count once.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = usable_rows(rows.select("id", "embedding"), vector_size(rows))
    k = min(max(0, budget), rows.count())
    if k == 0:
        return _frame(rows, [])
    points = rows.select("id", array_to_vector(normalised(F.col("embedding"))).alias("features")).persist()
    clusters = KMeans(k=k, seed=seed, maxIter=20).fit(points).transform(points) if k > 1 else points.withColumn("prediction", F.lit(0))
    margin = probs.select("id", (1.0 - top_two_gap(F.col("probs"))).alias("_u"))
    best = F.max_by("id", F.struct("_u", -F.col("id")))
    picked = clusters.join(margin, "id").groupBy("prediction").agg(best.alias("id"))
    return picked.select(F.col("id").cast(LongType()).alias("id"), (F.col("prediction") + 1).alias("pick"))


def query(rows: DataFrame, budget: int, method: str = "coreset", *, labeled: DataFrame | None = None, probs: DataFrame | None = None, seed: int = 42) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if method == "coreset":
        return coreset(rows, budget, labeled)
    if method == "minmax":
        return minmax(rows, budget, seed)
    if probs is None:
        raise ValueError("cluster_margin needs probabilities")
    return cluster_margin(rows, probs, budget, seed)
