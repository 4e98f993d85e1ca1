"""Exact nearest neighbours. Input rows: (id, label, embedding).

A few blocks of rows are multiplied with each other; beyond them vectors are coded and put
into cells (see ``vector_blocks``), and a row looks only into those parts of cells that the
bound on its k-th similarity does not exclude. Both ways give the same neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.operators import vector_blocks as vx
from gaugeworks.session import cut_lineage

BLOCK_ROWS = 4096
#: Rows up to which all blocks meet; each is then sent at most ALL_PAIRS_ROWS / BLOCK_ROWS times.
ALL_PAIRS_ROWS = 16_384
METRICS = ("cosine", "euclidean")


def best(directed: DataFrame, k: int) -> DataFrame:
    """(a, b, cosine, rank): the k best b of each a, by b on ties. Ranks are cut before the shuffle too."""
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return directed.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spread(edges: DataFrame, classes: DataFrame, both: bool) -> DataFrame:
    """Replaces the representative b (and a, if ``both``) of edges by the listed members of its class."""
    crowded = classes.where(F.size("members") > 1).select("rep", "members")
    for side in ("a", "b") if both else ("b",):
        named = crowded.select(F.col("rep").alias(side), "members")
        edges = edges.join(named, side, "left").withColumn(side, F.explode(F.coalesce("members", F.array(side)))).drop("members")
    return edges.select("a", "b", "cosine")


def nearest(base: DataFrame, asked: DataFrame, k: int, dim: int, probes: int = 48, same: bool = True) -> DataFrame:
    """(a, b, rank, cosine): the k most similar rows b of ``base`` for every row a of ``asked``; both are (id, v).

    If ``same``, asked rows are rows of base and their own id is no neighbour; else the
    sides have ids of their own. Unusable vectors and null ids are left out; repeated rows
    count once. Ties are ordered by id; copies of a row's own vector come first with cosine
    1. Fewer than k rows come out only where base has no more. The k-th cosine found in the
    ``probes`` nearest cells bounds the angle within which all others are then looked at;
    where vectors are spread wide, that is most of the table for each row.
    """
    base, asked = (df.select("id", F.col("v").cast("array<float>").alias("v")) for df in (base, asked))
    pivots = vx.pivots_by_hash(base, "id", "v", dim, base.count())
    classes = cut_lineage(vx.lowest_members(vx.code(base, "id", "v", dim, pivots, 1), k + 1))
    coded = cut_lineage(vx.code(asked, "id", "v", dim, pivots, probes))
    looking = coded.groupBy("c").agg(F.min("id").alias("_own"), F.first("payload").alias("payload"), F.first("cells").alias("cells"))
    looking = looking.join(classes.select("c", "rep"), "c").drop("_own") if same else looking.withColumnRenamed("_own", "rep")

    def sure(x: vx.Block, y: vx.Block) -> dict:
        i, _, sims, bound = vx.tile_pairs(x, y, None, k, same)
        return {"a": x.ids[i], "least": sims - bound}

    def rest(x: vx.Block, y: vx.Block) -> dict:
        i, j, _, _ = vx.tile_pairs(x, y, x.least, k, same)
        return {"a": x.ids[i], "b": y.ids[j]}

    first = vx.in_tiles(vx.tiles(classes, looking), sure, "a long, least double", dim)
    # k values from each of the probed cells and their cuts
    kth = first.groupBy("a").agg(F.get(F.sort_array(F.collect_list("least"), asc=False), F.lit(k - 1)).alias("least"))
    named = looking
    looking = looking.join(kth.withColumnRenamed("a", "rep"), "rep", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(-1.0)), F.lit(-1.0)))
    looking = cut_lineage(looking.select("rep", "payload", "least", F.acos(F.least("least", F.lit(1.0))).alias("reach")))
    held, looking = vx.within_bounds(classes.select("rep", "payload", "cells"), looking, pivots, dim)
    pairs = cut_lineage(vx.in_tiles(vx.tiles(held.withColumn("least", F.lit(-1.0)), looking, ["least"]), rest, "a long, b long", dim, ["least"]).distinct())
    # the best k classes of each looking class hold its best k others
    edges = best(vx.exact_cosines(pairs, base if same else asked, dim, None if same else base), k).select("a", "b", "cosine")
    found = spread(edges, classes, both=False)
    if same:
        found = found.unionByName(classes.where(F.size("members") > 1).select(F.col("rep").alias("a"), F.explode("members").alias("b"), F.lit(1.0).alias("cosine")))
    ids = coded.select("c", "id").distinct().join(named.select("c", F.col("rep").alias("a")), "c").select("a", "id")
    found = found.join(ids, "a").select(F.col("id").alias("a"), "b", "cosine")
    return best(found.where(F.col("a") != F.col("b")) if same else found, k).select("a", "b", "rank", "cosine")


def vector_size(df: DataFrame, vector: str = "embedding") -> int:
    """The most frequent number of values, the larger on ties; 0 if there is no vector."""
    sizes = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def usable_rows(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """One row per id, of those that have a usable vector; null ids are left out."""
    others = [c for c in df.columns if c not in ("id", vector)]
    rows = df.where(F.col("id").isNotNull() & vx.usable(vector, dim))
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.first(vector).alias(vector), *[F.first(c, ignorenulls=True).alias(c) for c in others])


def exact_neighbours(df: DataFrame, k: int, metric: str = "cosine", dim: int | None = None) -> DataFrame:
    """(id, label, neighbour_id, neighbour_label, rank, similarity): the k most similar other rows of every row.

    Rows are scaled to length one, so both metrics order alike. Rows whose vector is null,
    of another size than ``dim`` (if None, the most frequent size), not finite or all zero
    are left out, as are null ids; repeated ids count once. Ties go to the lower neighbour
    id; equal similarities are compared after rounding to 12 digits, as sums differ in their
    last bits between blocks. Beyond ALL_PAIRS_ROWS vectors count as 32-bit floats. Raises
    ValueError for an unknown metric, and when there are not k other usable rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    dim = dim or vector_size(df)
    rows = usable_rows(df.select("id", F.col("label").cast("int").alias("label"), "embedding"), dim)
    n = rows.count()
    if n and k + 1 > n:
        raise ValueError(f"{k} neighbours asked for {n} rows")
    if n > ALL_PAIRS_ROWS:
        rows = cut_lineage(rows)
        vectors, labels = rows.select("id", F.col("embedding").alias("v")), rows.select("id", "label")
        found = nearest(vectors, vectors, k, dim, probes=8).join(labels.withColumnRenamed("id", "a"), "a").withColumnRenamed("a", "id")
        found = found.join(labels.select(F.col("id").alias("b"), F.col("label").alias("neighbour_label")), "b")
        return found.select("id", "label", F.col("b").alias("neighbour_id"), "neighbour_label", "rank", F.round("cosine", 12).alias("similarity"))
    blocks = max(1, -(-n // BLOCK_ROWS))
    rows = rows.select("id", "label", F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = rows.select(F.col("b").alias("bx"), every.alias("by"), F.lit(True).alias("asks"), "id", "label", "v")
    y = rows.select(every.alias("bx"), F.col("b").alias("by"), F.lit(False).alias("asks"), "id", "label", "v")

    def tile(table):
        import numpy as np
        import pyarrow as pa

        def side(asks: bool):
            part = table.filter(table.column("asks") if asks else pa.compute.invert(table.column("asks"))).sort_by("id")
            v = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
            return part, vx.normalised(v / np.abs(v).max(axis=1, initial=0.0)[:, None]) if part.num_rows else v

        (a, u), (b, w) = side(True), side(False)
        ids, other = a.column("id").to_numpy(), b.column("id").to_numpy()
        kept: list[tuple] = []
        for s in range(0, len(u), 1024) if len(w) else []:
            sims = np.round(u[s : s + 1024] @ w.T, 12)
            sims[ids[s : s + 1024, None] == other[None, :]] = -np.inf
            m = min(k, sims.shape[1])
            # all that reach the m-th best, then ties by id
            least = np.partition(sims, sims.shape[1] - m, axis=1)[:, sims.shape[1] - m]
            i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            order = np.lexsort((other[j], -sims[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < m
            i, j = i[keep], j[keep]
            kept.append((i + s, j, sims[i, j]))
        i, j, sims = (np.concatenate(c) for c in zip(*kept)) if kept else (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
        return pa.table({"id": ids[i], "label": a.column("label").take(pa.array(i)), "neighbour_id": other[j], "neighbour_label": b.column("label").take(pa.array(j)), "similarity": sims})

    schema = "id long, label int, neighbour_id long, neighbour_label int, similarity double"
    found = x.unionByName(y).groupBy("bx", "by").applyInArrow(tile, schema)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "label", "neighbour_id", "neighbour_label", "rank", "similarity")


def least_distance(rows: DataFrame, reference: DataFrame, dim: int) -> DataFrame:
    """(id, distance) of usable rows (id, v): 1 - cosine to the nearest row of ``reference``."""
    found = nearest(reference, rows, 1, dim, probes=8, same=False)
    return found.select(F.col("a").alias("id"), (1 - F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))).alias("distance"))
