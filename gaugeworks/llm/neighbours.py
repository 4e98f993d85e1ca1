"""Most similar vectors for every vector: block matrix join.

See ``operators.vector_blocks`` for coding, cells and tiles. Every row is indexed.
``nearest`` loses nothing: a class looks wherever the bound on its k-th cosine leaves room.
In ``mutual_neighbours`` a class is compared with all classes of the cells it looks into,
so what is lost is lost by a neighbour lying in a cell too far away. README states the
recall measured against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import vector_blocks as vx
from gaugeworks.operators.neighbors import best, spread
from gaugeworks.operators.neighbors import nearest as search
from gaugeworks.session import cut_lineage

PAIR = "a long, b long"


def _near(k: int, floor: float, dim: int, tiled: DataFrame) -> DataFrame:
    """(a, b): per tile, the candidates b for the k best of a."""

    def work(x: vx.Block, y: vx.Block) -> dict:
        i, j, _, _ = vx.tile_pairs(x, y, floor, k)
        return {"a": x.ids[i], "b": y.ids[j]}

    return vx.in_tiles(tiled, work, PAIR, dim)


def mutual_neighbours(df: DataFrame, ident: str, vector: str, k: int, min_similarity: float, dim: int = 64, probes: int = 10) -> DataFrame:
    """(a, b, cosine) with a < b: each is among the k most similar others of the other, cosine at least ``min_similarity``.

    Unusable vectors and null ids are left out. Equal cosines are ordered by id. Rows that
    repeat an id and vector count once. Of a class of equal vectors only the k + 1 lowest
    ids can be mutual neighbours of anything, so only they are listed. A pair is found if
    either looks into the other's cell. An empty table gives no rows.
    """
    spark = df.sparkSession
    n = df.count()
    pivots = vx.pivots_by_hash(df, ident, vector, dim, n)
    classes = cut_lineage(vx.lowest_members(vx.code(df, ident, vector, dim, pivots, probes, parts=vx.directions(pivots, n), wide=False), k + 1))
    directed = _near(k, min_similarity, dim, vx.tiles(classes, None))
    pairs = cut_lineage(directed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    edges = vx.exact_cosines(pairs, rows, dim).where(F.col("cosine") >= min_similarity)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    own = classes.where(F.size("members") > 1).select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b"), F.lit(1.0).alias("cosine"))
    every = spread(both, classes, both=True).unionByName(own)
    top = best(every.where(F.col("a") != F.col("b")), k)
    mutual = top.groupBy(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine"))
    return mutual.where(F.col("n") == 2).select(F.col("_a").alias("a"), F.col("_b").alias("b"), "cosine")


def nearest(df: DataFrame, ident: str, vector: str, k: int, queries=None, dim: int = 64, probes: int = 48) -> DataFrame:
    """(a, b, rank, cosine): the k most similar others b of every query a.

    ``queries`` is a condition on rows of ``df``; None takes every row. All usable rows are
    searched; see ``operators.neighbors.nearest``.
    """
    base, asked = (rows.select(F.col(ident).alias("id"), F.col(vector).alias("v")) for rows in (df, df if queries is None else df.where(queries)))
    return search(base, asked, k, dim, probes)


def label_agreement(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, n_neighbours, agreement, suggested): share of neighbours with the own label.

    labels: (id, label), one row each. Neighbours without a label count as not agreeing.
    ``suggested`` is the most frequent neighbour label, the smallest on ties; null if none.
    """
    with_label = neighbours.join(labels.select(F.col("id").alias("b"), F.col("label").alias("other")), "b", "left")
    counted = with_label.groupBy("a", "other").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("other", F.when(F.col("other").isNotNull(), F.struct("n", -F.col("other"))))
    own = counted.join(labels.select(F.col("id").alias("a"), "label"), "a", "left")
    agree = F.sum(F.when(F.col("other") == F.col("label"), F.col("n")).otherwise(0))
    return own.groupBy("a", "label").agg(F.sum("n").alias("n_neighbours"), (agree / F.sum("n")).alias("agreement"), best.alias("suggested")).withColumnRenamed("a", "id")
