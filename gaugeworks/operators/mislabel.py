"""Mislabel detection from embeddings. Input rows: (id, label, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.plans import broadcast_if_small
from gaugeworks.operators.neighbors import exact_neighbours, usable_rows, vector_size


def knn_quality(neighbours: DataFrame) -> DataFrame:
    """(id, label, knn_score): share of the neighbours with the row's own label; neighbours without a label have another one.

    Rows without a label have no score.
    """
    own = F.coalesce(F.col("label") == F.col("neighbour_label"), F.lit(False))
    return neighbours.where(F.col("label").isNotNull()).groupBy("id", "label").agg(F.avg(own.cast("double")).alias("knn_score"))


def prototypes(df: DataFrame, dim: int) -> DataFrame:
    """(label, prototype): normalised mean of a label's normalised rows; sums are formed in each partition first."""

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            m = m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-12)[:, None]
            for label in np.unique(labels):
                own = m[labels == label]
                n, s = sums.get(int(label), (0, np.zeros(dim)))
                sums[int(label)] = (n + len(own), s + own.sum(axis=0))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.float64()))], names=["label", "n", "s"])

    rows = df.where((F.size("embedding") == dim) & F.col("label").isNotNull()).select(F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    parts = rows.mapInArrow(partial, "label int, n long, s array<double>")
    # one row for each label, partition and position
    mean = parts.select("label", "n", F.posexplode("s").alias("pos", "s")).groupBy("label", "pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    length = F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))), F.lit(1e-12))
    unit = mean.withColumn("m", F.col("m") / length)
    return unit.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r.m).alias("prototype"))


def prototype_distance(df: DataFrame, dim: int) -> DataFrame:
    """(id, label, distance): 1 - cosine of the row and the prototype of its label."""
    side = broadcast_if_small(prototypes(df, dim), 10_000)
    rows = df.select("id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v")).join(side, "label")
    step = lambda a, p: F.struct((a.d + p.x * p.y).alias("d"), (a.s + p.x * p.x).alias("s"))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"))
    pairs = F.zip_with("v", "prototype", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    cosine = F.aggregate(pairs, zero, step, lambda a: a.d / F.greatest(F.sqrt(a.s), F.lit(1e-12)))
    return rows.select("id", "label", (1 - cosine).alias("distance"))


def combined_score(knn: DataFrame, distance: DataFrame, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """(id, label, score): alpha * knn_score + beta * (1 - distance / largest distance); low is suspicious."""
    most = distance.agg(F.greatest(F.max("distance"), F.lit(1e-9)).alias("_most"))
    both = knn.join(distance.select("id", "distance"), "id").crossJoin(F.broadcast(most))  # one row
    return both.select("id", "label", (F.lit(alpha) * F.col("knn_score") + F.lit(beta) * (1 - F.col("distance") / F.col("_most"))).alias("score"))


def rank_candidates(scores: DataFrame, neighbours: DataFrame, top_k: int | None = None) -> DataFrame:
    """(id, given_label, suggested_label, score, mislabel_score, neighbour_counts), lowest score first, lower id on ties.

    suggested_label is the most frequent label among the neighbours, the smallest on ties;
    neighbour_counts holds their number by label, up to the largest that occurs. Neighbours
    without a label do not count; where none has one both are null.
    """
    chosen = scores.orderBy("score", "id").limit(top_k) if top_k is not None else scores
    votes = neighbours.where(F.col("neighbour_label").isNotNull()).join(chosen.select("id"), "id", "left_semi").groupBy("id", "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    counts = F.map_from_entries(F.collect_list(F.struct("neighbour_label", "n")))
    per = votes.groupBy("id").agg(F.max_by("neighbour_label", F.struct("n", -F.col("neighbour_label"))).alias("suggested_label"), counts.alias("_c"), F.max("neighbour_label").alias("_top"))
    dense = F.transform(F.sequence(F.lit(0), F.col("_top")), lambda i: F.coalesce(F.try_element_at("_c", i), F.lit(0)))
    return chosen.join(per, "id", "left").select("id", F.col("label").alias("given_label"), "suggested_label", "score", (1 - F.col("score")).alias("mislabel_score"), dense.alias("neighbour_counts")).orderBy("score", "id")


def mislabel_summary(scores: DataFrame) -> DataFrame:
    """One row: n_samples, mean_score, flagged_count; flagged is below 0.5."""
    return scores.agg(F.count(F.lit(1)).alias("n_samples"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") < 0.5).alias("flagged_count"))


class MislabelDetector:
    """Neighbours and prototypes of one embedding table, found once and shared by all scores."""

    SCORES = ("combined", "knn", "prototype")

    def __init__(self, df: DataFrame, n_neighbors: int = 10, metric: str = "cosine"):
        self.dim = vector_size(df)
        self.rows = usable_rows(df.select("id", "label", "embedding"), self.dim)
        self.neighbours = exact_neighbours(df, n_neighbors, metric, self.dim).persist()

    @classmethod
    def from_probabilities(cls, df: DataFrame, n_neighbors: int = 10) -> MislabelDetector:
        """Takes the probabilities of rows (id, label, probs) as embeddings."""
        return cls(df.select("id", "label", F.col("probs").alias("embedding")), n_neighbors)

    def scores(self, kind: str = "combined") -> DataFrame:
        """(id, label, score); any name but knn and prototype means combined."""
        knn = knn_quality(self.neighbours)
        if kind == "knn":
            return knn.withColumnRenamed("knn_score", "score")
        distance = prototype_distance(self.rows, self.dim)
        if kind == "prototype":
            most = distance.agg(F.greatest(F.max("distance"), F.lit(1e-9)).alias("_most"))
            return distance.crossJoin(F.broadcast(most)).select("id", "label", (1 - F.col("distance") / F.col("_most")).alias("score"))  # one row
        return combined_score(knn, distance)

    def candidates(self, top_k: int | None = None, kind: str = "combined") -> DataFrame:
        return rank_candidates(self.scores(kind), self.neighbours, top_k)

    def summary(self) -> dict:
        scores = self.scores().persist()
        out = mislabel_summary(scores).first().asDict()
        out["top_candidates"] = [r.asDict() for r in rank_candidates(scores, self.neighbours, 10).collect()]
        scores.unpersist()
        return out

    def close(self) -> None:
        self.neighbours.unpersist()


