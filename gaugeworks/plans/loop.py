"""Active-learning rounds: query, move, train, evaluate, record."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import diversity, localization, uncertainty
from gaugeworks.session import cut_lineage

log = logging.getLogger(__name__)


@dataclass
class LoopConfig:
    budget_per_round: int = 100
    max_rounds: int = 10
    min_quality_gain: float = 0.001
    patience: int = 3
    train_epochs_per_round: int = 1
    seed: int = 42


@dataclass
class RoundResult:
    round_idx: int
    n_queried: int
    labeled_pool_size: int
    unlabeled_pool_size: int
    metrics: dict = field(default_factory=dict)
    #: Column ``id`` of the rows queried in this round; stays distributed.
    queried: DataFrame | None = None


def initial_pool(ids: DataFrame, config: LoopConfig, seed_ids: DataFrame | None = None) -> DataFrame:
    """(id, is_labeled, round_added): given ids, or as many as a round's budget by seeded hash order."""
    if seed_ids is None:
        order = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(config.seed))))
        seed_ids = ids.select("id").distinct().orderBy(order, "id").limit(config.budget_per_round).select("id")
    marked = seed_ids.select("id").distinct().withColumn("_in", F.lit(True))
    return ids.select("id").distinct().join(marked, "id", "left").select("id", F.coalesce("_in", F.lit(False)).alias("is_labeled"), F.lit(None).cast("int").alias("round_added"))


def move_pool(pool: DataFrame, queried: DataFrame, round_idx: int) -> DataFrame:
    """Marks the queried ids as labelled in this round; ids labelled before keep their round."""
    moved = queried.select("id").distinct().withColumn("_in", F.lit(True))
    fresh = F.col("_in").isNotNull() & ~F.col("is_labeled")
    return pool.join(moved, "id", "left").select("id", (F.col("is_labeled") | F.col("_in").isNotNull()).alias("is_labeled"), F.when(fresh, round_idx).otherwise(F.col("round_added")).cast("int").alias("round_added"))


@dataclass(frozen=True)
class Strategy:
    """What a round asks for: family ``uncertainty``, ``diversity`` or ``localization``, and its method."""

    family: str
    method: str

    def __post_init__(self):
        known = {"uncertainty": uncertainty.METHODS, "diversity": diversity.METHODS, "localization": localization.METHODS}
        if self.family not in known:
            raise TypeError(f"unknown strategy family {self.family!r}")
        if self.method not in known[self.family]:
            raise ValueError(f"method must be one of {known[self.family]}, not {self.method!r}")


class ActiveLearningLoop:
    """Runs rounds over ids with a backend (see ``plans.backends``); pools stay distributed."""

    def __init__(self, backend, ids: DataFrame, strategy: Strategy, config: LoopConfig | None = None, seed_ids: DataFrame | None = None, quality_metric: Callable[[object, DataFrame], float] | None = None, validation_ids: DataFrame | None = None):
        if not isinstance(strategy, Strategy):
            raise TypeError("strategy must be a Strategy")
        self.backend, self.strategy, self.config = backend, strategy, config or LoopConfig()
        self.quality_metric, self.validation_ids = quality_metric, validation_ids
        self.pool = cut_lineage(initial_pool(ids, self.config, seed_ids))
        self.history: list[RoundResult] = []

    def labeled(self) -> DataFrame:
        return self.pool.where("is_labeled").select("id")

    def unlabeled(self) -> DataFrame:
        return self.pool.where(~F.col("is_labeled")).select("id")

    def _query(self) -> DataFrame:
        budget, ids = self.config.budget_per_round, self.unlabeled()
        family, method = self.strategy.family, self.strategy.method
        if family == "uncertainty":
            samples = None
            if method == "bald":
                try:
                    samples = self.backend.mc_dropout_predict(ids)
                except NotImplementedError:
                    log.info("no Monte-Carlo samples; bald counts as entropy")
            return uncertainty.query(self.backend.predict_proba(ids), budget, method, samples).select("id")
        if family == "diversity":
            probs = self.backend.predict_proba(ids) if method == "cluster_margin" else None
            labeled = self.backend.get_embeddings(self.labeled()) if method == "coreset" else None
            return diversity.query(self.backend.get_embeddings(ids), budget, method, labeled=labeled, probs=probs, seed=self.config.seed).select("id")
        inputs = {}
        if method == "gradient_norm":
            inputs["gradients"] = self.backend.compute_gradients(ids)
        elif method == "spatial_entropy":
            inputs["spatial_logits"] = self.backend.spatial_logits(ids)
        else:
            inputs["train_losses"] = self.backend.predict_proba(ids).select("id", (1 - F.array_max("probs")).alias("loss"))
        return localization.query(localization.scores(method, **inputs), budget).select("id")

    def _train(self) -> dict:
        try:
            return {f"train_{k}": v for k, v in self.backend.train_one_epoch(self.labeled()).items()}
        except NotImplementedError:
            return {}

    def _evaluate(self) -> dict:
        if self.quality_metric is None or self.validation_ids is None:
            return {}
        try:
            return {"quality": float(self.quality_metric(self.backend, self.validation_ids))}
        except Exception:  # noqa: BLE001
            log.exception("evaluation failed")
            return {}

    def run(self) -> list[RoundResult]:
        """Rounds until the pool is empty, the cap is reached, or quality gains stay low for ``patience`` rounds."""
        before, streak = None, 0
        for number in range(self.config.max_rounds):
            if self.unlabeled().limit(1).count() == 0:
                break
            queried = cut_lineage(self._query())
            self.pool = cut_lineage(move_pool(self.pool, queried, number))
            metrics = {**self._train(), **self._evaluate()}
            sizes = {r["is_labeled"]: r["n"] for r in self.pool.groupBy("is_labeled").agg(F.count(F.lit(1)).alias("n")).collect()}
            self.history.append(RoundResult(number, queried.count(), sizes.get(True, 0), sizes.get(False, 0), metrics, queried))
            quality = metrics.get("quality")
            if quality is not None:
                if before is not None:
                    streak = streak + 1 if quality - before < self.config.min_quality_gain else 0
                before = quality
                if streak >= self.config.patience:
                    break
        return self.history

    def summary(self) -> list[dict]:
        return [{"round": r.round_idx + 1, "queried": r.n_queried, "labeled": r.labeled_pool_size, "unlabeled": r.unlabeled_pool_size, **r.metrics} for r in self.history]
