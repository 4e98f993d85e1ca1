"""References to records that do not exist, were deleted before or arrive later.

Sorted integer parent keys are compressed into contiguous runs inside fixed key blocks.
Distinct referenced keys are matched as-of to the preceding run start of their block; a
key beyond the run's end has no parent at all. Keys inside a run are then held against
their parent's lives. Only keys that can fail for some reference go back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.session import cut_lineage

#: Keys of one block fit in one task: at most this many distinct parents and references.
BLOCK_BITS = 14
#: A referenced key is hot when it holds at least this share of all references, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.002
#: Lives of a key that are compared column by column; keys with more are compared row by row.
LIFE_SLOTS = 4


def key_runs(keys: DataFrame, key: str = "key", by: Sequence[str] = ()) -> DataFrame:
    """(by..., block, run_start, run_end) of the distinct integer keys; null keys are ignored.

    Runs end at block borders, so each block is numbered on its own and the count of rows
    in a window is bounded by the block size, however many keys there are.
    """
    block = F.shiftright(F.col(key), BLOCK_BITS)
    distinct = keys.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("long").alias(key)).distinct().withColumn("block", block)
    number = F.row_number().over(Window.partitionBy(*by, "block").orderBy(key))
    return distinct.withColumn("_run", F.col(key) - number).groupBy(*by, "block", "_run").agg(F.min(key).alias("run_start"), F.max(key).alias("run_end")).drop("_run")


def match_runs(keys: DataFrame, runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``run_end`` of the run that starts at or before ``key`` in its block, and ``exists``.

    ``keys`` must hold each (by..., key) once.
    """
    other = [c for c in keys.columns if c not in (*by, "key")]
    left = keys.select(*by, F.shiftright("key", BLOCK_BITS).alias("block"), F.col("key").alias("_at"), F.lit(1).alias("_kind"), F.struct("key", *other).alias("_row"), F.lit(None).cast("long").alias("run_end"))
    right = runs.select(*by, "block", F.col("run_start").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "run_end")
    preceding = Window.partitionBy(*by, "block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = left.unionByName(right).withColumn("run_end", F.last("run_end", ignorenulls=True).over(preceding)).where(F.col("_kind") == 1)
    return matched.select(*by, "_row.*", "run_end", F.coalesce(F.col("_at") <= F.col("run_end"), F.lit(False)).alias("exists"))


def _lives_at(begin: str, end: str | None = None) -> tuple[Column, Column]:
    """(live, begun) for the first LIFE_SLOTS lives: whether one spans [begin, end], and whether one had begun.

    Spelled out by slot: a predicate with a lambda that reads other columns may be pushed
    to a side of a join that lacks them.
    """
    live = begun = F.lit(False)
    for i in range(LIFE_SLOTS):
        life = F.get("lives", F.lit(i))
        on = F.coalesce(life["added_at"] <= F.col(begin), F.lit(False))
        begun = begun | on
        live = live | (on & F.coalesce(life["deleted_at"] > F.col(end or begin), F.lit(True)))
    return live, begun


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_id, ref_field, key, at, ref_state) of references without a live parent.

    refs: (ref_id, ref_field, key, at); each reference once. Null keys refer to nothing
    and are ignored. parents: (ref_field, key, added_at, deleted_at), repeats allowed. A
    parent row is live at ``at`` if added_at <= at and deleted_at is null or later than
    ``at``. ref_state is ``missing`` if the key has no parent row, ``deleted`` if some row
    has added_at <= at, else ``late``. A null ``at`` or added_at makes no row live, so
    such references are ``late`` when the key exists.
    """
    refs = refs.where(F.col("key").isNotNull()).select("ref_id", "ref_field", F.col("key").cast("long").alias("key"), "at")
    parents = parents.where(F.col("key").isNotNull()).select("ref_field", F.col("key").cast("long").alias("key"), "added_at", "deleted_at")
    lives = parents.groupBy("ref_field", "key").agg(F.collect_set(F.struct("added_at", "deleted_at")).alias("lives"))
    # one row for each referenced key; written, as counts, runs and hot keys are all taken from it
    used = cut_lineage(refs.groupBy("ref_field", "key").agg(F.count(F.lit(1)).alias("n_refs"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("at").alias("n_at")))
    matched = match_runs(used, key_runs(parents, by=["ref_field"]), by=["ref_field"])
    # a life that spans all references of a key settles them together
    settled = (F.col("n_at") == F.col("n_refs")) & _lives_at("first_at", "last_at")[0]
    looked = matched.join(lives, ["ref_field", "key"], "left")
    doubtful = looked.where(~F.col("exists") | ~settled).select("ref_field", "key", "n_refs", F.when(F.col("exists"), F.col("lives")).alias("lives"))
    total = used.agg(F.sum("n_refs").alias("_all"))
    # at most 1 / HOT_SHARE keys can be hot, and the lives of a key are a few, so this side is bounded
    hot_at = F.col("n_refs") >= F.col("_all") * HOT_SHARE
    doubtful = cut_lineage(doubtful.crossJoin(F.broadcast(total)).withColumn("_hot", hot_at).drop("_all", "n_refs"))  # one row
    hot_keys = used.crossJoin(F.broadcast(total)).where(hot_at).select("ref_field", "key", F.lit(True).alias("_is_hot"))
    tagged = refs.join(F.broadcast(hot_keys), ["ref_field", "key"], "left")
    hot = tagged.where("_is_hot").drop("_is_hot").join(F.broadcast(doubtful.where("_hot").drop("_hot")), ["ref_field", "key"])
    cold = tagged.where(F.col("_is_hot").isNull()).drop("_is_hot").join(doubtful.where(~F.col("_hot")).drop("_hot"), ["ref_field", "key"])
    both = hot.unionByName(cold).select("ref_id", "ref_field", "key", "at", "lives")
    live, begun = _lives_at("at")
    state = F.when(F.col("lives").isNull(), "missing").when(begun, "deleted").otherwise("late")
    few = both.where((F.coalesce(F.size("lives"), F.lit(0)) <= LIFE_SLOTS) & ~live).select("ref_id", "ref_field", "key", "at", state.alias("ref_state"))
    each = both.where(F.size("lives") > LIFE_SLOTS).select("ref_id", "ref_field", "key", "at", F.explode("lives").alias("_l"))
    on = F.coalesce(F.col("_l.added_at") <= F.col("at"), F.lit(False))
    many = each.groupBy("ref_id", "ref_field", "key", "at").agg(F.bool_or(on).alias("_begun"), F.bool_or(on & F.coalesce(F.col("_l.deleted_at") > F.col("at"), F.lit(True))).alias("_live"))
    return few.unionByName(many.where(~F.col("_live")).select("ref_id", "ref_field", "key", "at", F.when(F.col("_begun"), "deleted").otherwise("late").alias("ref_state")))


def annotation_references(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (ref_id, ref_field, key, at) of distinct annotations, and their parents.

    The distinct annotations are written once, as references are counted and then looked up.
    """
    one = annotations.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("image_id", "category_id", "created_at")])
    one = cut_lineage(one)
    refs = one.select(F.col("id").alias("ref_id"), F.col("created_at").alias("at"), F.explode(F.create_map(F.lit("image_id"), F.col("image_id"), F.lit("category_id"), F.col("category_id"))).alias("ref_field", "key"))
    sides = [t.select(F.lit(f).alias("ref_field"), F.col("id").alias("key"), "added_at", "deleted_at") for f, t in (("image_id", images), ("category_id", categories))]
    return refs.select("ref_id", "ref_field", "key", "at"), sides[0].unionByName(sides[1])


def orphans_by_period(orphans: DataFrame, period: str = "month") -> DataFrame:
    """(ref_field, ref_state, period, n_refs, n_keys); a null time has a null period."""
    compressed = orphans.groupBy("ref_field", "ref_state", F.date_trunc(period, "at").alias("period"), "key").agg(F.count(F.lit(1)).alias("n"))
    return compressed.groupBy("ref_field", "ref_state", "period").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
