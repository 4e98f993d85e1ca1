"""Per-key results where a few keys hold most rows, by value-frequency compression.

Rows are first grouped by (key, value), which combines on the map side and spreads a
hot key over as many reducers as it has values. Everything per key is then derived
from the weighted values: totals and distinct counts by partial aggregation, modes by
a struct maximum, exact percentiles by prefix sums over range-partitioned slices, so
that no task ever holds the values of a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.session import cut_lineage


def compress_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (keys..., value, n): how often each value occurs under each key; null values keep their own row."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def key_totals(compressed: DataFrame, key: str) -> DataFrame:
    """(key, n_rows) from compressed rows; null keys are left out."""
    return compressed.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n_rows"))


def key_profile(compressed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n_rows, n_null, n_distinct, mode (smallest value on ties) and mode_rows.

    Null keys have no row. A key with only null values has n_distinct 0 and a null mode.
    """
    known = F.col(value).isNotNull()
    best = F.max_by(F.col(value), F.when(known, F.struct(F.col("n"), -F.col(value))))
    return (
        compressed.where(_all_known(keys))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).cast("long").alias("n_null"),
            F.count(F.when(known, F.lit(1))).alias("n_distinct"),
            best.alias("mode"),
            F.max(F.when(known, F.col("n"))).alias("mode_rows"),
        )
    )


def weighted_percentiles(compressed: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], interpolate: bool = True) -> DataFrame:
    """Exact percentiles of weighted values: (keys..., fraction, n_rows, percentile).

    ``compressed`` has (keys..., value, n). With ``interpolate`` the result is linear
    between the two nearest ranks, else the smallest value whose cumulative share
    reaches the fraction. Null values and null keys are ignored; NaN sorts last.
    """
    return slice_percentiles(value_slices(compressed, keys, value), keys, value, fractions, interpolate)


def near_ranks(values: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """What exact interpolated percentiles of plain rows (keys..., value) need: (buckets, compressed).

    Values are counted by buckets that rise with them, about 0.8 % wide. Only buckets that
    hold a wanted rank, two at most for each key and fraction, keep their values; of the
    others ``compressed`` has the least value with all rows, which moves no wanted rank. So
    few values are shuffled and sorted. ``buckets`` has (keys..., n, min, max, total).
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(800.0)) * 128).cast("long") + 100_000  # from 4,700 on, infinity and NaN included
    rows = values.where(_all_known(keys) & F.col(value).isNotNull()).select(*keys, value, F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -size).otherwise(size).alias("_bucket"))
    buckets = cut_lineage(rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(v).alias("total")))
    by_key = Window.partitionBy(*keys)
    placed = buckets.withColumn("n_rows", F.sum("n").over(by_key)).withColumn("_end", F.sum("n").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.lit(False)
    for q in fractions:
        for rank in _ranks(float(q), True)[:2]:
            wanted = wanted | ((rank <= F.col("_end")) & (rank > F.col("_end") - F.col("n")))
    placed = cut_lineage(placed.withColumn("_wanted", wanted))
    kept = rows.join(F.broadcast(placed.where("_wanted").select(*keys, "_bucket")), [*keys, "_bucket"])
    compressed = compress_values(kept, keys, value).unionByName(placed.where("not _wanted").select(*keys, F.col("min").alias(value), "n"))
    return buckets, compressed


def value_slices(compressed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, n, _slice) of known keys and values, written to the checkpoint folder.

    Slices come from a range partitioning on (keys, value), which splits a hot key. They
    are written once, as the borders come from a sample: a second run could cut elsewhere.
    """
    rows = compressed.where(_all_known(keys) & F.col(value).isNotNull()).select(*keys, value, "n")
    return cut_lineage(rows.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_slice", F.spark_partition_id()))


def slice_percentiles(sliced: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], interpolate: bool = True) -> DataFrame:
    """``weighted_percentiles`` from ``value_slices``: offsets are sums over the slices before, one row per key and slice."""
    keys = list(keys)
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n_rows", F.sum("_n").over(by_key))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("fraction"), r.alias("_lo_rank"), h.alias("_hi_rank"), w.alias("_w")) for q in fractions for r, h, w in [_ranks(float(q), interpolate)]])
    # only slices that hold a wanted rank go on
    needed = (
        per_slice.withColumn("_q", F.explode(wanted))
        .select(*keys, "_slice", "_before", "_n", "n_rows", "_q.*")
        .withColumn("_rank", F.explode(F.array_distinct(F.array("_lo_rank", "_hi_rank"))))
        .where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
    )
    here = [*keys, "_slice"]
    running = F.sum("n").over(Window.partitionBy(*here).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    slices = needed.select(*here, "_before").distinct()
    inside = sliced.join(slices, here).select(*here, F.col(value).alias("_v"), F.col("n").alias("_c"), (F.col("_before") + running).alias("_end"))
    ends = needed.select(*here, "fraction", "n_rows", "_lo_rank", "_w", "_rank")
    found = inside.join(ends, here).where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_c")))
    found = found.select(*keys, "fraction", "n_rows", "_rank", "_lo_rank", "_w", "_v")
    lo = F.max(F.when(F.col("_rank") == F.col("_lo_rank"), F.col("_v")))
    hi = F.max(F.when(F.col("_rank") != F.col("_lo_rank"), F.col("_v")))
    out = found.groupBy(*keys, "fraction", "n_rows", "_w").agg(lo.alias("_a"), hi.alias("_b"))
    picked = F.col("_a") + (F.coalesce(F.col("_b"), F.col("_a")) - F.col("_a")) * F.col("_w") if interpolate else F.col("_a")
    return out.select(*keys, "fraction", "n_rows", picked.alias("percentile"))


def _ranks(q: float, interpolate: bool) -> tuple[Column, Column, Column]:
    if interpolate:
        at = F.lit(q) * (F.col("n_rows") - 1)
        return (F.floor(at) + 1).cast("long"), (F.ceil(at) + 1).cast("long"), at - F.floor(at)
    rank = F.greatest(F.ceil(F.lit(q) * F.col("n_rows")), F.lit(1)).cast("long")
    return rank, rank, F.lit(0.0)


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def hot_keys(compressed: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """(key_field, key_value, n_rows, share): keys of each field that hold at least ``share`` of all rows.

    ``compressed`` is grouped by all ``fields`` at once; each field's totals are sums of
    those weighted rows. Rows with a null key count in the total and are never reported.
    """
    # one Expand keeps the compressed rows from being made once for each field
    long = compressed.select("n", F.posexplode(F.array(*[F.col(f).cast("long") for f in fields])).alias("_f", "key_value"))
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("_f") + 1)
    totals = long.groupBy("_f", "key_value").agg(F.sum("n").alias("n_rows"))
    whole = totals.where(F.col("_f") == 0).agg(F.sum("n_rows").alias("_all"))
    return (
        totals.where(F.col("key_value").isNotNull())
        .crossJoin(F.broadcast(whole))  # one row
        .where(F.col("n_rows") >= F.col("_all") * share)
        .select(names.alias("key_field"), "key_value", "n_rows", (F.col("n_rows") / F.col("_all")).alias("share"))
    )
