"""Dataset statistics: class distribution, imbalance, geometry, density, co-occurrence.

Every function returns a DataFrame; tables of one row per class are small and may be
sorted globally, everything per annotation is aggregated before it is joined.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gaugeworks.functions.plans import broadcast_if_small, crowded_keys, join_crowded
from gaugeworks.operators.hot_keys import near_ranks, weighted_percentiles
from gaugeworks.session import cut_lineage
from gaugeworks.sources.coco import Dataset


T = TypeVar("T")


def whole() -> WindowSpec:
    """All rows of a small table."""
    return Window.partitionBy(F.lit(0))


_SUMMARY = ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))


def class_counts(data: Dataset) -> DataFrame:
    """(category_id, name, n, first_ord) of the categories that occur; unknown categories are skipped.

    Counting comes before the join, so a crowded category reaches it as one row.
    """
    per = data.annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return per.join(data.categories.select("category_id", "name"), "category_id").select("category_id", "name", "n", "first_ord")


def class_counts_strict(data: Dataset) -> DataFrame:
    """As ``class_counts``, but raises KeyError when an annotation has an undeclared category."""
    unknown = data.annotations.join(data.categories.select("category_id"), "category_id", "left_anti").select("category_id").limit(1).collect()
    if unknown:
        raise KeyError(unknown[0][0])
    return class_counts(data)


def class_distribution(counts: DataFrame) -> DataFrame:
    """(name, n, fraction), most frequent first, earlier first appearance on ties."""
    share = F.col("n") / F.greatest(F.sum("n").over(whole()), F.lit(1))
    return counts.withColumn("fraction", share).orderBy(F.desc("n"), "first_ord").select("name", "n", "fraction")


def tail_categories(counts: DataFrame, percentile: float = 10.0) -> DataFrame:
    """(name, n, fraction) with counts at or below the linear-interpolated percentile of the counts."""
    limit = F.percentile("n", F.lit(percentile / 100.0)).over(whole())
    share = F.col("n") / F.greatest(F.sum("n").over(whole()), F.lit(1))
    return counts.withColumn("fraction", share).withColumn("_limit", limit).where(F.col("n") <= F.col("_limit")).orderBy(F.desc("n"), "first_ord").select("name", "n", "fraction")


def class_imbalance(counts: DataFrame) -> DataFrame:
    """One row: gini, entropy_bits, max_entropy_bits, imbalance_ratio, effective_classes; none without classes."""
    ranked = counts.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n", "category_id"))).withColumn("_p", F.col("n") / F.sum("n").over(whole()))
    nats = -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0))
    k, s = F.count(F.lit(1)), F.sum("n")
    gini = 2 * F.sum(F.col("_i") * F.col("n")) / (k * s) - (k + 1) / k
    return (
        ranked.agg(gini.alias("g"), nats.alias("h"), k.alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo"))
        .where(F.col("k") > 0)
        .select(
            F.round("g", 6).alias("gini"),
            F.round(F.col("h") / F.lit(0.6931471805599453), 6).alias("entropy_bits"),
            F.round(F.when(F.col("k") > 1, F.log2("k")).otherwise(0.0), 6).alias("max_entropy_bits"),
            F.round(F.col("hi") / F.greatest("lo", F.lit(1)), 4).alias("imbalance_ratio"),
            F.round(F.exp("h"), 4).alias("effective_classes"),
        )
    )


def _per_image(data: Dataset) -> DataFrame:
    """(image_id, n) of every known image, 0 included; a crowded image reaches the join as one row."""
    per = data.annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return data.images.select("image_id").join(per, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def annotations_per_image(data: Dataset) -> DataFrame:
    """One row: mean, population std, max and min of annotations per image; nulls without images."""
    return _per_image(data).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.max("n").alias("max"), F.min("n").alias("min"))


def _sides() -> tuple[Column, Column]:
    w, h = F.coalesce(F.nullif("width", F.lit(0)), F.lit(1)), F.coalesce(F.nullif("height", F.lit(0)), F.lit(1))
    return w.cast("double"), h.cast("double")


def bbox_statistics(data: Dataset) -> DataFrame:
    """(measure, n, min, p25, median, mean, p75, p95, max) of area, width, height, aspect_ratio and relative_area.

    Boxes of known images with four values that are all finite; aspect is 0 where the
    height is not positive; relative area is against the mean area of all images, null and
    zero sizes counting as 1. Percentiles are exact: values are counted by
    buckets, those of the buckets that hold the ranks are sorted. No rows without boxes.
    """
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    finite = F.size("bbox") == 4
    for v in b:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    w, h = _sides()
    mean_area = data.images.agg(F.avg(w * h).alias("_mean"))
    boxes = data.annotations.where(finite).select("image_id", b[2].alias("w"), b[3].alias("h"))
    boxes = join_crowded(boxes, data.images.select("image_id"), "image_id", "left_semi", crowded_keys(data.annotations, "image_id")).select("w", "h")
    boxes = cut_lineage(boxes)  # read twice, for the buckets and for the values of the wanted ones
    area = F.col("w") * F.col("h")
    aspect = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0)
    measures = boxes.select(F.explode(F.create_map(F.lit("area"), area, F.lit("width"), F.col("w"), F.lit("height"), F.col("h"), F.lit("aspect_ratio"), aspect)).alias("measure", "value"))
    fractions = [q for q, _ in _SUMMARY]
    buckets, compressed = near_ranks(measures, ["measure"], "value", fractions)
    simple = buckets.groupBy("measure").agg(F.sum("n").alias("_n"), F.min("min").alias("min"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("max").alias("max"))
    exact = weighted_percentiles(compressed, ["measure"], "value", fractions)
    wide = exact.groupBy("measure").agg(*[F.max(F.when(F.abs(F.col("fraction") - q) < 1e-9, F.col("percentile"))).alias(n) for q, n in _SUMMARY])
    values = ["min", "p25", "median", "mean", "p75", "p95", "max"]
    out = simple.join(wide, "measure").select("measure", F.col("_n").alias("n"), *values).crossJoin(F.broadcast(mean_area))  # one row
    # relative areas are areas over one number, so their statistics are those of the areas over it
    scale = F.when(F.col("_as") == "relative_area", F.greatest("_mean", F.lit(1e-300))).otherwise(1.0)
    both = out.withColumn("_as", F.explode(F.when(F.col("measure") == "area", F.array(F.lit("area"), F.lit("relative_area"))).otherwise(F.array("measure"))))
    return both.select(F.col("_as").alias("measure"), "n", *[(F.col(v) / scale).alias(v) for v in values])


def image_size_statistics(data: Dataset) -> DataFrame:
    """(measure, n, min, mean, median, max, unique_sizes) of width, height and aspect_ratio of images with both sizes."""
    sized = data.images.where(F.col("width").isNotNull() & F.col("height").isNotNull()).groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    long = sized.select("n", F.explode(F.create_map(F.lit("width"), w, F.lit("height"), h, F.lit("aspect_ratio"), w / F.greatest(h, F.lit(1.0)))).alias("measure", "value"))
    unique = sized.agg(F.count(F.lit(1)).alias("unique_sizes"))
    weighted = long.groupBy("measure", "value").agg(F.sum("n").alias("n"))
    simple = weighted.groupBy("measure").agg(F.sum("n").alias("_n"), F.min("value").alias("min"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.max("value").alias("max"))
    median = weighted_percentiles(weighted, ["measure"], "value", [0.5]).select("measure", F.col("percentile").alias("median"))
    return simple.join(median, "measure").crossJoin(F.broadcast(unique)).select("measure", F.col("_n").alias("n"), "min", "mean", "median", "max", "unique_sizes")  # one row


def annotation_density(data: Dataset) -> DataFrame:
    """(category_id, name, density): mean over the category's images of all annotations on them; 0 if unused."""
    pairs = data.annotations.where(F.col("image_id").isNotNull()).groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    # a window holds the categories of one image
    totals = pairs.withColumn("_all", F.sum("n").over(Window.partitionBy("image_id")))
    per = totals.groupBy("category_id").agg(F.avg("_all").alias("density"))
    return data.categories.select("category_id", "name").join(per, "category_id", "left").select("category_id", "name", F.round(F.coalesce("density", F.lit(0.0)), 4).alias("density"))


def co_occurrence(data: Dataset) -> DataFrame:
    """(category_i, category_j, n): images with both categories, both orders; the diagonal has images with i.

    Images come down to distinct category sets with a weight before pairs are formed, so
    pairs depend on the kinds of sets, not on the images. Unknown ids are left out; pairs
    that never meet have no row, except the diagonal.
    """
    known = data.annotations.where(F.col("image_id").isNotNull()).join(broadcast_if_small(data.categories.select("category_id")), "category_id", "left_semi")
    sets = known.groupBy("image_id").agg(F.collect_set("category_id").alias("_s")).join(data.images.select("image_id"), "image_id", "left_semi")
    weighted = sets.groupBy(F.array_sort("_s").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    pairs = weighted.select("n", "_s", F.explode("_s").alias("category_i")).select("n", "category_i", F.explode("_s").alias("category_j")).groupBy("category_i", "category_j").agg(F.sum("n").alias("n"))
    ids = data.categories.select(F.col("category_id").alias("category_i"), F.col("category_id").alias("category_j"), F.lit(0).cast("long").alias("n"))
    return pairs.unionByName(ids).groupBy("category_i", "category_j").agg(F.sum("n").alias("n"))


def resampling_weights(counts: DataFrame) -> DataFrame:
    """(name, weight): 1 / (classes * fraction), rounded to 6."""
    k, s = F.count(F.lit(1)).over(whole()), F.sum("n").over(whole())
    return counts.select("category_id", "name", F.round(1 / (k * F.greatest(F.col("n") / s, F.lit(1e-9))), 6).alias("weight"))


def oversampling_plan(counts: DataFrame, target_count: int | None = None) -> DataFrame:
    """(name, n, extra): copies to add to reach the target; None or 0 means the largest class."""
    target = F.lit(target_count) if target_count else F.max("n").over(whole())
    return counts.select("category_id", "name", "n", F.greatest(target - F.col("n"), F.lit(0)).cast("long").alias("extra"))


def long_tail(counts: DataFrame, percentile: float = 10.0) -> DataFrame:
    """One row: classes, tail_count, head_count and the imbalance metrics."""
    tail = counts.withColumn("_limit", F.percentile("n", F.lit(percentile / 100.0)).over(whole())).agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") <= F.col("_limit")).alias("tail_count"))
    return class_imbalance(counts).crossJoin(tail).withColumn("head_count", F.col("classes") - F.col("tail_count"))  # one row each


def together(*parts: Callable[[], T]) -> list[T]:
    """The results of parts that read the same data, which run at once as each leaves most tasks idle."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(p) for p in parts]]


def summary(data: Dataset, top: int | None = None, counts: DataFrame | None = None) -> dict:
    """Counts, per-image and box statistics, imbalance and class counts as one bounded dict; ``counts`` are the class counts if they are there already."""
    counts = cut_lineage(class_counts(data)) if counts is None else counts
    sizes, per_image, imbalance, boxes, classes = together(
        lambda: data.counts().first().asDict(),
        lambda: annotations_per_image(data).first().asDict(),
        lambda: class_imbalance(counts).collect(),
        lambda: {r["measure"]: {k: v for k, v in r.asDict().items() if k != "measure"} for r in bbox_statistics(data).collect()},
        lambda: [r.asDict() for r in (class_distribution(counts).limit(top) if top else class_distribution(counts)).collect()],
    )
    return {**sizes, "annotations_per_image": per_image, "class_imbalance": imbalance[0].asDict() if imbalance else {}, "bbox_statistics": boxes, "class_distribution": classes}
