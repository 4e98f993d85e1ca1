"""Checks and scores over unbounded input; all are stateless, so late rows need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.checks import simple_issues
from gaugeworks.sources.coco import Dataset


def stream_issues(annotations: DataFrame, images: DataFrame, categories: DataFrame, min_bbox_area: float = 4.0) -> DataFrame:
    """Issues of a stream of annotations (ann_id, image_id, category_id, bbox) against stored images and categories.

    The joins are stream to static; the same predicates as in ``operators.checks`` apply.
    """
    from gaugeworks.operators.checks import SEVERITY, _predicates

    found = [F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(SEVERITY[t]).alias("severity"), d.alias("details"))) for t, (p, d) in _predicates(min_bbox_area).items()]
    known = categories.select("category_id", F.lit(True).alias("_declared"))
    unknown = F.when(F.col("_declared").isNull(), F.struct(F.lit("unknown_category").alias("issue_type"), F.lit("error").alias("severity"), F.format_string("category %s", F.col("category_id").cast("string")).alias("details")))
    rows = annotations.join(images.select("image_id", "width", "height"), "image_id").join(known, "category_id", "left")
    return rows.select("image_id", "ann_id", F.explode(F.array_compact(F.array(*found, unknown))).alias("_i")).select("image_id", "ann_id", "_i.*")


def batch_issues(batch: DataFrame, data: Dataset) -> DataFrame:
    """For ``foreachBatch``: all simple issues of one micro-batch, with crowded images handled."""
    return simple_issues(Dataset(data.images, data.categories, batch))
