"""Annotation integrity checks; issues are rows of one table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import box
from gaugeworks.functions.plans import broadcast_if_small, join_crowded
from gaugeworks.session import cut_lineage
from gaugeworks.sources.coco import Dataset

COLUMNS = ("image_id", "ann_id", "issue_type", "severity", "details", "partner_id", "iou")
SEVERITY = {"out_of_bounds": "error", "tiny_box": "warning", "missing_bbox": "error", "malformed_bbox": "error", "degenerate_bbox": "error", "near_duplicate": "warning", "unknown_category": "error"}


def _predicates(min_bbox_area: float) -> dict[str, tuple[Column, Column]]:
    x, y, w, h = box("bbox")
    four = F.size("bbox") == 4
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    outside = (x < 0) | (y < 0) | (x + w > F.col("width") + 1) | (y + h > F.col("height") + 1)
    numbers = F.format_string("[%.1f, %.1f, %.1f, %.1f]", x, y, w, h)
    return {
        "out_of_bounds": (sized & four & outside, F.concat(numbers, F.format_string(" exceeds %dx%d", "width", "height"))),
        "tiny_box": (four & (w * h > 0) & (w * h < min_bbox_area), F.format_string("area %.2f", w * h)),
        "missing_bbox": (F.col("bbox").isNull(), F.lit("no box")),
        "malformed_bbox": (F.col("bbox").isNotNull() & ~four, F.format_string("%d values", F.size("bbox"))),
        "degenerate_bbox": (four & ((w <= 0) | (h <= 0)), F.format_string("width %.1f, height %.1f", w, h)),
    }


def simple_issues(data: Dataset, min_bbox_area: float = 4.0) -> DataFrame:
    """Issues that one annotation shows by itself, on known images; unknown categories included.

    One scan builds all of them. Null numbers inside a box raise no issue.
    """
    found = [F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(SEVERITY[t]).alias("severity"), d.alias("details"))) for t, (p, d) in _predicates(min_bbox_area).items()]
    known = broadcast_if_small(data.categories.select("category_id", F.lit(True).alias("_declared")))
    unknown = F.when(F.col("_declared").isNull(), F.struct(F.lit("unknown_category").alias("issue_type"), F.lit("error").alias("severity"), F.format_string("category %s", F.col("category_id").cast("string")).alias("details")))
    rows = join_crowded(data.annotations, data.images.select("image_id", "width", "height"), "image_id").join(known, "category_id", "left")
    issues = F.explode(F.array_compact(F.array(*found, unknown)))
    return rows.select("image_id", "ann_id", issues.alias("_i")).select("image_id", "ann_id", "_i.*", F.lit(None).cast("long").alias("partner_id"), F.lit(None).cast("double").alias("iou"))


#: Boxes on one image from which its boxes are spread over stripes; boxes that a worker compares at once; pairs it looks at in one step.
CROWDED, BUCKET, STEP = 2048, 50_000, 1_000_000
_PAIRS = "image_id long, category_id long, ann_id long, partner_id long, iou double"


def overlapping_pairs(annotations: DataFrame, min_iou: float, crowded: int = CROWDED) -> DataFrame:
    """(image_id, category_id, ann_id, partner_id, iou) of boxes of one image and category with IoU >= min_iou, 0 < min_iou <= 1.

    Such boxes differ little in size and place: widths and heights by a factor of
    1 / min_iou at most, corners by 1 - min_iou of the larger side. So of a pair the left
    box looks for the right one at most that far to its right, and a worker needs to see
    only the boxes of one image and category; those of images with more than ``crowded``
    boxes only of one octave of widths and one stripe as wide, in which left boxes are
    repeated. Inside, boxes are sorted by y and only a range of them is compared. The
    pair's first box is the one of lower ``ord``.
    Left out are boxes with a value that is null, not finite or of 1e15 and more in size,
    or with a side of 1e-9 or less.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be above 0 and at most 1")
    x, y, w, h = box("bbox")
    finite = F.size("bbox") == 4
    for v in (x, y, w, h):
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)
    boxes = annotations.where(finite & (w > 1e-9) & (h > 1e-9) & F.col("image_id").isNotNull() & F.col("category_id").isNotNull())
    boxes = boxes.select("image_id", "category_id", "ann_id", "ord", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    near = 1 / min_iou * (1 + 1e-9)

    def octave(v: Column) -> Column:
        return F.floor(F.log2(v)).cast("int")

    def cell(v: Column, size: Column) -> Column:
        return F.floor(v / F.pow(F.lit(2.0), size)).cast("long")

    def stripe(k: Column, c: Column, own: Column) -> Column:
        return F.struct(k.alias("k"), c.alias("c"), own.alias("own"))

    kw = octave(F.col("w"))
    own = cell(F.col("x"), kw)
    end = F.col("x") + F.col("w") * (1 - min_iou + 1e-9)
    stripes = F.flatten(F.transform(F.sequence(octave(F.col("w") / near), octave(F.col("w") * near)), lambda k: F.transform(F.sequence(cell(F.col("x"), k), cell(end, k)), lambda c: stripe(k, c, (k == kw) & (c == own)))))
    # at most one in ``crowded`` rows, written once; counted without boxes, so that redelivered rows are told apart by a hash
    many = cut_lineage(annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded).select("image_id", F.lit(True).alias("_many")))
    marked = boxes.join(broadcast_if_small(many), "image_id", "left")
    whole = F.array(stripe(F.lit(0), F.lit(0).cast("long"), F.lit(True)))
    spread = marked.withColumn("_s", F.explode(F.when(F.col("_many"), stripes).otherwise(whole))).select("image_id", "category_id", "ann_id", "ord", "x", "y", "w", "h", "_s.*")
    buckets = spread.withColumn("_b", F.pmod(F.xxhash64("image_id", "category_id", "k", "c"), F.lit(1 << 20))).repartition("_b").sortWithinPartitions("_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if rows + batch.num_rows > BUCKET and batch.num_rows:
                # what follows the last change of bucket waits for the next batch
                b = batch.column("_b").to_numpy()
                changes = np.flatnonzero(b[1:] != b[:-1]) + 1
                if held and held[-1].column("_b")[-1].as_py() != b[0]:
                    changes = np.append(0, changes)
                if len(changes):
                    yield from _overlaps(pa.Table.from_batches([*held, batch.slice(0, changes[-1])]), min_iou)
                    held, rows, batch = [], 0, batch.slice(changes[-1])
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from _overlaps(pa.Table.from_batches(held), min_iou)

    return buckets.mapInArrow(compare, _PAIRS)


def _overlaps(rows: pa.Table, min_iou: float) -> Iterator[pa.RecordBatch]:
    """The pairs among rows of the same image, category and stripe whose right box is in its own stripe."""
    if rows.num_rows < 2:
        return
    image, category, order, k, c, own, x, y, w, h = (rows.column(n).to_numpy() for n in ("image_id", "category_id", "ord", "k", "c", "own", "x", "y", "w", "h"))
    by = np.lexsort((y, c, k, category, image))
    change = np.zeros(len(by), bool)
    for v in (image, category, k, c):
        s = v[by]
        change[1:] |= s[1:] != s[:-1]
    group = np.cumsum(change)
    alone = np.bincount(group)[group] < 2
    by, group = by[~alone], group[~alone]
    right = own[by]
    b, b_group = by[right], group[right]
    if not len(b):
        return
    # places of y among all, so that one number has group and place
    level = np.sort(y[b])
    n = len(b) + 1
    key = b_group * n + np.searchsorted(level, y[b], "left")
    room, slack = 1 - min_iou + 1e-9, 1e-15 * np.abs(y[by])
    begin = np.searchsorted(key, group * n + np.searchsorted(level, y[by] - h[by] * (room / min_iou) - slack, "left"), "left")
    count = np.searchsorted(key, group * n + np.searchsorted(level, y[by] + h[by] * room + slack, "right"), "left") - begin
    reach = x + w * room + 1e-15 * np.abs(x)
    upto = np.cumsum(count)
    at = 0
    while at < len(by):
        before = upto[at - 1] if at else 0
        # one row's range may be longer than a step, never longer than the rows
        to = max(at + 1, int(np.searchsorted(upto, before + STEP, "right")))
        reps = count[at:to]
        left = np.repeat(by[at:to], reps)
        second = b[np.arange(len(left)) - np.repeat(upto[at:to] - reps - before, reps) + np.repeat(begin[at:to], reps)]
        ax, bx = x[left], x[second]
        good = (bx >= ax) & (bx <= reach[left])
        left, second, ax, bx = left[good], second[good], ax[good], bx[good]
        # of two boxes that begin at one x, the one of lower order is the left one
        good = (ax < bx) | (order[left] < order[second])
        left, second = left[good], second[good]
        ax, ay, aw, ah, bx, by_, bw, bh = x[left], y[left], w[left], h[left], x[second], y[second], w[second], h[second]
        iw = np.maximum(np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx), 0.0)
        ih = np.maximum(np.minimum(ay + ah, by_ + bh) - np.maximum(ay, by_), 0.0)
        iou = iw * ih / (aw * ah + bw * bh - iw * ih)
        good = np.flatnonzero(iou >= min_iou)
        if len(good):
            left, second = left[good], second[good]
            swap = order[left] > order[second]
            first, other = np.where(swap, second, left), np.where(swap, left, second)
            ids = rows.column("ann_id").combine_chunks()
            columns = [pa.array(image[left]), pa.array(category[left]), ids.take(pa.array(first)), ids.take(pa.array(other)), pa.array(iou[good])]
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", "category_id", "ann_id", "partner_id", "iou"])
        at = to


def near_duplicates(data: Dataset, max_overlap_iou: float = 0.85) -> DataFrame:
    """One issue per pair of boxes of one known image and category, on the earlier one."""
    pairs = overlapping_pairs(data.annotations, max_overlap_iou).join(data.images.select("image_id"), "image_id", "left_semi")
    text = F.format_string("IoU %.3f with %s", F.col("iou"), F.col("partner_id").cast("string"))
    return pairs.select("image_id", "ann_id", F.lit("near_duplicate").alias("issue_type"), F.lit("warning").alias("severity"), text.alias("details"), "partner_id", "iou")


def all_issues(data: Dataset, min_bbox_area: float = 4.0, max_overlap_iou: float = 0.85) -> DataFrame:
    """All issues; an annotation may have several."""
    return simple_issues(data, min_bbox_area).unionByName(near_duplicates(data, max_overlap_iou)).select(*COLUMNS)


def issue_summary(issues: DataFrame) -> DataFrame:
    """(issue_type, severity, n) by grouping sets: per type, per severity and in all; absent keys are null."""
    n = F.count(F.lit(1)).alias("n")
    return issues.groupingSets([["issue_type"], ["severity"], []], "issue_type", "severity").agg(n)


def check_report(issues: DataFrame, limit: int = 200) -> dict:
    """Total, counts by type (most first) and severity (ascending), and the first issues, as one bounded dict."""
    rows = issue_summary(issues).collect()
    return {
        "total_issues": next((r["n"] for r in rows if r["issue_type"] is None and r["severity"] is None), 0),
        "by_type": {r["issue_type"]: r["n"] for r in sorted((r for r in rows if r["issue_type"]), key=lambda r: (-r["n"], r["issue_type"]))},
        "by_severity": {r["severity"]: r["n"] for r in sorted((r for r in rows if r["severity"]), key=lambda r: r["severity"])},
        "issues": [r.asDict() for r in issues.select("image_id", "ann_id", "issue_type", "severity", "details").orderBy("image_id", "ann_id", "issue_type").limit(limit).collect()],
    }
