"""Whole audits: statistics, checks and optional scores into one report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.operators import checks, label_quality, mislabel, stats
from gaugeworks.session import cut_lineage
from gaugeworks.sources import folders
from gaugeworks.sources.coco import Dataset, read_coco
from gaugeworks.sources.report import Report


def persisted(data: Dataset) -> Dataset:
    return Dataset(data.images.persist(), data.categories.persist(), data.annotations.persist(), data.image_root)


def dataset_section(data: Dataset, tail_percentile: float) -> dict:
    counts = cut_lineage(stats.class_counts(data))
    out, tail, density, sizes = stats.together(
        lambda: stats.summary(data, counts=counts),
        lambda: [r["name"] for r in stats.tail_categories(counts, tail_percentile).collect()],
        lambda: {r["name"]: r["density"] for r in stats.annotation_density(data).collect()},
        lambda: {r["measure"]: {k: v for k, v in r.asDict().items() if k != "measure"} for r in stats.image_size_statistics(data).collect()},
    )
    return {**out, "tail_categories": tail, "annotation_density": density, "image_size_statistics": sizes or {"note": "no image sizes"}}


def long_tail_report(data: Dataset, percentile: float = 10.0) -> dict:
    counts = stats.class_counts(data)
    rows = stats.long_tail(counts, percentile).collect()
    return {
        "class_distribution": [r.asDict() for r in stats.class_distribution(counts).collect()],
        "class_imbalance": rows[0].asDict() if rows else {},
        "tail_categories": [r["name"] for r in stats.tail_categories(counts, percentile).collect()],
    }


def audit(data: Dataset, name: str = "dataset", *, min_bbox_area: float = 4.0, max_overlap_iou: float = 0.85, tail_percentile: float = 10.0, probabilities: DataFrame | None = None, embeddings: DataFrame | None = None, report_dir=None) -> dict:
    """Statistics, checks and, with (id, label, probs) or (id, label, embedding), label scores; saved if a folder is given."""
    # no section needs areas and crowd flags
    data = persisted(Dataset(data.images, data.categories, data.annotations.drop("area", "iscrowd"), data.image_root))

    report = Report(name)
    # one section after another: plans of all of them at once take the driver's memory
    report.add("dataset_statistics", dataset_section(data, tail_percentile))
    issues = checks.all_issues(data, min_bbox_area, max_overlap_iou).persist()
    report.add("annotation_checks", checks.check_report(issues))
    for df in (issues, data.images, data.categories, data.annotations):
        df.unpersist()
    if probabilities is not None:
        n = label_quality.validate(probabilities)
        quality = label_quality.quality_summary(probabilities, n).first().asDict()
        quality["top_issues"] = [r.asDict() for r in label_quality.ranked_issues(probabilities, top_k=50).collect()]
        report.add("label_quality", quality)
    if embeddings is not None:
        detector = mislabel.MislabelDetector(embeddings)
        report.add("mislabel_detection", detector.summary())
        detector.close()
    if report_dir is not None:
        report.save_json(Path(report_dir) / f"{name}_report.json")
        report.save_html(Path(report_dir) / f"{name}_report.html")
    return report.to_dict()


def audit_file(spark: SparkSession, path: str, name: str = "dataset", **options) -> dict:
    return audit(read_coco(spark, path), name, **options)


def audit_folders(spark: SparkSession, root: str, name: str = "folders", max_per_class: int | None = None, tail_percentile: float = 10.0, report_dir=None) -> dict:
    """Statistics of a class-per-folder tree; it has no boxes to check."""
    listing = folders.list_folders(spark, root).persist()
    data = persisted(folders.to_dataset(folders.labelled_files(listing, max_per_class), folders.class_labels(listing)))
    report = Report(name).add("dataset_statistics", dataset_section(data, tail_percentile))
    if report_dir is not None:
        report.save_json(Path(report_dir) / f"{name}_report.json")
        report.save_html(Path(report_dir) / f"{name}_report.html")
    return report.to_dict()


def folder_imbalance(spark: SparkSession, root: str) -> dict:
    listing = folders.list_folders(spark, root)
    return long_tail_report(folders.to_dataset(folders.labelled_files(listing), folders.class_labels(listing)))
