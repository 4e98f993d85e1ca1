"""Class-per-folder image trees as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.sources.coco import Dataset

#: Suffixes of image files.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")


def is_image(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)).isin(*SUFFIXES)


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """(class_name, path) of the image files directly in the class folders; the tree must be on storage all workers share.

    Class names come from the driver, the listing of each folder from a worker. A folder
    without images has one row with a null path. Hidden and zero-length files count.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    names = sorted(e.name for e in os.scandir(root) if e.is_dir())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["class_name"]:
                files = sorted(e.path for e in os.scandir(os.path.join(root, name)) if e.is_file() and os.path.splitext(e.name)[1].lower() in SUFFIXES)
                yield pd.DataFrame({"class_name": name, "path": pd.Series(files or [None], dtype="object")})

    classes = spark.createDataFrame([(n,) for n in names], "class_name string")
    return classes.repartition(max(1, min(len(names), 256))).mapInPandas(scan, "class_name string, path string") if names else spark.createDataFrame([], "class_name string, path string")


def class_labels(listing: DataFrame) -> DataFrame:
    """(class_name, label): classes in the order of their names from 0; classes without images count."""
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("class_name")) - 1  # one row for each class
    return listing.select("class_name").where(F.col("class_name").isNotNull()).distinct().withColumn("label", order)


def labelled_files(listing: DataFrame, max_per_class: int | None = None) -> DataFrame:
    """(path, class_name, label) of image paths, at most the first ``max_per_class`` by path of each class."""
    files = listing.where(F.col("path").isNotNull() & is_image())
    if max_per_class is not None:
        files = files.withColumn("_r", F.row_number().over(Window.partitionBy("class_name").orderBy("path"))).where(F.col("_r") <= max_per_class).drop("_r")
    return files.join(F.broadcast(class_labels(listing)), "class_name").select("path", "class_name", "label")


def to_dataset(files: DataFrame, labels: DataFrame) -> Dataset:
    """One annotation per image over the unit box; ids follow class and path, numbered within sorted slices."""
    sorted_files = files.repartitionByRange(F.col("label"), F.col("path")).withColumn("_s", F.spark_partition_id())
    per = sorted_files.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    offset = per.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_s").orderBy("label", "path")) - 1
    numbered = sorted_files.join(F.broadcast(offset), "_s").withColumn("image_id", F.col("_o") + within)
    null_size = F.lit(None).cast("long")
    images = numbered.select("image_id", F.col("path").alias("file_name"), null_size.alias("width"), null_size.alias("height"), F.col("image_id").alias("ord"))
    categories = labels.select(F.col("label").cast("long").alias("category_id"), F.col("class_name").alias("name"), F.lit("").alias("supercategory"), F.col("label").cast("long").alias("ord"))
    annotations = numbered.select(F.col("image_id").alias("ann_id"), "image_id", F.col("label").cast("long").alias("category_id"), F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]).alias("bbox"), F.lit(1.0).alias("area"), F.lit(0).alias("iscrowd"), F.col("image_id").alias("ord"))
    return Dataset(images, categories, annotations)
