"""Annotation datasets: one JSON document, or tables, as three DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gaugeworks.session import cut_lineage, scratch_folder
from gaugeworks.sources.elements import elements, splittable
from gaugeworks.sources.images import decode_rgb

SCHEMA = """
images array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>,
categories array<struct<id:bigint,name:string,supercategory:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>
"""


@dataclass(frozen=True)
class Dataset:
    """images (image_id, file_name, width, height, ord), categories (category_id, name, supercategory, ord), annotations (ann_id, image_id, category_id, bbox, area, iscrowd, ord)."""

    images: DataFrame
    categories: DataFrame
    annotations: DataFrame
    image_root: str | None = None

    def counts(self) -> DataFrame:
        """One row: num_images, num_categories, num_annotations."""
        parts = [df.select(F.lit(n).alias("t")) for n, df in (("i", self.images), ("c", self.categories), ("a", self.annotations))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.count_if(F.col("t") == t).alias(n) for t, n in (("i", "num_images"), ("c", "num_categories"), ("a", "num_annotations"))])

    def category_names(self) -> DataFrame:
        return self.categories.orderBy("ord").select("name")

    def of_image(self, image_id: int) -> DataFrame:
        return self.annotations.where(F.col("image_id") == image_id)

    def of_category(self, category_id: int) -> DataFrame:
        return self.annotations.where(F.col("category_id") == category_id)

    def image_ids_of_category(self, category_id: int) -> DataFrame:
        return self.of_category(category_id).select("image_id").distinct()

    def boxes_of_image(self, image_id: int) -> DataFrame:
        """(x, y, w, h) of the image's boxes with four values, in order."""
        rows = self.of_image(image_id).where(F.size("bbox") == 4).orderBy("ord")
        return rows.select(*[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")])

    def labels_of_image(self, image_id: int) -> DataFrame:
        return self.of_image(image_id).orderBy("ord").select("category_id")

    def with_annotations(self) -> DataFrame:
        """Images with the list of their annotations in order; for datasets whose images each have a bounded number."""
        each = F.array_sort(F.collect_list(F.struct("ord", "ann_id", "category_id", "bbox")))
        return self.images.join(self.annotations.groupBy("image_id").agg(each.alias("annotations")), "image_id", "left").withColumn("annotations", F.coalesce("annotations", F.array()))

    def iter_images(self, with_annotations: bool = False) -> Iterator:
        """Pairs (image, its annotations in order, or None) one image after another, without holding them all."""
        images = self.images.orderBy("ord", "image_id").toLocalIterator()
        if not with_annotations:
            yield from ((image, None) for image in images)
            return
        order = self.images.select("image_id", F.col("ord").alias("_image_ord"))
        rows = self.annotations.join(order, "image_id").orderBy("_image_ord", "image_id", "ord").toLocalIterator()
        row = next(rows, None)
        for image in images:
            own = []
            while row is not None and row["image_id"] == image["image_id"]:
                own.append(row)
                row = next(rows, None)
            yield image, own

    def image_files(self) -> DataFrame:
        """(image_id, file_name, content): the stored bytes of every image whose file_name is a path below the image root; empty files count as missing."""
        if self.image_root is None:
            raise RuntimeError("the dataset has no image root")
        spark = self.images.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(self.image_root)
        prefix = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.image_root)
        named = files.select(F.substring("path", len(prefix) + 1, 2**31 - 1).alias("_n"), "content")
        return self.images.join(named, F.regexp_replace("file_name", r"^(?:\./|/)+", "") == F.col("_n")).select("image_id", "file_name", "content")

    def load_image(self, image_id: int):
        """Pixels of one image as an array of rows, columns and three values; KeyError without such an image, FileNotFoundError without its file."""
        one = Dataset(self.images.where(F.col("image_id") == image_id), self.categories, self.annotations, self.image_root)
        if self.image_root is not None and one.images.limit(1).count() == 0:
            raise KeyError(image_id)
        found = one.image_files().select("content").first()
        if found is None:
            raise FileNotFoundError(f"image {image_id} has no file below {self.image_root}")
        return decode_rgb(bytes(found["content"]))

    def subset(self, image_ids: DataFrame) -> Dataset:
        """The images named by column ``image_id`` with their annotations; all categories stay."""
        keep = image_ids.select("image_id").distinct()
        return Dataset(self.images.join(keep, "image_id", "left_semi"), self.categories, self.annotations.join(keep, "image_id", "left_semi"), self.image_root)

    def split(self, train_ratio: float = 0.8, seed: int = 42) -> tuple[Dataset, Dataset]:
        """Two disjoint datasets with exactly int(n * ratio) images in the first, the same for the same seed."""
        marked = split_marks(self.images.select("image_id"), train_ratio, seed)
        return self.subset(marked.where("is_train")), self.subset(marked.where(~F.col("is_train")))

    def describe(self) -> str:
        r = self.counts().first()
        return f"Dataset(images={r['num_images']}, categories={r['num_categories']}, annotations={r['num_annotations']})"


def split_marks(ids: DataFrame, train_ratio: float, seed: int) -> DataFrame:
    """(image_id, is_train): the int(n * ratio) ids of lowest md5 are in the first part.

    A prefix of the digest cuts the ids into slices, counted in one pass; only the slice
    in which the border falls is sorted.
    """
    hashed = ids.where(F.col("image_id").isNotNull()).distinct().withColumn("_h", F.md5(F.concat_ws("-", F.col("image_id").cast("string"), F.lit(str(seed))))).withColumn("_s", F.substring("_h", 1, 3))
    slices = hashed.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    run = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("_s")
    slices = slices.withColumn("_end", F.sum("_n").over(run)).withColumn("_cut", F.floor(F.sum("_n").over(whole) * F.lit(float(train_ratio))).cast("long")).withColumn("_begin", F.col("_end") - F.col("_n"))
    placed = hashed.join(F.broadcast(slices), "_s")
    clear = placed.where((F.col("_end") <= F.col("_cut")) | (F.col("_begin") >= F.col("_cut"))).select("image_id", (F.col("_end") <= F.col("_cut")).alias("is_train"))
    border = placed.where((F.col("_end") > F.col("_cut")) & (F.col("_begin") < F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", "image_id"))
    return clear.unionByName(border.select("image_id", (F.col("_begin") + rank <= F.col("_cut")).alias("is_train")))


def _last(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "ord").alias("_r")).select(key, "_r.*")


def read_coco(spark: SparkSession, path: str, image_root: str | None = None) -> Dataset:
    """Reads one annotation document; of several images or categories with one id the last counts.

    A document that is one file in UTF-8 is cut into its elements by many tasks, so none
    holds more than one of them at a time; others (compressed, folders, other encodings)
    are parsed by one task. The rows are then written and spread.

    Raises when the file is missing or is no JSON document.
    """
    if splittable(spark, path):
        texts = elements(spark, path, tuple(_PARTS))
        kinds = {f.name: f.dataType.elementType for f in StructType.fromDDL(SCHEMA).fields}
        parsed = texts.select("part", "ord", *[F.when(F.col("part") == name, F.from_json("text", kinds[name], {"mode": "FAILFAST"})).alias(f"_{name}") for name in _PARTS])
        fields = [F.col(f"_{name}.{f}").alias(f) for name, names in _PARTS.items() for f in names]
        rows = cut_lineage(parsed.select("part", F.coalesce(*[F.col(f"_{name}.id") for name in _PARTS]).alias("id"), "ord", *fields))
    else:
        raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
        rows = cut_lineage(raw.select(F.explode(F.concat(*[_tagged(name) for name in _PARTS])).alias("_r")).select("_r.*").repartition(spark.sparkContext.defaultParallelism))

    def part(name: str, key: str) -> DataFrame:
        return rows.where(F.col("part") == name).select(F.col("id").alias(key), *_PARTS[name], "ord")

    return Dataset(_last(part("images", "image_id"), "image_id"), _last(part("categories", "category_id"), "category_id"), part("annotations", "ann_id"), image_root)


#: The fields of each part besides its id.
_PARTS = {"images": ("file_name", "width", "height"), "categories": ("name", "supercategory"), "annotations": ("image_id", "category_id", "bbox", "area", "iscrowd")}


def _tagged(name: str) -> Column:
    """The elements of one part as structs that have the fields of all parts, so that one explode gives all rows."""
    kinds = {f.name: {g.name: g.dataType for g in f.dataType.elementType.fields} for f in StructType.fromDDL(SCHEMA).fields}

    def one(x: Column, i: Column) -> Column:
        fields = [x[f].alias(f) if part == name else F.lit(None).cast(kinds[part][f]).alias(f) for part, names in _PARTS.items() for f in names]
        return F.struct(F.lit(name).alias("part"), x["id"].alias("id"), i.cast("long").alias("ord"), *fields)

    return F.coalesce(F.transform(name, one), F.array())


def write_coco(data: Dataset, path: str) -> None:
    """Writes one annotation document in the order of ``ord``: tasks write its rows, the driver's JVM copies their files into one, as a document is a single file."""
    spark = data.images.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, place = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    files = place.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    keys = {"images": "image_id", "categories": "category_id", "annotations": "ann_id"}
    try:
        for n, (part, fields) in enumerate(_PARTS.items()):
            out.write(bytearray((f'{{"{part}":[' if n == 0 else f'],"{part}":[').encode()))
            row = F.to_json(F.struct(F.col(keys[part]).alias("id"), *fields))
            getattr(data, part).orderBy("ord").select(row.alias("r")).write.option("lineSep", ",\n").option("compression", "none").text(place.toString())
            written = sorted((f.getPath().getName(), f.getLen(), f.getPath()) for f in files.listStatus(place) if f.getPath().getName().startswith("part-") and f.getLen())
            for i, (_, size, file) in enumerate(written):
                rows = files.open(file)
                try:
                    # no comma after the last row
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, size - 2 * (i == len(written) - 1), False)
                finally:
                    rows.close()
            files.delete(place, True)
        out.write(bytearray(b"]}"))
    finally:
        out.close()
        files.delete(place, True)


def from_tables(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> Dataset:
    """A dataset from stored tables, whose rows may be redelivered.

    Each id counts once, null ids not at all: of images the row added last (then with the
    largest content), of categories likewise; annotations repeat their content. The order
    is that of the ids.
    """

    def one(df: DataFrame, key: str, columns: list[str], order: list[Column] | None) -> DataFrame:
        known = df.where(F.col("id").isNotNull())
        if order is None:
            rows = known.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
        else:
            rows = known.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("id", "_r.*")
        return rows.withColumn("ord", F.col("id")).withColumnRenamed("id", key)

    return Dataset(
        one(images, "image_id", ["file_name", "width", "height"], [F.col(c) for c in ("added_at", "width", "height", "file_name")]),
        one(categories, "category_id", ["name", "supercategory"], [F.col(c) for c in ("added_at", "name", "supercategory")]),
        one(annotations, "ann_id", ["image_id", "category_id", "bbox", "area", "iscrowd"], None),
    )
