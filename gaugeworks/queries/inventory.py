"""Queries of sources, lookups, reports and whole rounds, and of the vector operators on dirty tables."""

from __future__ import annotations

import json
import os
import pathlib
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import cli
from gaugeworks.operators import checks as ck
from gaugeworks.operators import diversity as dv
from gaugeworks.operators import label_quality as lq
from gaugeworks.operators import localization as lz
from gaugeworks.operators import mislabel as ml
from gaugeworks.operators import stats as st
from gaugeworks.operators import uncertainty as un
from gaugeworks.operators.neighbors import exact_neighbours, usable_rows
from gaugeworks.plans import recipes
from gaugeworks.plans.backends import BatchFunctionBackend, TableBackend
from gaugeworks.plans.loop import ActiveLearningLoop, LoopConfig, Strategy, initial_pool
from gaugeworks.queries import audit as au
from gaugeworks.session import cut_lineage, scratch_folder
from gaugeworks.sources import folders
from gaugeworks.sources.coco import read_coco, write_coco
from gaugeworks.sources.tables import table

DIM = 64


# --- documents and folders


def coco_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The tables written as one annotation document and read again: rows of each part, their ids, and known sizes, names or boxes."""
    place = scratch_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    try:
        write_coco(au.dataset(spark, folder), f"{place}/annotations.json")
        data = read_coco(spark, f"{place}/annotations.json")
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    parts = ((data.images, "image_id", "width"), (data.categories, "category_id", "name"), (data.annotations, "ann_id", "bbox"))
    out = None
    for name, (rows, key, known) in zip(("images", "categories", "annotations"), parts):
        one = rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("id_sum"), F.count(known).alias("known"))
        out = one if out is None else out.unionByName(one)
    return out


def _tree(spark: SparkSession, folder: str) -> str:
    """A tree of empty files on the shared folder, one for each document: its source is the class folder, nine in ten are images."""
    root = scratch_folder(spark).removeprefix("file:")
    suffix = F.when(F.pmod("doc_id", F.lit(10)) == 0, ".txt").when(F.pmod("doc_id", F.lit(10)) == 1, ".JPEG").otherwise(".png")
    names = table(spark, folder, "documents").select(F.coalesce("source", F.lit("none")).alias("c"), F.concat(F.col("doc_id").cast("string"), suffix).alias("f"))

    def create(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["c"].unique():
                os.makedirs(os.path.join(root, c), exist_ok=True)
            for c, f in zip(pdf["c"], pdf["f"]):
                open(os.path.join(root, c, f), "wb").close()
            yield pd.DataFrame({"n": [len(pdf)]})

    names.mapInPandas(create, "n long").agg(F.sum("n")).collect()
    return root


def folder_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A tree on disk as a dataset: images of each class, and the numbers they got."""
    root = _tree(spark, folder)
    try:
        listing = cut_lineage(folders.list_folders(spark, root))
    finally:
        shutil.rmtree(root, ignore_errors=True)
    labels = folders.class_labels(listing)
    data = folders.to_dataset(folders.labelled_files(listing), labels)
    per = data.annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first_id"), F.max("image_id").alias("last_id"))
    return per.join(data.categories, "category_id").select(F.col("name").alias("class_name"), F.col("category_id").alias("label"), "n", "first_id", "last_id")


def folder_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    root = _tree(spark, folder)
    try:
        out = recipes.folder_imbalance(spark, root)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    m = out["class_imbalance"]
    names = ("gini", "entropy_bits", "max_entropy_bits", "imbalance_ratio", "effective_classes")
    return spark.createDataFrame([(*(float(m[n]) for n in names), len(out["class_distribution"]), len(out["tail_categories"]))], ", ".join(f"{n} double" for n in names) + ", classes long, tail long")


def folder_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts of the report on a tree on disk."""
    root = _tree(spark, folder)
    try:
        out = recipes.audit_folders(spark, root)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    stats = out["sections"]["dataset_statistics"]
    return spark.createDataFrame([(r["name"], int(r["n"]), int(stats["num_images"])) for r in stats["class_distribution"]], "name string, n long, num_images long")


# --- lookups


def category_names(spark: SparkSession, folder: str) -> DataFrame:
    return au.dataset(spark, folder).category_names()


def _most(rows: DataFrame, key: str) -> int:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).first()[key]


def image_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of the image with the most annotations."""
    data = au.dataset(spark, folder)
    return data.boxes_of_image(_most(data.annotations, "image_id"))


def image_labels(spark: SparkSession, folder: str) -> DataFrame:
    """How often each label is among those of the image with the most annotations, and how many annotations it has."""
    data = au.dataset(spark, folder)
    image = _most(data.annotations, "image_id")
    n = data.of_image(image).agg(F.count(F.lit(1)).alias("of_image"))
    return data.labels_of_image(image).groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))  # one row


def category_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of the category with the most annotations."""
    data = au.dataset(spark, folder)
    return data.image_ids_of_category(_most(data.annotations, "category_id"))


def subset_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the subset of wide images."""
    data = au.dataset(spark, folder)
    return data.subset(data.images.where(F.col("width") > F.col("height")).select("image_id")).counts()


# --- reports


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of the dataset summary as rows (name, value)."""
    out = st.summary(au.dataset(spark, folder))
    rows = [(n, out[n]) for n in ("num_images", "num_categories", "num_annotations")]
    rows += [(f"per_image_{k}", v) for k, v in out["annotations_per_image"].items()] + list(out["class_imbalance"].items())
    rows += [(f"{m}_median", v["median"]) for m, v in out["bbox_statistics"].items()] + [("classes", len(out["class_distribution"]))]
    return spark.createDataFrame([(n, None if v is None else round(float(v), 6)) for n, v in rows], "name string, value double")


def check_details(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of every issue that one annotation shows by itself."""
    return ck.simple_issues(au.dataset(spark, folder)).select("image_id", "ann_id", "issue_type", "details")


def check_tiny_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of less than 100 square pixels."""
    return ck.simple_issues(au.dataset(spark, folder), 100.0).where(F.col("issue_type") == "tiny_box").select("image_id", "ann_id", "severity")


def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    """Issues by type and label figures in the report of a whole audit."""
    near = au._vectors(spark, folder)
    out = recipes.audit(au.dataset(spark, folder), "tables", probabilities=au._probs(spark, folder), embeddings=near)["sections"]
    rows = [("annotation_checks", k, float(v)) for k, v in out["annotation_checks"]["by_type"].items()] + [("annotation_checks", "total", float(out["annotation_checks"]["total_issues"]))]
    rows += [("label_quality", k, round(float(out["label_quality"][k]), 6)) for k in ("n_samples", "mean_score", "flagged_count")]
    rows += [("mislabel_detection", k, round(float(out["mislabel_detection"][k]), 6)) for k in ("n_samples", "mean_score", "flagged_count")]
    return spark.createDataFrame(rows, "section string, name string, value double")


def label_validation(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(lq.validate(au._probs(spark, folder)),)], "classes int")


def dataset_repr(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(au.dataset(spark, folder).describe(),)], "text string")


def command_line(spark: SparkSession, folder: str) -> DataFrame:
    """What the four commands say of the tables written as a document, and of the documents as a tree: figures of their JSON output."""
    place, root = scratch_folder(spark).removeprefix("file:"), _tree(spark, folder)
    os.makedirs(place)
    try:
        document = f"{place}/annotations.json"
        write_coco(au.dataset(spark, folder), f"file:{document}")
        runs = [cli.main(["stats", document, "-o", f"{place}/stats.json"], spark), cli.main(["check", document, "-o", f"{place}/check.json"], spark)]
        runs += [cli.main(["report", document, "-n", "one", "-o", place], spark), cli.main(["folders", root, "-n", "two", "-o", place], spark)]
        stats, check, one, two = (json.loads(pathlib.Path(place, f).read_text()) for f in ("stats.json", "check.json", "one_report.json", "two_report.json"))
        page = pathlib.Path(place, "one_report.html").read_text()
    finally:
        shutil.rmtree(root, ignore_errors=True)
        shutil.rmtree(place, ignore_errors=True)
    rows = [("failed", sum(runs)), ("stats_images", stats["num_images"]), ("stats_annotations", stats["num_annotations"]), ("check_issues", check["total_issues"])]
    rows += [("report_issues", one["sections"]["annotation_checks"]["total_issues"]), ("report_sections", len(one["sections"])), ("page_sections", page.count("<h2>")), ("folder_images", two["sections"]["dataset_statistics"]["num_images"])]
    return spark.createDataFrame(rows, "name string, value long")


# --- selectors and rounds


def mislabel_from_probs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour scores with probabilities as embeddings."""
    detector = ml.MislabelDetector.from_probabilities(au._probs(spark, folder), 10)
    out = cut_lineage(au._rounded(detector.scores("knn")))
    detector.close()
    return out


def unc_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return au._rounded(un.ranked(au._probs(spark, folder), "least_confidence"))


def diversity_query(spark: SparkSession, folder: str) -> DataFrame:
    unlabeled, labeled = au._pools(spark, folder)
    return dv.query(unlabeled, 5, "coreset", labeled=labeled)


def cluster_margin_promises(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the picks of cluster margin are distinct rows, one a cluster, no more than asked for."""
    picks = dv.query(au._vectors(spark, folder), 20, "cluster_margin", probs=au._probs(spark, folder))
    return picks.agg((F.count(F.lit(1)) <= 20).alias("within_budget"), (F.count_distinct("id") == F.count(F.lit(1))).alias("distinct_rows"), (F.count_distinct("pick") == F.count(F.lit(1))).alias("one_a_cluster"))


def localization_query(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 rows with the longest gradients."""
    grads = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.slice("embedding", 17, 16).alias("grad"))
    return au._rounded(lz.query(lz.scores("gradient_norm", gradients=grads), 50))


def first_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 rows that a loop begins with."""
    return initial_pool(au._vectors(spark, folder).select("id"), LoopConfig()).where("is_labeled").select("id")


def loop_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Three rounds of 40 rows by entropy: pool sizes after each, and the sum of the ids it asked for."""
    probs = cut_lineage(au._probs(spark, folder).select("id", "probs"))
    loop = ActiveLearningLoop(TableBackend(probs, au._vectors(spark, folder).select("id", "embedding")), probs.select("id"), Strategy("uncertainty", "entropy"), LoopConfig(budget_per_round=40, max_rounds=3))
    rows = [(r.round_idx, r.n_queried, r.labeled_pool_size, r.unlabeled_pool_size, r.queried.agg(F.sum("id")).first()[0]) for r in loop.run()]
    return spark.createDataFrame(rows, "round int, queried long, labeled long, unlabeled long, id_sum long")


def _backend(spark: SparkSession, folder: str) -> tuple[BatchFunctionBackend, DataFrame]:
    """A model whose logits are the first three values of a vector, scaled by the pass."""
    rows = au._vectors(spark, folder).select("id", F.col("embedding").cast("array<double>").alias("features"))
    backend = BatchFunctionBackend(rows, lambda m, seed: m[:, :3] * (1.0 if seed is None else 1.0 + seed), lambda m: m[:, 3:5], lambda m: 2 * m[:, :4], lambda df: {"rows": df.count()}, passes=2)
    return backend, rows.select("id")


def backend_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, probs, embedding, grad) as one row of numbers each, and how many rows an epoch saw."""
    backend, ids = _backend(spark, folder)
    out = backend.predict_proba(ids).join(backend.get_embeddings(ids), "id").join(backend.compute_gradients(ids), "id")
    numbers = [F.round(F.get(c, F.lit(i)), 6).alias(f"{c}_{i}") for c, n in (("probs", 3), ("embedding", 2), ("grad", 4)) for i in range(n)]
    return out.select("id", *numbers, F.lit(backend.train_one_epoch(ids)["rows"]).cast("long").alias("epoch_rows"))


def backend_passes(spark: SparkSession, folder: str) -> DataFrame:
    """The first probability of every pass with dropout."""
    backend, ids = _backend(spark, folder)
    return backend.mc_dropout_predict(ids).select("pass", "id", F.round(F.get("probs", F.lit(0)), 6).alias("p"))


def loop_of_gradients(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that two rounds of 30 by gradient length ask for."""
    backend, ids = _backend(spark, folder)
    loop = ActiveLearningLoop(backend, ids, Strategy("localization", "gradient_norm"), LoopConfig(budget_per_round=30, max_rounds=2))
    loop.run()
    return loop.pool.where(F.col("round_added").isNotNull()).select("id", F.col("round_added").alias("round"))


# --- vectors as they come


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sample_vectors").select(F.col("sample_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding")


def _pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "pool_vectors").select(F.col("pool_id").alias("id"), "embedding", F.coalesce("is_labeled", F.lit(False)).alias("l"))
    return rows.where("not l").drop("l"), rows.where("l").drop("l")


def sample_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar other samples of every usable sample."""
    return au._rounded(exact_neighbours(_samples(spark, folder), 5, dim=DIM).select("id", "neighbour_id", "rank", "similarity"))


def _sample_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    near = cut_lineage(exact_neighbours(_samples(spark, folder), 5, dim=DIM))
    return ml.combined_score(ml.knn_quality(near), ml.prototype_distance(usable_rows(_samples(spark, folder), DIM), DIM)), near


def sample_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Combined score of every usable sample with a label."""
    return au._rounded(_sample_scores(spark, folder)[0])


def sample_mislabels(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 samples whose labels are the most doubtful."""
    scores, near = _sample_scores(spark, folder)
    return au._rounded(ml.rank_candidates(scores, near, 100).select("id", "given_label", "suggested_label", "score"))


def pool_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every usable unlabelled row of the pool to the nearest labelled one."""
    return au._rounded(dv.min_distance(*_pool(spark, folder), DIM))


def pool_coreset(spark: SparkSession, folder: str) -> DataFrame:
    """Five k-center picks from the pool, given its labelled rows."""
    unlabeled, labeled = _pool(spark, folder)
    return dv.coreset(unlabeled, 5, labeled, DIM)


QUERIES = {
    f.__name__: f
    for f in (
        coco_scan, folder_tree, folder_imbalance, folder_audit, category_names, image_boxes, image_labels, category_images, subset_counts,
        dataset_summary, check_details, check_tiny_wide, audit_report, label_validation, mislabel_from_probs, unc_ranked, diversity_query,
        dataset_repr, command_line, backend_outputs, backend_passes, loop_of_gradients, cluster_margin_promises, localization_query, first_pool, loop_rounds, sample_neighbours, sample_scores, sample_mislabels, pool_distances, pool_coreset,
    )
}

# --- SQL

_W = "with" + au._DATA
_HOT = "(select image_id from ann where image_id is not null group by 1 order by count(*) desc, image_id limit 1)"
_FILES = """
with d as (select coalesce(source, 'none') as name, doc_id, doc_id || case doc_id % 10 when 1 then '.JPEG' else '.png' end as f from documents where doc_id % 10 <> 0),
k as (select name, row_number() over (order by name) - 1 as label from (select distinct coalesce(source, 'none') as name from documents)),
i as (select name, label, row_number() over (order by label, f) - 1 as image_id from d join k using (name))"""
_TREE = _FILES + ",\nc as (select label as category_id, any_value(name) as name, count(*) as n, min(image_id) as first_ord from i group by 1)"


def _usable(table_name: str, ident: str, keep: str, where: str = "true") -> str:
    return f"""
e as (select {ident} as id, any_value([cast(x as double) for x in embedding]) as v{keep} from {table_name}
      where {where} and {ident} is not null and len(embedding) = {DIM} and list_bool_and([x is not null and isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding]) group by 1),
u as (select * exclude (v), list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from e)"""


_SAMPLES = "with" + _usable("sample_vectors", "sample_id", ", any_value(cast(label as integer)) as label") + """,
s as (select a.id, a.label, b.id as neighbour_id, b.label as neighbour_label, round(list_inner_product(a.v, b.v), 12) as similarity from u a join u b on a.id <> b.id),
n as (select *, row_number() over (partition by id order by similarity desc, neighbour_id) as rank from s qualify rank <= 5)"""
_SCORED = _SAMPLES + """,
kq as (select id, label, avg(coalesce(cast(label = neighbour_label as integer), 0)) as knn_score from n where label is not null group by 1, 2),
pm as (select label, pos, avg(x) as m from (select label, unnest(range(1, 65)) as pos, unnest(v) as x from u where label is not null) group by 1, 2),
pr as (select label, list(m / l order by pos) as proto from (select *, sqrt(sum(m * m) over (partition by label)) as l from pm) group by 1),
pd as (select id, label, 1 - list_inner_product(v, proto) as distance from u join pr using (label)),
cs as (select id, kq.label, 0.6 * knn_score + 0.4 * (1 - distance / (select greatest(max(distance), 1e-9) from pd)) as score from kq join pd using (id)),
vt as (select id, neighbour_label, count(*) as c from n where neighbour_label is not null group by 1, 2),
sg as (select id, neighbour_label as suggested_label from vt qualify row_number() over (partition by id order by c desc, neighbour_label) = 1)"""
_POOL_U = _usable("pool_vectors", "pool_id", ", any_value(coalesce(is_labeled, false)) as l")
_POOL_D = "select a.id, a.v, min(1 - least(greatest(list_inner_product(a.v, b.v), -1), 1)) as d from u a, u b where not a.l and b.l group by 1, 2"
_ONE = "'[' || {0} || ', ' || {1} || ', ' || {2} || ', ' || {3} || ']'"


def _tenth(x: str) -> str:
    return f"case when isnan({x}) then 'NaN' when isinf({x}) then case when {x} > 0 then 'Infinity' else '-Infinity' end else cast(cast(cast({x} as decimal(30, 12)) as decimal(30, 1)) as varchar) end"


_PROB_U = au._PROBS.format(a=1, b=10)

ORACLES = {
    "coco_scan": _W + """
select 'images' as part, count(*) as n, cast(sum(image_id) as bigint) as id_sum, count(width) as known from img
union all select 'categories', count(*), cast(sum(category_id) as bigint), count(name) from cat
union all select 'annotations', count(*), cast(sum(ann_id) as bigint), count(bbox) from ann""",
    "folder_tree": _TREE + " select any_value(name) as class_name, label, count(*) as n, min(image_id) as first_id, max(image_id) as last_id from i group by label",
    "folder_imbalance": _TREE + "," + au._IMBALANCE + " select m.*, (select count(*) from c) as classes, (select count(*) from c where n <= (select quantile_cont(n, 0.1) from c)) as tail from m",
    "folder_audit": _TREE + " select name, n, cast(sum(n) over () as bigint) as num_images from c",
    "category_names": _W + " select name from cat",
    "image_boxes": _W + f" select bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h from ann where len(bbox) = 4 and image_id = {_HOT}",
    "image_labels": _W + f" select category_id, count(*) as n, cast(sum(count(*)) over () as bigint) as of_image from ann where image_id = {_HOT} group by 1",
    "category_images": _W + " select distinct image_id from ann where category_id = (select category_id from ann where category_id is not null group by 1 order by count(*) desc, category_id limit 1)",
    "subset_counts": _W + " select (select count(*) from img where width > height) as num_images, (select count(*) from cat) as num_categories, (select count(*) from ann where image_id in (select image_id from img where width > height)) as num_annotations",
    "check_tiny_wide": au._issue_sql("tiny_box").replace("< 4.0", "< 100"),
    "label_validation": "select 10::integer as classes",
    "unc_ranked": au._P + " select id, round(1 - top, 6) as score, best as predicted_label, round(top, 6) as max_prob from e",
    "diversity_query": au.ORACLES["coreset"],
    "cluster_margin_promises": "select true as within_budget, true as distinct_rows, true as one_a_cluster",
    "localization_query": "select id, score as priority_score from (select vec_id as id, sqrt(list_sum(list_transform(embedding[17:32], lambda x: x::double * x::double))) as s, round(s, 6) as score from embeddings) order by s desc, id desc limit 50",
    "first_pool": "select vec_id as id from embeddings order by md5(vec_id || '-42'), vec_id limit 100",
    "loop_rounds": au._P + """,
f as (select vec_id as id from embeddings order by md5(vec_id || '-42'), vec_id limit 40),
o as (select id, row_number() over (order by h desc, id desc) - 1 as place from e where id not in (select id from f))
select cast(place // 40 as integer) as round, count(*) as queried, 40 * (place // 40 + 2) as labeled, (select count(*) from e) - 40 * (place // 40 + 2) as unlabeled, cast(sum(id) as bigint) as id_sum
from o where place < 120 group by place // 40""",
    "sample_neighbours": _SAMPLES + " select id, neighbour_id, cast(rank as integer) as rank, round(similarity, 6) as similarity from n",
    "sample_scores": _SCORED + " select id, label, round(score, 6) as score from cs",
    "sample_mislabels": _SCORED + " select cs.id, cs.label as given_label, suggested_label, round(score, 6) as score from cs left join sg using (id) order by cs.score, cs.id limit 100",
    "pool_distances": "with" + _POOL_U + f" select id, round(d, 6) as distance from ({_POOL_D})",
    "pool_coreset": au._picks("", _POOL_D, 5).replace("with" + au._UNIT, "with" + _POOL_U),
    "mislabel_from_probs": "with" + _PROB_U + """,
u as (select id, label, list_transform(p, lambda x: x / sqrt(list_inner_product(p, p))) as v from e),
n as (select a.id, a.label, b.label as neighbour_label from u a join u b on a.id <> b.id qualify row_number() over (partition by a.id order by round(list_inner_product(a.v, b.v), 12) desc, b.id) <= 10)
select id, label, round(avg(cast(label = neighbour_label as integer)), 6) as score from n group by 1, 2""",
}

ORACLES["dataset_summary"] = _W + """,
c as (select category_id, any_value(name) as name, count(*) as n, min(ann_id) as first_ord from ann join cat using (category_id) group by 1),""" + au._IMBALANCE + f""",
pi as (select avg(n) as mean, stddev_pop(n) as std, max(n) as max, min(n) as min from (select img.image_id, count(ann_id) as n from img left join ann using (image_id) group by 1)),
t as (select avg(coalesce(nullif(width, 0), 1)::double * coalesce(nullif(height, 0), 1)) as mean_area from img),
b as (select bbox[3] as w, bbox[4] as h from ann where {au._FINITE} and image_id in (select image_id from img)),
l as (select 'area' as measure, w * h as value from b union all select 'width', w from b union all select 'height', h from b
      union all select 'aspect_ratio', case when h > 0 then w / h else 0 end from b union all select 'relative_area', w * h / mean_area from b, t),
f as (select 'num_images' as name, (select count(*) from img)::double as value union all select 'num_categories', (select count(*) from cat) union all select 'num_annotations', (select count(*) from ann)
      union all select 'per_image_mean', mean from pi union all select 'per_image_std', std from pi union all select 'per_image_max', max from pi union all select 'per_image_min', min from pi
      union all select 'gini', gini from m union all select 'entropy_bits', entropy_bits from m union all select 'max_entropy_bits', max_entropy_bits from m
      union all select 'imbalance_ratio', imbalance_ratio from m union all select 'effective_classes', effective_classes from m
      union all select measure || '_median', quantile_cont(value, 0.5) from l group by measure union all select 'classes', (select count(*) from c))
select name, round(value, 6) as value from f"""

_BOX = _ONE.format(*[_tenth(f"bbox[{i}]") for i in range(1, 5)])
ORACLES["check_details"] = _W + f""",
k as (select a.*, width, height, c.category_id is not null as declared from ann a join img using (image_id) left join cat c on c.category_id = a.category_id)
select image_id, ann_id, 'out_of_bounds' as issue_type, {_BOX} || ' exceeds ' || width || 'x' || height as details from k
where len(bbox) = 4 and width is not null and height is not null and (bbox[1] < 0 or bbox[2] < 0 or bbox[1] + bbox[3] > width + 1 or bbox[2] + bbox[4] > height + 1)
union all select image_id, ann_id, 'missing_bbox', 'no box' from k where bbox is null
union all select image_id, ann_id, 'malformed_bbox', len(bbox) || ' values' from k where bbox is not null and len(bbox) <> 4
union all select image_id, ann_id, 'degenerate_bbox', 'width ' || {_tenth("bbox[3]")} || ', height ' || {_tenth("bbox[4]")} from k where len(bbox) = 4 and (bbox[3] <= 0 or bbox[4] <= 0)
union all select image_id, ann_id, 'unknown_category', 'category ' || coalesce(category_id::varchar, 'null') from k where not declared"""

_AUDIT = "(" + au.ORACLES["issue_summary"] + ")"
ORACLES["audit_report"] = f"""
select 'annotation_checks' as section, coalesce(issue_type, 'total') as name, n::double as value from {_AUDIT} where issue_type is not null or severity is null
union all select 'label_quality', name, value from (select * from (select n_samples::double as n_samples, mean_score, flagged_count::double as flagged_count from ({au.ORACLES["lq_summary"]})) unpivot (value for name in (n_samples, mean_score, flagged_count)))
union all select 'mislabel_detection', name, value from (select * from (select n_samples::double as n_samples, mean_score, flagged_count::double as flagged_count from ({au.ORACLES["mislabel_summary"]})) unpivot (value for name in (n_samples, mean_score, flagged_count)))"""

ORACLES["dataset_repr"] = _W + " select 'Dataset(images=' || (select count(*) from img) || ', categories=' || (select count(*) from cat) || ', annotations=' || (select count(*) from ann) || ')' as text"
ORACLES["command_line"] = f"""
with s as (select n from ({au.ORACLES["issue_summary"]}) where issue_type is null and severity is null), d as (select * from ({au.ORACLES["dataset_counts"]}))
select 'failed' as name, 0::bigint as value union all select 'stats_images', num_images from d union all select 'stats_annotations', num_annotations from d
union all select 'check_issues', n from s union all select 'report_issues', n from s union all select 'report_sections', 2 union all select 'page_sections', 2
union all select 'folder_images', count(*) from documents where doc_id % 10 <> 0"""
_LOGITS = "with v as (select vec_id as id, [cast(x as double) for x in embedding] as v from embeddings)"
ORACLES["backend_outputs"] = _LOGITS + """
select id, round(exp(v[1]) / (exp(v[1]) + exp(v[2]) + exp(v[3])), 6) as probs_0, round(exp(v[2]) / (exp(v[1]) + exp(v[2]) + exp(v[3])), 6) as probs_1, round(exp(v[3]) / (exp(v[1]) + exp(v[2]) + exp(v[3])), 6) as probs_2,
       round(v[4], 6) as embedding_0, round(v[5], 6) as embedding_1, round(2 * v[1], 6) as grad_0, round(2 * v[2], 6) as grad_1, round(2 * v[3], 6) as grad_2, round(2 * v[4], 6) as grad_3, (select count(*) from v) as epoch_rows from v"""
ORACLES["backend_passes"] = _LOGITS + """
select cast(t.range as integer) as pass, id, round(exp(v[1] * (1 + t.range)) / (exp(v[1] * (1 + t.range)) + exp(v[2] * (1 + t.range)) + exp(v[3] * (1 + t.range))), 6) as p from v, range(2) t"""
ORACLES["loop_of_gradients"] = _LOGITS + """,
f as (select id from v order by md5(id || '-42'), id limit 30),
o as (select id, row_number() over (order by sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) desc, id desc) - 1 as place from v where id not in (select id from f))
select id, cast(place // 30 as integer) as round from o where place < 60"""
