"""Queries of the dataset audit: statistics, checks, label quality, mislabels, active learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import checks as ck
from gaugeworks.operators import diversity as dv
from gaugeworks.operators import label_quality as lq
from gaugeworks.operators import localization as lz
from gaugeworks.operators import mislabel as ml
from gaugeworks.operators import stats as st
from gaugeworks.operators import uncertainty as un
from gaugeworks.operators.neighbors import exact_neighbours
from gaugeworks.plans.loop import move_pool
from gaugeworks.sources.coco import Dataset, from_tables, split_marks
from gaugeworks.sources.folders import labelled_files
from gaugeworks.sources.tables import table

CLASSES = 10
MIN_IOU = 0.85


def dataset(spark: SparkSession, folder: str) -> Dataset:
    return from_tables(*[table(spark, folder, t) for t in ("images", "categories", "annotations")])


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _counts(spark, folder):
    return st.class_counts(dataset(spark, folder))


def class_counts(spark, folder):
    return _counts(spark, folder).select("category_id", "name", "n")


def class_distribution(spark, folder):
    return _rounded(st.class_distribution(_counts(spark, folder)))


def tail_categories(spark, folder):
    return _rounded(st.tail_categories(_counts(spark, folder), 30.0))


def class_imbalance(spark, folder):
    return st.class_imbalance(_counts(spark, folder))


def annotations_per_image(spark, folder):
    return _rounded(st.annotations_per_image(dataset(spark, folder)))


def bbox_statistics(spark, folder):
    return _rounded(st.bbox_statistics(dataset(spark, folder)), 4)


def image_size_statistics(spark, folder):
    return _rounded(st.image_size_statistics(dataset(spark, folder)))


def annotation_density(spark, folder):
    return st.annotation_density(dataset(spark, folder))


def co_occurrence(spark, folder):
    return st.co_occurrence(dataset(spark, folder))


def resampling_weights(spark, folder):
    return st.resampling_weights(_counts(spark, folder))


def oversampling_plan(spark, folder):
    return st.oversampling_plan(_counts(spark, folder))


def long_tail(spark, folder):
    return st.long_tail(_counts(spark, folder))


def dataset_counts(spark, folder):
    return dataset(spark, folder).counts()


def split_sizes(spark, folder):
    """Images in either part of the seeded split, with the sum of their ids."""
    marks = split_marks(dataset(spark, folder).images.select("image_id"), 0.8, 42)
    return marks.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.sum("image_id").alias("id_sum"))


def folder_scan(spark, folder):
    """Files by class in a listing: the documents as files of their languages' folders."""
    last = F.pmod("doc_id", F.lit(10))
    suffix = F.when(last == 0, ".txt").when(last == 1, ".JPEG").otherwise(".png")
    listing = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("none")).alias("class_name"), F.concat(F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return labelled_files(listing).groupBy("class_name", "label").agg(F.count(F.lit(1)).alias("n"))


def _issues(kind: str):
    def query(spark, folder):
        return ck.simple_issues(dataset(spark, folder)).where(F.col("issue_type") == kind).select("image_id", "ann_id", "severity")

    query.__doc__ = f"Annotations with the issue {kind}."
    return query


def check_near_duplicate(spark, folder):
    return _rounded(ck.near_duplicates(dataset(spark, folder), MIN_IOU).select("image_id", "ann_id", "partner_id", "iou"))


def iou_pairs(spark, folder):
    """Boxes of one image and category that overlap by half or more."""
    pairs = ck.overlapping_pairs(dataset(spark, folder).annotations, 0.5)
    return _rounded(pairs.select("image_id", "category_id", "ann_id", "partner_id", "iou"))


def issue_summary(spark, folder):
    return ck.issue_summary(ck.all_issues(dataset(spark, folder), 4.0, MIN_IOU))


def _probs(spark, folder, start: int = 1):
    u = F.transform(F.slice("embedding", start, CLASSES), lambda x: F.abs(x.cast("double")) + 0.01)
    p = F.transform("u", lambda x: x / F.aggregate("u", F.lit(0.0), lambda a, y: a + y))
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), u.alias("u")).select("id", "label", p.alias("probs"))


def _passes(spark, folder):
    parts = [_probs(spark, folder, 1 + CLASSES * t).select(F.lit(t).alias("pass"), "id", "probs") for t in range(6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "embedding")


def _quality(method: str):
    def query(spark, folder):
        return _rounded(lq.quality_scores(_probs(spark, folder), method))

    query.__doc__ = f"Quality of every label by {method}."
    return query


def lq_issue_mask(spark, folder):
    return lq.issue_mask(_probs(spark, folder), 0.1)


def lq_ranked(spark, folder):
    return _rounded(lq.ranked_issues(_probs(spark, folder), "self_confidence", 50))


def lq_thresholds(spark, folder):
    return _rounded(lq.class_thresholds(_probs(spark, folder), CLASSES))


def lq_joint(spark, folder):
    return _rounded(lq.confident_joint(_probs(spark, folder), CLASSES))


def lq_summary(spark, folder):
    return _rounded(lq.quality_summary(_probs(spark, folder), CLASSES))


def _near(spark, folder):
    return exact_neighbours(_vectors(spark, folder), 10)


def knn_neighbours(spark, folder):
    return _rounded(_near(spark, folder).select("id", "neighbour_id", "rank", "similarity"))


def knn_quality(spark, folder):
    return _rounded(ml.knn_quality(_near(spark, folder)))


def prototype_distance(spark, folder):
    return _rounded(ml.prototype_distance(_vectors(spark, folder), 64))


def _combined(spark, folder, near):
    return ml.combined_score(ml.knn_quality(near), ml.prototype_distance(_vectors(spark, folder), 64))


def combined_score(spark, folder):
    return _rounded(_combined(spark, folder, _near(spark, folder)))


def mislabel_candidates(spark, folder):
    near = _near(spark, folder)
    found = ml.rank_candidates(_combined(spark, folder, near), near, 100)
    return _rounded(found.select("id", "given_label", "suggested_label", "score", "mislabel_score"))


def mislabel_summary(spark, folder):
    return _rounded(ml.mislabel_summary(_combined(spark, folder, _near(spark, folder))))


def _uncertainty(method: str):
    def query(spark, folder):
        return _rounded(un.scores(_probs(spark, folder), method))

    query.__doc__ = f"Uncertainty of every row by {method}."
    return query


def unc_bald(spark, folder):
    return _rounded(un.bald(_passes(spark, folder)))


def unc_topk(spark, folder):
    return _rounded(un.query(_probs(spark, folder), 50, "margin"))


def _pools(spark, folder):
    rows = _vectors(spark, folder).drop("label")
    return rows.where(F.col("id") % 10 != 0), rows.where(F.col("id") % 10 == 0)


def coreset(spark, folder):
    """Five k-center picks from the unlabelled pool, given the labelled one."""
    unlabeled, labeled = _pools(spark, folder)
    return dv.coreset(unlabeled, 5, labeled)


def minmax(spark, folder):
    return dv.minmax(_vectors(spark, folder), 5, 42)


def cluster_margin(spark, folder):
    return dv.cluster_margin(_vectors(spark, folder), _probs(spark, folder), 20)


def min_distance(spark, folder):
    """Distance of every unlabelled row to the nearest labelled one."""
    return _rounded(dv.min_distance(*_pools(spark, folder)))


def gradient_norm(spark, folder):
    return _rounded(lz.gradient_norm(table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.slice("embedding", 17, 16).alias("grad"))))


def spatial_entropy(spark, folder):
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    return _rounded(lz.spatial_entropy(table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), cells.alias("cells"))))


def influence(spark, folder):
    losses = table(spark, folder, "events").select(F.col("event_id").cast("long").alias("id"), F.col("value").cast("double").alias("loss"))
    return _rounded(lz.ranked(lz.influence(losses, losses)))


def pool_round(spark, folder):
    """Pool sizes after a round that moves the 50 most uncertain unlabelled rows."""
    pool = _probs(spark, folder).select("id", "probs", (F.col("id") % 10 == 0).alias("is_labeled"))
    queried = un.query(pool.where(~F.col("is_labeled")), 50, "entropy").select("id")
    moved = move_pool(pool.select("id", "is_labeled", F.lit(None).cast("int").alias("round_added")), queried, 0)
    return moved.groupBy("is_labeled").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


QUERIES = {
    "class_counts": class_counts,
    "class_distribution": class_distribution,
    "tail_categories": tail_categories,
    "class_imbalance": class_imbalance,
    "annotations_per_image": annotations_per_image,
    "bbox_statistics": bbox_statistics,
    "image_size_statistics": image_size_statistics,
    "annotation_density": annotation_density,
    "co_occurrence": co_occurrence,
    "resampling_weights": resampling_weights,
    "oversampling_plan": oversampling_plan,
    "long_tail": long_tail,
    "dataset_counts": dataset_counts,
    "split_sizes": split_sizes,
    "folder_scan": folder_scan,
    "check_out_of_bounds": _issues("out_of_bounds"),
    "check_tiny": _issues("tiny_box"),
    "check_missing": _issues("missing_bbox"),
    "check_malformed": _issues("malformed_bbox"),
    "check_degenerate": _issues("degenerate_bbox"),
    "check_unknown_category": _issues("unknown_category"),
    "check_near_duplicate": check_near_duplicate,
    "iou_pairs": iou_pairs,
    "issue_summary": issue_summary,
    "lq_self_confidence": _quality("self_confidence"),
    "lq_normalized_margin": _quality("normalized_margin"),
    "lq_entropy_weighted": _quality("entropy_weighted"),
    "lq_issue_mask": lq_issue_mask,
    "lq_ranked": lq_ranked,
    "lq_thresholds": lq_thresholds,
    "lq_joint": lq_joint,
    "lq_summary": lq_summary,
    "knn_neighbours": knn_neighbours,
    "knn_quality": knn_quality,
    "prototype_distance": prototype_distance,
    "combined_score": combined_score,
    "mislabel_candidates": mislabel_candidates,
    "mislabel_summary": mislabel_summary,
    "unc_entropy": _uncertainty("entropy"),
    "unc_margin": _uncertainty("margin"),
    "unc_least_confidence": _uncertainty("least_confidence"),
    "unc_bald": unc_bald,
    "unc_topk": unc_topk,
    "coreset": coreset,
    "minmax": minmax,
    "min_distance": min_distance,
    "cluster_margin": cluster_margin,
    "gradient_norm": gradient_norm,
    "spatial_entropy": spatial_entropy,
    "influence": influence,
    "pool_round": pool_round,
}

# --- SQL

_DATA = """
img as (select image_id, file_name, width, height from (
          select id as image_id, file_name, width, height,
                 row_number() over (partition by id order by added_at desc nulls last, width desc nulls last, height desc nulls last, file_name desc nulls last) as rn
          from images where id is not null) where rn = 1),
cat as (select category_id, name from (
          select id as category_id, name, row_number() over (partition by id order by added_at desc nulls last, name desc nulls last, supercategory desc nulls last) as rn
          from categories where id is not null) where rn = 1),
ann as (select id as ann_id, any_value(image_id) as image_id, any_value(category_id) as category_id, any_value(bbox) as bbox
        from annotations where id is not null group by id)"""

_COUNTS = "with" + _DATA + """,
c as (select category_id, any_value(name) as name, count(*) as n, min(ann_id) as first_ord from ann join cat using (category_id) group by 1)
"""

_IMBALANCE = """
r as (select n, row_number() over (order by n, category_id) as i, n / sum(n) over () as p from c),
m as (select round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) as gini, round(-sum(p * ln(p)) / ln(2), 6) as entropy_bits,
             round(case when count(*) > 1 then log2(count(*)) else 0 end, 6) as max_entropy_bits,
             round(max(n) / greatest(min(n), 1), 4) as imbalance_ratio, round(exp(-sum(p * ln(p))), 4) as effective_classes from r)"""

_FINITE = "len(bbox) = 4 and coalesce(list_bool_and([isfinite(bbox[1]), isfinite(bbox[2]), isfinite(bbox[3]), isfinite(bbox[4])]), false)"


def _issue_sql(kind: str) -> str:
    known = "select a.*, width, height, c.category_id is not null as declared from ann a join img using (image_id) left join cat c on c.category_id = a.category_id"
    predicate = {
        "out_of_bounds": "len(bbox) = 4 and width is not null and height is not null and (bbox[1] < 0 or bbox[2] < 0 or bbox[1] + bbox[3] > width + 1 or bbox[2] + bbox[4] > height + 1)",
        "tiny_box": "len(bbox) = 4 and bbox[3] * bbox[4] > 0 and bbox[3] * bbox[4] < 4.0",
        "missing_bbox": "bbox is null",
        "malformed_bbox": "bbox is not null and len(bbox) <> 4",
        "degenerate_bbox": "len(bbox) = 4 and (bbox[3] <= 0 or bbox[4] <= 0)",
        "unknown_category": "not declared",
    }[kind]
    severity = "warning" if kind == "tiny_box" else "error"
    return f"with{_DATA}, k as ({known}) select image_id, ann_id, '{severity}' as severity from k where {predicate}"


_PROBS = """
q as (select vec_id as id, label, list_transform(u, lambda x: x / list_reduce(u, lambda a, b: a + b)) as p
      from (select vec_id, label, list_transform(embedding[{a}:{b}], lambda x: abs(x::double) + 0.01::double) as u from embeddings)),
e as (select *, -list_sum(list_transform(p, lambda x: case when x > 0 then x * ln(x) else 0 end)) as h, p[label + 1] as own, list_max(p) as top,
             cast(list_position(p, list_max(p)) - 1 as integer) as best, list_sort(p, 'DESC') as s from q)"""
_P = "with" + _PROBS.format(a=1, b=10)

_UNIT = """
u as (select vec_id as id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v
      from (select vec_id, label, [cast(x as double) for x in embedding] as v from embeddings))"""

_KNN = "with" + _UNIT + """,
s as (select a.id, a.label, b.id as neighbour_id, b.label as neighbour_label, round(list_inner_product(a.v, b.v), 12) as similarity from u a join u b on a.id <> b.id),
n as (select *, row_number() over (partition by id order by similarity desc, neighbour_id) as rank from s qualify rank <= 10),
kq as (select id, label, avg(cast(label = neighbour_label as integer)) as knn_score from n group by 1, 2),
pm as (select label, pos, avg(x) as m from (select label, unnest(range(1, 65)) as pos, unnest(v) as x from u) group by 1, 2),
pr as (select label, list(m / l order by pos) as proto from (select *, sqrt(sum(m * m) over (partition by label)) as l from pm) group by 1),
pd as (select id, label, 1 - list_inner_product(v, proto) as distance from u join pr using (label)),
cs as (select id, kq.label, 0.6 * knn_score + 0.4 * (1 - distance / (select greatest(max(distance), 1e-9) from pd)) as score from kq join pd using (id)),
vt as (select id, neighbour_label, count(*) as c from n group by 1, 2),
sg as (select id, neighbour_label as suggested_label from vt qualify row_number() over (partition by id order by c desc, neighbour_label) = 1)
"""


def _picks(first: str, setup: str, picks: int) -> str:
    """Farthest-first in SQL: one list of picks and one of distances for each step."""
    steps = [f"d0 as materialized ({setup})"]
    if first:
        steps.append(f"k1 as materialized (select u.id, u.v, 1 as pick from u where id = ({first}))")
    else:
        steps.append("k1 as materialized (select id, v, 1 as pick from d0 order by d desc, id limit 1)")
    for i in range(1, picks):
        steps.append(f"d{i} as materialized (select x.id, x.v, least(d, 1 - least(greatest(list_inner_product(x.v, k.v), -1), 1)) as d from d{i - 1} x, k{i} k where x.id <> k.id)")
        steps.append(f"k{i + 1} as materialized (select id, v, {i + 1} as pick from d{i} order by d desc, id limit 1)")
    return "with" + _UNIT + ",\n" + ",\n".join(steps) + "\n" + " union all ".join(f"select id, pick from k{i}" for i in range(1, picks + 1))


_WEIGHTED = "quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as p75, quantile_cont(value, 0.95) as p95"

ORACLES = {
    "class_counts": _COUNTS + "select category_id, name, n from c",
    "class_distribution": _COUNTS + "select name, n, round(n / sum(n) over (), 6) as fraction from c",
    "tail_categories": _COUNTS + "select name, n, round(n / t, 6) as fraction from c, (select sum(n) as t, quantile_cont(n, 0.3) as q from c) where n <= q",
    "class_imbalance": _COUNTS + "," + _IMBALANCE + " select * from m",
    "annotations_per_image": "with" + _DATA + """
select round(avg(n), 6) as mean, round(stddev_pop(n), 6) as std, max(n) as max, min(n) as min
from (select img.image_id, count(ann_id) as n from img left join ann using (image_id) group by 1)""",
    "bbox_statistics": "with" + _DATA + f""",
t as (select avg(coalesce(nullif(width, 0), 1)::double * coalesce(nullif(height, 0), 1)) as mean_area from img),
b as (select bbox[3] as w, bbox[4] as h from ann where {_FINITE} and image_id in (select image_id from img)),
l as (select 'area' as measure, w * h as value from b union all select 'width', w from b union all select 'height', h from b
      union all select 'aspect_ratio', case when h > 0 then w / h else 0 end from b union all select 'relative_area', w * h / mean_area from b, t)
select measure, n, round(min, 4) as min, round(p25, 4) as p25, round(median, 4) as median, round(mean, 4) as mean, round(p75, 4) as p75, round(p95, 4) as p95, round(max, 4) as max
from (select measure, count(*) as n, min(value) as min, avg(value) as mean, max(value) as max, {_WEIGHTED} from l group by 1)""",
    "image_size_statistics": "with" + _DATA + """,
s as (select width::double as w, height::double as h from img where width is not null and height is not null),
l as (select 'width' as measure, w as value from s union all select 'height', h from s union all select 'aspect_ratio', w / greatest(h, 1) from s)
select measure, count(*) as n, round(min(value), 6) as min, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(max(value), 6) as max,
       (select count(*) from (select distinct w, h from s)) as unique_sizes from l group by 1""",
    "annotation_density": "with" + _DATA + """,
i as (select image_id, count(*) as n from ann where image_id is not null group by 1),
d as (select a.category_id, avg(i.n) as density from (select distinct image_id, category_id from ann) a join i using (image_id) group by 1)
select category_id, name, round(coalesce(density, 0), 4) as density from cat left join d using (category_id)""",
    "co_occurrence": "with" + _DATA + """,
p as (select distinct image_id, category_id from ann where category_id in (select category_id from cat) and image_id in (select image_id from img)),
g as (select a.category_id as category_i, b.category_id as category_j, count(*) as n from p a join p b using (image_id) group by 1, 2)
select * from g union all select category_id, category_id, 0 from cat where category_id not in (select category_id from p)""",
    "resampling_weights": _COUNTS + "select category_id, name, round(1 / ((count(*) over ()) * greatest(n / sum(n) over (), 1e-9)), 6) as weight from c",
    "oversampling_plan": _COUNTS + "select category_id, name, n, greatest(max(n) over () - n, 0) as extra from c",
    "long_tail": _COUNTS + "," + _IMBALANCE + """,
t as (select count(*) as classes, count(*) filter (n <= (select quantile_cont(n, 0.1) from c)) as tail_count from c)
select m.*, classes, tail_count, classes - tail_count as head_count from m, t""",
    "dataset_counts": "with" + _DATA + " select (select count(*) from img) as num_images, (select count(*) from cat) as num_categories, (select count(*) from ann) as num_annotations",
    "split_sizes": "with" + _DATA + """,
r as (select image_id, row_number() over (order by md5(image_id || '-42'), image_id) as rn, count(*) over () as t from img)
select rn <= floor(t * 0.8) as is_train, count(*) as n, cast(sum(image_id) as bigint) as id_sum from r group by 1""",
    "folder_scan": """
with l as (select coalesce(lang, 'none') as class_name, doc_id from documents),
k as (select class_name, cast(row_number() over (order by class_name) - 1 as integer) as label from (select distinct class_name from l))
select class_name, label, count(*) as n from l join k using (class_name) where doc_id % 10 <> 0 group by 1, 2""",
    "check_out_of_bounds": _issue_sql("out_of_bounds"),
    "check_tiny": _issue_sql("tiny_box"),
    "check_missing": _issue_sql("missing_bbox"),
    "check_malformed": _issue_sql("malformed_bbox"),
    "check_degenerate": _issue_sql("degenerate_bbox"),
    "check_unknown_category": _issue_sql("unknown_category"),
    "lq_self_confidence": _P + " select id, label, round(own, 6) as score from e",
    "lq_normalized_margin": _P + " select id, label, round((own - top + 1) / 2, 6) as score from e",
    "lq_entropy_weighted": _P + " select id, label, round(own * (1 - h / ln(10 + 1e-9)), 6) as score from e",
    "lq_issue_mask": _P + " select id, own < 0.1 as is_issue from e",
    "lq_ranked": _P + " select id, label as given_label, best as predicted_label, round(own, 6) as score, round(top, 6) as confidence from e order by own, id limit 50",
    "unc_entropy": _P + " select id, round(h, 6) as score, best as predicted_label, round(top, 6) as max_prob from e",
    "unc_margin": _P + " select id, round(1 - (s[1] - s[2]), 6) as score, best as predicted_label, round(top, 6) as max_prob from e",
    "unc_least_confidence": _P + " select id, round(1 - top, 6) as score, best as predicted_label, round(top, 6) as max_prob from e",
    "unc_topk": _P + " select id, round(1 - (s[1] - s[2]), 6) as score, best as predicted_label, round(top, 6) as max_prob from e order by 1 - (s[1] - s[2]) desc, id desc limit 50",
    "knn_neighbours": _KNN + "select id, neighbour_id, cast(rank as integer) as rank, round(similarity, 6) as similarity from n",
    "knn_quality": _KNN + "select id, label, round(knn_score, 6) as knn_score from kq",
    "prototype_distance": _KNN + "select id, label, round(distance, 6) as distance from pd",
    "combined_score": _KNN + "select id, label, round(score, 6) as score from cs",
    "mislabel_candidates": _KNN + "select cs.id, cs.label as given_label, suggested_label, round(score, 6) as score, round(1 - score, 6) as mislabel_score from cs join sg using (id) order by cs.score, cs.id limit 100",
    "mislabel_summary": _KNN + "select count(*) as n_samples, round(avg(score), 6) as mean_score, count(*) filter (score < 0.5) as flagged_count from cs",
    "coreset": _picks("", "select a.id, a.v, min(1 - least(greatest(list_inner_product(a.v, b.v), -1), 1)) as d from u a, u b where a.id % 10 <> 0 and b.id % 10 = 0 group by 1, 2", 5),
    "minmax": _picks("select id from u order by md5(id || '-42'), id limit 1", "select id, v, 'inf'::double as d from u", 5),
    "min_distance": "with" + _UNIT + " select a.id, round(min(1 - least(greatest(list_inner_product(a.v, b.v), -1), 1)), 6) as distance from u a, u b where a.id % 10 <> 0 and b.id % 10 = 0 group by 1",
    "gradient_norm": "select vec_id as id, round(sqrt(list_sum(list_transform(embedding[17:32], lambda x: x::double * x::double))), 6) as score from embeddings",
    "influence": "select event_id as id, round((value - lo) / (hi - lo + 1e-9), 6) as priority_score from events, (select min(value) as lo, max(value) as hi from events)",
}

ORACLES["lq_thresholds"] = _P + """,
t as (select label, avg(own) as threshold from e group by 1)
select cast(k.range as integer) as label, round(coalesce(threshold, 0.5), 6) as threshold from range(10) k left join t on t.label = k.range"""

_JOINT = _P + """,
t as (select k.range as likely, coalesce(threshold, 0.5) as threshold from range(10) k left join (select label, avg(own) as threshold from e group by 1) x on x.label = k.range),
j as (select e.label as given, t.likely, count(*) as n from e, t where e.p[t.likely + 1] >= t.threshold group by 1, 2),
g as (select cast(a.range as integer) as given, cast(b.range as integer) as likely, coalesce(n, 0) as n from range(10) a, range(10) b left join j on j.given = a.range and j.likely = b.range),
w as (select given, likely, n, n / greatest(sum(n) over (), 1) as share from g)
"""
ORACLES["lq_joint"] = _JOINT + "select given, likely, n, round(share, 6) as share from w"
ORACLES["lq_summary"] = _JOINT + """
select count(*) as n_samples, round(avg(own), 6) as mean_score, count(*) filter (own < 0.5) as flagged_count,
       (select round(1 - sum(case when given = likely then share else 0 end), 6) from w) as estimated_error_rate, round(count(*) filter (own < 0.5) / count(*), 6) as flagged_fraction from e"""

_NEAR = """
b as (select image_id, category_id, ann_id, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h from ann where """ + _FINITE + """ and bbox[3] > 0 and bbox[4] > 0),
p as (select a.image_id, a.category_id, a.ann_id, c.ann_id as partner_id, a.w * a.h + c.w * c.h as s,
             greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0) as i
      from b a join b c on a.image_id = c.image_id and a.category_id = c.category_id and a.ann_id < c.ann_id
        and c.x between a.x - a.w and a.x + a.w),
o as (select image_id, category_id, ann_id, partner_id, i / (s - i) as iou from p)
"""
ORACLES["iou_pairs"] = "with" + _DATA + "," + _NEAR + "select image_id, category_id, ann_id, partner_id, round(iou, 6) as iou from o where iou >= 0.5"
ORACLES["check_near_duplicate"] = "with" + _DATA + "," + _NEAR + "select image_id, ann_id, partner_id, round(iou, 6) as iou from o where iou >= 0.85 and image_id in (select image_id from img)"
ORACLES["issue_summary"] = "with x as (" + " union all ".join(f"select '{k}' as issue_type, severity from ({_issue_sql(k)})" for k in ("out_of_bounds", "tiny_box", "missing_bbox", "malformed_bbox", "degenerate_bbox", "unknown_category")) + " union all select 'near_duplicate', 'warning' from (" + ORACLES["check_near_duplicate"] + ")) select issue_type, severity, count(*) as n from x group by grouping sets ((issue_type), (severity), ())"

ORACLES["unc_bald"] = """
with u as (select vec_id as id, t.range as t, list_transform(embedding[1 + 10 * t.range : 10 + 10 * t.range], lambda x: abs(x::double) + 0.01::double) as u from embeddings, range(6) t),
q as (select id, t, list_transform(u, lambda x: x / list_reduce(u, lambda a, b: a + b)) as p from u),
h as (select id, avg(-list_sum(list_transform(p, lambda x: x * ln(x)))) as h from q group by 1),
m as (select id, k, avg(x) as x from (select id, unnest(range(10)) as k, unnest(p) as x from q) group by 1, 2)
select id, round(greatest(-sum(x * ln(x)) - any_value(h), 0), 6) as score from m join h using (id) group by 1"""
ORACLES["spatial_entropy"] = """
with c as (select vec_id as id, k.range as k, [cast(x as double) for x in embedding[k.range * 4 + 1 : k.range * 4 + 4]] as z from embeddings, range(16) k),
e as (select id, list_transform(z, lambda x: exp(x - list_max(z))) as e from c),
p as (select id, list_transform(e, lambda x: x / list_sum(e)) as p from e)
select id, round(avg(-list_sum(list_transform(p, lambda x: x * log2(x)))), 6) as score from p group by 1"""
ORACLES["pool_round"] = _P + """,
q as (select id from e where id % 10 <> 0 order by h desc, id desc limit 50)
select id % 10 = 0 or id in (select id from q) as is_labeled, count(*) as n, cast(sum(id) as bigint) as id_sum from e group by 1""".replace("q as (select id from e", "z as (select id from e").replace("in (select id from q)", "in (select id from z)")
