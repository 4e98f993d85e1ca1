"""Queries of the general problems: hot keys (p1) and orphan references (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import hot_keys as hk
from gaugeworks.operators import references as rf
from gaugeworks.sources.tables import table

KEY_FIELDS = ("category_id", "image_id")
HOT_SHARE = 0.025
FRACTIONS = (0.1, 0.5, 0.9)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "annotations").groupBy(*KEY_FIELDS).agg(F.count(F.lit(1)).alias("n"))
    return hk.hot_keys(pairs, KEY_FIELDS, HOT_SHARE).select("key_field", "key_value")


def p1_category_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct images and the most annotated image of every category."""
    return hk.key_profile(hk.compress_values(table(spark, folder, "annotations"), ["category_id"], "image_id"), ["category_id"], "image_id")


def p1_image_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct categories and the most frequent category of every image."""
    return hk.key_profile(hk.compress_values(table(spark, folder, "annotations"), ["image_id"], "category_id"), ["image_id"], "category_id")


def p1_category_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of the image ids under each category, rows counted as often as they are stored."""
    compressed = hk.compress_values(table(spark, folder, "annotations"), ["category_id"], "image_id")
    return hk.weighted_percentiles(compressed, ["category_id"], "image_id", FRACTIONS, interpolate=False).select("category_id", "fraction", "n_rows", "percentile")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs, parents = rf.annotation_references(*[table(spark, folder, t) for t in ("annotations", "images", "categories")])
    return rf.orphan_references(refs, parents)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("ref_id").alias("annotation_id"), "ref_field", "ref_state")


def p7_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return rf.orphans_by_period(_orphans(spark, folder)).withColumn("period", F.date_format("period", "yyyy-MM"))


QUERIES = {
    "p1_found": p1_found,
    "p1_category_profile": p1_category_profile,
    "p1_image_profile": p1_image_profile,
    "p1_category_percentiles": p1_category_percentiles,
    "p7_found": p7_found,
    "p7_orphans_by_month": p7_orphans_by_month,
}

_PROFILE = """
with c as (select {key}, {value}, count(*) as n from annotations where {key} is not null group by 1, 2),
r as (select *, row_number() over (partition by {key} order by ({value} is null), n desc, {value}) as rn from c)
select {key}, cast(sum(n) as bigint) as n_rows, cast(coalesce(sum(n) filter ({value} is null), 0) as bigint) as n_null,
       count({value}) as n_distinct, max({value}) filter (rn = 1) as mode, max(n) filter (rn = 1 and {value} is not null) as mode_rows
from r group by 1
"""

_ORPHANS = """
with a as (select id, any_value(image_id) as image_id, any_value(category_id) as category_id, any_value(created_at) as created_at
           from annotations where id is not null group by id),
r as (select id, 'image_id' as ref_field, image_id as key, created_at from a where image_id is not null
      union all select id, 'category_id', category_id, created_at from a where category_id is not null),
p as (select distinct 'image_id' as ref_field, id as key, added_at, deleted_at from images
      union all select distinct 'category_id', id, added_at, deleted_at from categories),
j as (select r.id, r.ref_field, r.key, r.created_at, count(p.key) as n,
             count(*) filter (p.added_at <= r.created_at) as begun,
             count(*) filter (p.added_at <= r.created_at and (p.deleted_at is null or p.deleted_at > r.created_at)) as live
      from r left join p on r.ref_field = p.ref_field and r.key = p.key group by all),
o as (select id as annotation_id, ref_field, key, created_at,
             case when n = 0 then 'missing' when begun > 0 then 'deleted' else 'late' end as ref_state from j where live = 0)
"""

ORACLES = {
    "p1_found": """
with l as (select 'category_id' as key_field, category_id as key_value from annotations
           union all select 'image_id', image_id from annotations)
select key_field, key_value from l where key_value is not null group by 1, 2
having count(*) >= 0.025 * (select count(*) from annotations)
""",
    "p1_category_profile": _PROFILE.format(key="category_id", value="image_id"),
    "p1_image_profile": _PROFILE.format(key="image_id", value="category_id"),
    "p1_category_percentiles": "\nunion all\n".join(
        f"""select category_id, cast({q} as double) as fraction, count(image_id) as n_rows, quantile_disc(image_id, {q}) as percentile
from annotations where category_id is not null and image_id is not null group by 1"""
        for q in FRACTIONS
    ),
    "p7_found": _ORPHANS + "select annotation_id, ref_field, ref_state from o",
    "p7_orphans_by_month": _ORPHANS + """
select ref_field, ref_state, strftime(created_at, '%Y-%m') as period, count(*) as n_refs, count(distinct key) as n_keys from o group by 1, 2, 3
""",
}
