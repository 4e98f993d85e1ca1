"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.plans import broadcast_if_small
from gaugeworks.llm import cooccurrence as co
from gaugeworks.llm import mixing as mx
from gaugeworks.llm import neighbours as nb
from gaugeworks.llm import packing as pk
from gaugeworks.llm import pages as pg
from gaugeworks.llm import quantiles as qt
from gaugeworks.llm import sampling as sp
from gaugeworks.llm import varied as vr
from gaugeworks.llm.tokens import byte_tokens
from gaugeworks.operators.hot_keys import compress_values, weighted_percentiles
from gaugeworks.session import cut_lineage
from gaugeworks.sources.tables import table

SEED = 42


def _distinct(annotations: DataFrame, *columns: str) -> DataFrame:
    """One row per annotation id; redelivered rows repeat the content."""
    return annotations.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


# --- p2: co-occurrence


def _cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    categories = table(spark, folder, "categories").select(F.col("id").alias("category_id")).distinct()
    annotations = table(spark, folder, "annotations").join(categories, "category_id", "left_semi")
    images = table(spark, folder, "images").select(F.col("id").alias("basket"))
    return co.cooccurrence(annotations, "image_id", "category_id", keep=images)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _cooccurrence(spark, folder)
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("n_ab", "n_a", "n_b", "n_baskets")}
    often = exact["n_ab"] * 1000 >= exact["n_baskets"] * 18
    beyond_chance = exact["n_ab"] * exact["n_baskets"] >= exact["n_a"] * exact["n_b"] * 3
    return pairs.where(often & beyond_chance).select(F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"))


def p2_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of categories that share an image, with lift."""
    pairs = _cooccurrence(spark, folder)
    return pairs.select(F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"), "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


_PAIRS = """
with a as (select distinct image_id, category_id from annotations
           where image_id in (select id from images) and category_id in (select id from categories)),
n as (select category_id, count(*) as n from a group by 1),
t as (select count(distinct image_id) as n_baskets from a),
p as (select x.category_id as category_a, y.category_id as category_b, count(*) as n_ab
      from a x join a y on x.image_id = y.image_id and x.category_id < y.category_id group by 1, 2),
r as (select category_a, category_b, n_ab, na.n as n_a, nb.n as n_b, n_baskets
      from p join n na on na.category_id = category_a join n nb on nb.category_id = category_b, t)
"""


# --- p3: most similar vectors


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = nb.mutual_neighbours(table(spark, folder, "sample_vectors"), "sample_id", "embedding", 5, 0.92)
    return pairs.select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar others, among all rows, of every sample whose id is divisible by 100."""
    found = nb.nearest(table(spark, folder, "sample_vectors"), "sample_id", "embedding", 5, F.col("sample_id") % 100 == 0)
    return found.select(F.col("a").alias("sample_id"), F.col("b").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p3_label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the neighbours that have the sample's own label, and the label they suggest."""
    samples = table(spark, folder, "sample_vectors")
    found = nb.nearest(samples, "sample_id", "embedding", 5, F.col("sample_id") % 100 == 0)
    labels = samples.groupBy(F.col("sample_id").alias("id")).agg(F.first("label", ignorenulls=True).alias("label"))
    return nb.label_agreement(found, labels).withColumnRenamed("id", "sample_id")


# --- p4: percentiles

EPS = 0.002
P4_FRACTIONS = (0.1, 0.5, 0.9, 0.99)


def _box_area() -> Column:
    finite = F.size("bbox") == 4
    for i in range(4):
        finite = finite & F.get("bbox", F.lit(i)).isNotNull() & (F.abs(F.get("bbox", F.lit(i))) < float("inf"))
    w, h = F.get("bbox", F.lit(2)), F.get("bbox", F.lit(3))
    return F.when(finite & (w > 0) & (h > 0), w * h)


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (category_id, day, measure, value) of distinct annotations, for box area and recorded area."""
    annotations = table(spark, folder, "annotations").withColumn("box_area", _box_area())
    one = _distinct(annotations, "category_id", "created_at", "box_area", "area")
    values = F.explode(F.create_map(F.lit("box"), F.col("box_area"), F.lit("recorded"), F.col("area"))).alias("measure", "value")
    return one.select("category_id", F.to_date("created_at").alias("day"), values).where(F.col("value").isNotNull())


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Digests bound both percentiles of each category; only categories they leave open are computed exactly."""
    categories = table(spark, folder, "categories").where(F.col("id").isNotNull()).select(F.col("id").alias("category_id")).distinct()
    annotations = table(spark, folder, "annotations").select("id", "category_id", _box_area().alias("box_area")).where(F.col("box_area").isNotNull())
    boxes = _distinct(annotations.join(categories, "category_id", "left_semi"), "category_id", "box_area")
    read = qt.percentiles(qt.digest(boxes, ["category_id"], F.col("box_area"), EPS), ["category_id"], (0.5, 0.9), EPS).where(F.col("n_values") >= 30)

    def at(column: str, q: float) -> Column:
        return F.max(F.when(F.col("fraction") == q, F.col(column)))

    bounds = read.groupBy("category_id").agg(at("lower", 0.5).alias("m_lo"), at("upper", 0.5).alias("m_hi"), at("lower", 0.9).alias("t_lo"), at("upper", 0.9).alias("t_hi"))
    bounds = bounds.where(F.col("t_hi") >= 8 * F.col("m_lo")).withColumn("sure", F.col("t_lo") >= 8 * F.col("m_hi"))
    rows = bounds.collect()  # at most one row for each declared category
    sure, unsure = [r["category_id"] for r in rows if r["sure"]], [r["category_id"] for r in rows if not r["sure"]]
    found = spark.createDataFrame([(c,) for c in sure], "category_id long")
    if not unsure:
        return found
    exact = weighted_percentiles(compress_values(boxes.where(F.col("category_id").isin(unsure)), ["category_id"], "box_area"), ["category_id"], "box_area", (0.5, 0.9))
    two = exact.groupBy("category_id").agg(F.max(F.when(F.col("fraction") == 0.5, F.col("percentile"))).alias("m"), F.max(F.when(F.col("fraction") == 0.9, F.col("percentile"))).alias("t"))
    return found.unionByName(two.where(F.col("t") >= 8 * F.col("m")).select("category_id"))


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each category, measure and day, with their rank error."""
    by = ["category_id", "measure", "day"]
    return qt.percentiles(qt.digest(_areas(spark, folder), by, F.col("value"), EPS), by, P4_FRACTIONS, EPS)


def p4_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each category and measure from the merged daily digests."""
    daily = qt.digest(_areas(spark, folder), ["category_id", "measure", "day"], F.col("value"), EPS)
    by = ["category_id", "measure"]
    return qt.percentiles(qt.merge(daily, by, EPS), by, P4_FRACTIONS, EPS)


def _promises(read: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., fraction, n_values, bounded, near): whether the exact percentile lies in [lower, upper], and the estimate within its rank error of it."""
    exact = weighted_percentiles(compress_values(values, by, "value"), by, "value", P4_FRACTIONS).select(*by, "fraction", F.col("percentile").alias("exact"))
    both = cut_lineage(read.join(exact, [*by, "fraction"]))
    # ranks of the estimate, less and more by the width of a cell
    cells = F.abs(F.col("estimate")) * 2.0 ** (1 - qt.MANTISSA_BITS)
    ranks = values.join(broadcast_if_small(both).select(*by, "fraction", (F.col("estimate") - cells).alias("_lo"), (F.col("estimate") + cells).alias("_hi")), by).groupBy(*by, "fraction").agg(F.count_if(F.col("value") < F.col("_lo")).alias("below"), F.count_if(F.col("value") <= F.col("_hi")).alias("upto"))
    at = F.col("fraction") * (F.col("n_values") - 1) + 1
    near = (F.col("below") <= at + F.col("rank_error") + 1) & (F.col("upto") >= at - F.col("rank_error") - 1)
    return both.join(ranks, [*by, "fraction"]).select(*by, "fraction", "n_values", F.col("exact").between(F.col("lower"), F.col("upper")).alias("bounded"), near.alias("near"))


def p4_daily_promises(spark: SparkSession, folder: str) -> DataFrame:
    by, values = ["category_id", "measure", "day"], _known(_areas(spark, folder), "day")
    return _promises(qt.percentiles(qt.digest(values, by, F.col("value"), EPS), by, P4_FRACTIONS, EPS), values, by)


def p4_merged_promises(spark: SparkSession, folder: str) -> DataFrame:
    by, values = ["category_id", "measure"], _known(_areas(spark, folder))
    daily = qt.digest(values, [*by, "day"], F.col("value"), EPS)
    return _promises(qt.percentiles(qt.merge(daily, by, EPS), by, P4_FRACTIONS, EPS), values, by)


def _known(values: DataFrame, *keys: str) -> DataFrame:
    """Finite values under known keys, written once."""
    known = F.abs("value") < float("inf")
    for k in ("category_id", *keys):
        known = known & F.col(k).isNotNull()
    return cut_lineage(values.where(known))


# --- p5: sample by target shares


def _sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _distinct(table(spark, folder, "annotations").select("id", "category_id"), "category_id").select("id", F.col("category_id").alias("category"))
    rows = cut_lineage(rows)  # counted for the plan, then drawn from
    targets = table(spark, folder, "category_targets").withColumnRenamed("category_id", "category")
    planned = sp.plan(rows, targets, size_share=1 / 3)
    return planned, sp.draw(rows, planned, SEED)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    planned, sample = _sample(spark, folder)
    return sp.report(planned, sample).withColumnRenamed("category", "category_id").select("category_id", "observed", F.round("required", 6).alias("required"), "sampled", F.round("deficit", 6).alias("deficit"), F.round("reached_share", 9).alias("reached_share"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    planned, sample = _sample(spark, folder)
    return sp.report(planned, sample).where(F.col("deficit") > 0).select(F.col("category").alias("category_id"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[1].select(F.col("id").alias("annotation_id"), F.col("category").alias("category_id"))


def p5_sample_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct annotations of the sample by category."""
    return p5_sample(spark, folder).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("annotation_id").alias("annotations"))


_TARGETS = """
with a as (select id, any_value(category_id) as category_id from annotations where id is not null group by id),
s as (select count(*) // 3 as s from a),
n as (select category_id, count(*) as n from a group by 1),
r as (select t.category_id, coalesce(n.n, 0) as observed, greatest(t.min_rows, t.target_share * s.s) as required
      from category_targets t left join n using (category_id), s)
"""


# --- p6: varied subset


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return vr.crowded(table(spark, folder, "pool_vectors"), "pool_id", "embedding", "is_labeled", 15, 0.9).withColumnRenamed("id", "pool_id")


def p6_subset(spark: SparkSession, folder: str) -> DataFrame:
    """100 unlabelled records that cover the pool, given the labelled rows."""
    return vr.choose(table(spark, folder, "pool_vectors"), "pool_id", "embedding", "is_labeled", 100).withColumnRenamed("id", "pool_id")


def p6_subset_report(spark: SparkSession, folder: str) -> DataFrame:
    """For subsets of 100 and of 3000 records: how many came out, how many ids they have, how many of them are labelled."""
    pool = table(spark, folder, "pool_vectors")
    labelled = pool.where("is_labeled").select(F.col("pool_id").alias("id"), F.lit(True).alias("_l")).distinct()
    out = None
    for asked in (100, 3000):
        chosen = vr.choose(pool, "pool_id", "embedding", "is_labeled", asked).join(labelled, "id", "left")
        one = chosen.agg(F.lit(asked).cast("long").alias("asked"), F.count(F.lit(1)).alias("chosen"), F.count_distinct("id").alias("ids"), F.count("_l").alias("labelled"))
        out = one if out is None else out.unionByName(one)
    return out


# --- p8: containers


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", byte_tokens().alias("tokens"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pk.pack(_sized(spark, folder), table(spark, folder, "container_sizes"), seed=SEED, n_items=table(spark, folder, "documents").count())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("container_kind", "doc_id")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p8_usage(spark: SparkSession, folder: str) -> DataFrame:
    return pk.usage(_packed(spark, folder), table(spark, folder, "container_sizes"))


def p8_promises(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind: documents, tokens, containers that hold too much, documents split without need or in parts, and whether nine tenths of the room is used."""
    packed = cut_lineage(_packed(spark, folder))
    kinds = table(spark, folder, "container_sizes").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    full = packed.groupBy("container_kind", "group_id", "container_no").agg(F.sum("tokens").alias("used")).join(F.broadcast(kinds), "container_kind")  # a few kinds
    full = full.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), (F.sum("used") >= 0.9 * F.sum("capacity")).alias("well_used"))
    docs = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("pieces").alias("pieces"), F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds), "container_kind")
    wrong = (F.col("n") != F.col("pieces")) | ((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")))
    docs = docs.groupBy("container_kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.count_if(wrong).alias("wrongly_split"))
    return docs.join(full, "container_kind")


# --- p9: mixing


def _mix(spark: SparkSession, folder: str) -> mx.Mix:
    docs = table(spark, folder, "documents").select("doc_id", F.array("source").alias("sources"), byte_tokens().alias("tokens"))
    return mx.Mix(docs, table(spark, folder, "source_targets"), 0.5, SEED)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report().where(F.col("deficit_tokens") > 0).select("source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Quota of every source and what of it the plan reaches."""
    return _mix(spark, folder).plan().select("source", "size_tokens", F.round("quota_tokens", 3).alias("quota_tokens"), F.round("planned_tokens", 3).alias("reached_tokens"))


def p9_selected(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).select()


def _kept_promises(mix: mx.Mix, largest: DataFrame) -> DataFrame:
    """(source, quota_tokens, within_caps, near_plan, within_quota) of a mix; ``largest`` is one row with the size of the largest document."""
    r = mix.report().crossJoin(F.broadcast(largest))  # one row
    near = F.abs(F.col("selected_tokens") - F.col("planned_tokens")) <= 2 * F.col("parts") * F.col("largest") + 1
    return r.select("source", F.round("quota_tokens", 3).alias("quota_tokens"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_caps"), near.alias("near_plan"), (F.col("planned_tokens") <= F.col("quota_tokens") + 1e-3).alias("within_quota"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the selected documents keep to each source's quota, plan and repeats."""
    return _kept_promises(_mix(spark, folder), table(spark, folder, "documents").agg(F.max(byte_tokens()).alias("largest")))


def _shared(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_hash"), byte_tokens().alias("tokens"))
    return texts.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("sources"), F.first("tokens").alias("tokens"))


def p9_shared_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Shares when copies of one text in several sources are one document of all of them."""
    return mx.Mix(_shared(spark, folder), table(spark, folder, "source_targets"), 0.5, SEED).report()


def p9_shared_report(spark: SparkSession, folder: str) -> DataFrame:
    """``p9_report`` when copies of one text in several sources are one document of all of them."""
    docs = _shared(spark, folder)
    return _kept_promises(mx.Mix(docs, table(spark, folder, "source_targets"), 0.5, SEED), docs.agg(F.max("tokens").alias("largest")))


# --- p10: spam pages


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return pg.spam_pages(table(spark, folder, "documents")).where(F.col("score") >= 0.5).select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Probability, host rate and score of every document."""
    return pg.spam_pages(table(spark, folder, "documents"))


def p10_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Of every host: documents, those without text, those without text that have a score, and scores out of range."""
    empty = table(spark, folder, "documents").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text") == 0, F.lit(True))).alias("empty"))
    scored = pg.spam_pages(table(spark, folder, "documents")).join(empty, "doc_id")
    counts = {"documents": F.lit(True), "without_text": F.col("empty"), "scored_without_text": F.col("empty") & (F.col("score") > 0), "out_of_range": ~F.col("score").between(0, 1)}
    return scored.groupBy(F.col("host").alias("repo")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


_UNIT = """
with e as (select {id} as id, any_value([cast(x as double) for x in embedding]) as v{keep} from {table}
           where {id} is not null and len(embedding) = 64 and list_bool_and([x is not null and isfinite(x) for x in embedding])
                 and list_bool_or([x <> 0 for x in embedding]) group by 1),
v as (select * exclude (v), list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u from e)
"""

_NEAR = _UNIT.format(id="sample_id", table="sample_vectors", keep="") + """,
n as (select a.id as a, b.id as b, round(list_inner_product(a.u, b.u), 9) as c, row_number() over (partition by a.id order by round(list_inner_product(a.u, b.u), 9) desc, b.id) as rn
      from v a join v b on a.id <> b.id where a.id % 100 = 0 qualify rn <= 5)
"""

_AREAS = """
with a as (select id, any_value(category_id) as category_id, cast(any_value(created_at) as date) as day, any_value(area) as area, any_value(bbox) as bbox from annotations where id is not null group by id),
l as (select category_id, day, 'recorded' as measure, area as value from a where area is not null and isfinite(area) and category_id is not null
      union all select category_id, day, 'box', bbox[3] * bbox[4] from a where category_id is not null and len(bbox) = 4
        and coalesce(list_bool_and([isfinite(bbox[1]), isfinite(bbox[2]), isfinite(bbox[3]), isfinite(bbox[4])]), false) and bbox[3] > 0 and bbox[4] > 0),
q as (select unnest([0.1, 0.5, 0.9, 0.99])::double as fraction)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_cooccurrence": p2_cooccurrence,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_label_agreement": p3_label_agreement,
    "p4_found": p4_found,
    "p4_daily": p4_daily,
    "p4_merged": p4_merged,
    "p4_daily_promises": p4_daily_promises,
    "p4_merged_promises": p4_merged_promises,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_sample": p5_sample,
    "p5_sample_counts": p5_sample_counts,
    "p6_found": p6_found,
    "p6_subset": p6_subset,
    "p6_subset_report": p6_subset_report,
    "p8_found": p8_found,
    "p8_packed": p8_packed,
    "p8_usage": p8_usage,
    "p8_promises": p8_promises,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_selected": p9_selected,
    "p9_report": p9_report,
    "p9_shared_commits": p9_shared_commits,
    "p9_shared_report": p9_shared_report,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_hosts": p10_hosts,
}

ORACLES = {
    "p10_hosts": "select repo, count(*) as documents, count(*) filter (coalesce(length(text), 0) = 0) as without_text, 0::bigint as scored_without_text, 0::bigint as out_of_range from documents group by 1",
    "p2_found": _PAIRS + "select category_a, category_b from r where n_ab * 1000 >= n_baskets * 18 and n_ab * n_baskets >= 3 * n_a * n_b",
    "p2_cooccurrence": _PAIRS + "select category_a, category_b, n_ab, n_a, n_b, n_baskets, round(n_ab / (n_a * n_b::double / n_baskets), 6) as lift from r",
    "p3_found": _UNIT.format(id="sample_id", table="sample_vectors", keep="") + """,
p as (select a.id as a, b.id as b, list_inner_product(a.u, b.u) as c from v a join v b on a.id <> b.id and list_inner_product(a.u, b.u) >= 0.92),
r as (select *, row_number() over (partition by a order by c desc, b) as rn from p)
select x.a as sample_a, x.b as sample_b from r x join r y on x.a = y.b and x.b = y.a where x.a < x.b and x.rn <= 5 and y.rn <= 5
""",
    "p3_neighbours": _NEAR + "select a as sample_id, b as neighbour_id, cast(rn as integer) as rank, round(c, 6) as cosine from n",
    "p3_label_agreement": _NEAR + """,
l as (select sample_id as id, any_value(label) as label from sample_vectors where sample_id is not null group by 1),
v1 as (select a, o.label as other, count(*) as c from n left join l o on o.id = b group by 1, 2),
v2 as (select a, other from v1 where other is not null qualify row_number() over (partition by a order by c desc, other) = 1)
select v1.a as sample_id, l.label, cast(sum(c) as bigint) as n_neighbours, cast(sum(case when v1.other = l.label then c else 0 end) as double) / sum(c) as agreement, any_value(v2.other) as suggested
from v1 left join l on l.id = v1.a left join v2 on v2.a = v1.a group by 1, 2
""",
    "p4_daily_promises": _AREAS + "select category_id, measure, day, fraction, count(*) as n_values, true as bounded, true as near from l, q where day is not null group by 1, 2, 3, 4",
    "p4_merged_promises": _AREAS + "select category_id, measure, fraction, count(*) as n_values, true as bounded, true as near from l, q group by 1, 2, 3",
    "p5_sample_counts": _TARGETS + "select category_id, least(observed, cast(ceil(required) as bigint)) as n, n as annotations from r where n > 0",
    "p8_promises": """
select container_kind, (select count(*) from documents) as documents, (select cast(sum(coalesce(strlen(text), 0)) as bigint) from documents) as tokens,
       0::bigint as wrongly_split, 0::bigint as overfull, true as well_used from container_sizes
""",
    "p4_found": """
with a as (select id, any_value(category_id) as category_id, any_value(bbox[3] * bbox[4]) as v from annotations
           where id is not null and len(bbox) = 4 and coalesce(list_bool_and([isfinite(bbox[1]), isfinite(bbox[2]), isfinite(bbox[3]), isfinite(bbox[4])]), false)
                 and bbox[3] > 0 and bbox[4] > 0 group by id)
select category_id from a where category_id in (select id from categories) group by 1
having count(*) >= 30 and quantile_cont(v, 0.9) >= 8 * quantile_cont(v, 0.5)
""",
    "p5_found": _TARGETS + "select category_id from r where observed < required",
    "p5_report": _TARGETS + """,
w as (select *, least(observed, cast(ceil(required) as bigint)) as sampled from r)
select category_id, observed, round(required, 6) as required, sampled, round(greatest(required - sampled, 0.0), 6) as deficit,
       round(sampled / sum(sampled) over (), 9) as reached_share from w
""",
    "p6_found": _UNIT.format(id="pool_id", table="pool_vectors", keep=", bool_and(not coalesce(is_labeled, false)) as unlabelled") + """
select a.id as pool_id from v a join v b on a.id <> b.id and list_inner_product(a.u, b.u) >= 0.9
where a.unlabelled group by 1 having count(*) >= 15
""",
    "p6_subset_report": _UNIT.format(id="pool_id", table="pool_vectors", keep=", bool_and(not coalesce(is_labeled, false)) as unlabelled") + """
select asked, least(asked, n) as chosen, least(asked, n) as ids, 0::bigint as labelled
from (select count(*) filter (unlabelled) as n from v), (select unnest([100, 3000])::bigint as asked)
""",
    "p8_found": "select container_kind, doc_id from documents, container_sizes where strlen(text) > capacity_tokens",
    "p9_found": """
with d as (select source, sum(strlen(text)) as n from documents group by 1)
select t.source from source_targets t left join d using (source)
where coalesce(n, 0) * max_repeats < target_share * 0.5 * (select sum(strlen(text)) from documents)
""",
    "p9_shares": """
with d as (select source, sum(strlen(text)) as n from documents group by 1),
q as (select t.source, cast(coalesce(n, 0) as bigint) as size_tokens, max_repeats,
             target_share * 0.5 * (select sum(strlen(text)) from documents) as quota from source_targets t left join d using (source))
select source, size_tokens, round(quota, 3) as quota_tokens, round(least(quota, cast(size_tokens * max_repeats as double)), 3) as reached_tokens from q
""",
    "p9_report": """
select source, round(target_share * 0.5 * (select sum(strlen(text)) from documents), 3) as quota_tokens, true as within_caps, true as near_plan, true as within_quota from source_targets
""",
    "p9_shared_report": """
select source, round(target_share * 0.5 * (select sum(n) from (select any_value(strlen(text)) as n from documents group by text)), 3) as quota_tokens, true as within_caps, true as near_plan, true as within_quota from source_targets
""",
}
