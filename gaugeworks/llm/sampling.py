"""Sample that matches target category shares, with exact counts and a report of deficits.

Every row gets a number in [0, 1) from a hash of its id and the seed. A category wants
``required`` rows of the ``observed``; its acceptance probability is their ratio. Rows
clearly below it are taken independently. Slightly oversampled rows in a narrow band
around it are ranked to correct the count exactly; the band holds in the order of the
square root of the wanted rows, so ranking never sorts a whole category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.session import cut_lineage

#: Half width of the band in standard deviations of the accepted count; 9 leaves a chance near 1e-18 of missing the exact count.
BAND_SIGMAS = 9.0
#: A target table of more categories than this is not broadcast.
MAX_BROADCAST_CATEGORIES = 50_000


def uniform(ident: str, seed: int) -> Column:
    """A number in [0, 1) with 53 random bits that depends on the id and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.col(ident), F.lit(seed)), 11).cast("double") / F.lit(float(2**53))


def plan(rows: DataFrame, targets: DataFrame, size: int | None = None, size_share: float | None = None) -> DataFrame:
    """One row per target category: observed, required, wanted, and the acceptance band [lo, hi).

    rows: (id, category), ids distinct. targets: (category, target_share, min_rows).
    required = greatest(min_rows, target_share * S) with S = ``size`` or floor(rows *
    ``size_share``); wanted = least(observed, ceil(required)). Null shares and minimums
    count as 0; a category given more than once has its largest share and minimum.
    """
    per = rows.groupBy("category").agg(F.count(F.lit(1)).alias("observed"))
    total = F.lit(size).cast("long") if size is not None else F.floor(F.sum("observed") * F.lit(size_share)).cast("long")
    whole = per.agg(F.coalesce(total, F.lit(0)).alias("sample_size"))
    asked = targets.where(F.col("category").isNotNull()).groupBy("category").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("long").alias("min_rows"))
    out = asked.join(per, "category", "left").crossJoin(F.broadcast(whole)).withColumn("observed", F.coalesce("observed", F.lit(0)))
    out = out.withColumn("required", F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_size")))
    out = out.withColumn("wanted", F.least(F.col("observed"), F.ceil("required")).cast("long"))
    p = F.col("wanted") / F.col("observed")
    half = F.lit(BAND_SIGMAS) * F.sqrt(F.col("wanted") + F.lit(1.0)) / F.col("observed")
    every = F.col("wanted") >= F.col("observed")
    out = out.withColumn("acceptance", F.when(F.col("observed") > 0, p).otherwise(0.0)).withColumn("lo", F.when(every, 1.0).otherwise(F.greatest(p - half, F.lit(0.0)))).withColumn("hi", F.when(every, 1.0).otherwise(F.least(p + half, F.lit(1.0))))
    return cut_lineage(out)  # one row a category; drawing and reporting both start from it


def draw(rows: DataFrame, planned: DataFrame, seed: int = 42) -> DataFrame:
    """(id, category) of the sample: exactly ``wanted`` rows of every planned category.

    Ties of the hash go to the smaller id. Rows of other or null categories are not taken.
    """
    bounded = planned.count() <= MAX_BROADCAST_CATEGORIES
    side = planned.where(F.col("wanted") > 0).select("category", "wanted", "lo", "hi")
    marked = rows.select("id", "category").join(F.broadcast(side) if bounded else side, "category").withColumn("u", uniform("id", seed)).where(F.col("u") < F.col("hi"))
    below = marked.where(F.col("u") < F.col("lo")).groupBy("category").agg(F.count(F.lit(1)).alias("n_below"))
    band = marked.where(F.col("u") >= F.col("lo")).withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("u", "id")))
    band = band.join(F.broadcast(below) if bounded else below, "category", "left").where(F.col("rank") <= F.col("wanted") - F.coalesce("n_below", F.lit(0)))
    return marked.where(F.col("u") < F.col("lo")).select("id", "category").unionByName(band.select("id", "category"))


def report(planned: DataFrame, sample: DataFrame) -> DataFrame:
    """Per category: target and reached share, observed, required, sampled and deficit (required - sampled, at least 0)."""
    got = sample.groupBy("category").agg(F.count(F.lit(1)).alias("sampled"))
    whole = got.agg(F.coalesce(F.sum("sampled"), F.lit(0)).alias("_all"))
    out = planned.join(got, "category", "left").crossJoin(F.broadcast(whole)).withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    reached = F.when(F.col("_all") > 0, F.col("sampled") / F.col("_all"))
    return out.select("category", "target_share", "min_rows", "sample_size", "observed", "required", "wanted", "sampled", reached.alias("reached_share"), F.greatest(F.col("required") - F.col("sampled"), F.lit(0.0)).alias("deficit"))
