"""Samples whose shares of categories match targets: systematic unequal-probability sampling.

Posts are ordered at random inside the sorted categories of a plan; each has the inclusion probability
share times sample size / posts of its category (1 at most), prefix sums of these run across the partitions, and a post is selected
wherever its prefix sum passes an integer counted from one random start. Where a
category comes out below its floor, the first posts in random order that were not selected repair it.

Defined results: a post is one row per id (rows with null ids are left out; of several rows with the
same id the first by aspects, so that equal labels make one post); its category is the first id within
the range in its aspects, -1 without one; targets without a plan, category or share are left out, null
min_rows counts as 0; an empty corpus gives empty samples and every target with a need as unmet.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

N_ASPECTS = 9
SEED = 7


def category(aspects: Column, n_aspects: int = N_ASPECTS) -> Column:
    inside = F.filter(F.coalesce(aspects, F.array().cast("array<int>")), lambda x: x.between(0, n_aspects - 1))
    return F.coalesce(F.get(inside, F.lit(0)), F.lit(-1))


def posts(labeled: DataFrame, n_aspects: int = N_ASPECTS) -> DataFrame:
    """post_id, category: one row for each post."""
    of = F.min(F.struct(F.coalesce("aspects", F.array().cast("array<int>")).alias("a"), category(F.col("aspects"), n_aspects).alias("category")))
    return labeled.filter(F.col("post_id").isNotNull()).groupBy("post_id").agg(of.alias("x")).select("post_id", "x.category")


def needs(found: DataFrame, targets: DataFrame) -> DataFrame:
    """plan_name, category, target_share, size, need, posts, take, met: what each target asks and gets."""
    by = found.groupBy("category").agg(F.count("*").alias("posts"))
    n = by.agg(F.coalesce(F.sum("posts"), F.lit(0)).alias("n"))
    asked = targets.filter(F.col("plan_name").isNotNull() & F.col("category").isNotNull() & F.col("target_share").isNotNull())
    plan = asked.crossJoin(F.broadcast(n)).join(F.broadcast(by), "category", "left")  # n is one row, by has one row a category
    size = F.floor(F.coalesce("sample_fraction", F.lit(0.0)) * F.col("n"))
    plan = plan.withColumn("size", size).withColumn("need", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.floor(F.col("target_share") * F.col("size"))))
    plan = plan.withColumn("posts", F.coalesce("posts", F.lit(0)))
    return plan.select("plan_name", "category", "target_share", "size", "need", "posts", F.least("need", "posts").alias("take"), (F.col("posts") >= F.col("need")).alias("met"))


def start(seed: int, plan: str) -> float:
    """The random start of a plan's sums: 48 bits of a digest, as SQL can compute it too."""
    return int(hashlib.md5(f"{seed}|{plan}".encode()).hexdigest()[:12], 16) / 2**48


def draw(found: DataFrame, report: DataFrame, seed: int = SEED) -> DataFrame:
    """plan_name, category, post_id of the samples.

    One row a target (a fixed small table) goes to the driver for the bases of the prefix sums. The rank
    of a post in its category is the count of the buckets of the random order before its own (a prefix
    sum over at most 4096 buckets a category) and its number inside its bucket.
    """
    spark = found.sparkSession
    bases, sums = [], {}
    rows = report.select("plan_name", "category", "target_share", "size", "posts", "take").collect()
    for r in sorted(rows, key=lambda r: (r.plan_name, r.category)):
        expected = min(float(r.posts), max(0.0, r.target_share) * r.size)
        base = sums.get(r.plan_name, start(seed, r.plan_name))
        sums[r.plan_name] = base + expected
        if r.posts:
            bases.append((r.plan_name, r.category, base, expected / r.posts, r.take))
    plans = spark.createDataFrame(bases, "plan_name string, category int, base double, chance double, take bigint")

    # the first three digits of the random order are the bucket
    at = F.md5(F.concat(F.lit(f"{seed}|"), "post_id"))
    placed = found.select("category", "post_id", at.alias("at")).withColumn("bucket", F.substring("at", 1, 3))
    counts = placed.groupBy("category", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("category", "bucket", (F.sum("n").over(W.partitionBy("category").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("category", "bucket").orderBy("at", "post_id"))
    ranked = placed.withColumn("inside", inside).join(before, ["category", "bucket"]).select("category", "post_id", (F.col("before") + F.col("inside") - 1).alias("rank"))

    passes = lambda k: F.floor(F.col("base") + k * F.col("chance") + 1e-9)
    marked = ranked.join(F.broadcast(plans), "category").withColumn("hit", passes(F.col("rank") + 1) > passes(F.col("rank")))
    # of the first k posts of a category passes(k) - passes(0) are hits, so neither the hits nor the posts between them need a count
    first = F.floor(F.col("base") + 1e-9)
    lack = F.col("take") - (passes(F.col("posts")) - first)
    number = F.col("rank") + 1 - (passes(F.col("rank") + 1) - first)
    sizes = F.broadcast(report.select("plan_name", "category", "posts"))  # one row a target
    chosen = marked.join(sizes, ["plan_name", "category"]).filter(F.col("hit") | (number <= lack))
    return chosen.select("plan_name", "category", "post_id")


def outcome(report: DataFrame, drawn: DataFrame) -> DataFrame:
    """report with ``drawn`` (posts of the sample), their share of the plan's sample, and ``met``: whether the sample holds the need."""
    by = drawn.groupBy("plan_name", "category").agg(F.count("*").alias("drawn"))
    total = by.groupBy("plan_name").agg(F.sum("drawn").alias("all_drawn"))
    joined = report.drop("met").join(F.broadcast(by), ["plan_name", "category"], "left").join(F.broadcast(total), "plan_name", "left")  # one row a target
    joined = joined.withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("drawn").cast("double"), F.col("all_drawn")), F.lit(0.0))
    return joined.withColumns({"share": F.round(share, 9), "met": F.col("drawn") >= F.col("need")}).drop("all_drawn")
