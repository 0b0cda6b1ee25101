"""Building data sets: anti-joins, tagged unions, splits, samples and gap plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lot(seed: str, key: Column) -> Column:
    """A place in a random order that every engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, then the rows of new whose key old doesn't hold; repeats inside either stay."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def tagged(parts: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def exact_sample(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """int(n * share) rows, the first ones in a random order of the keys.

    Of 4096 buckets of that order all but one are taken whole or not at all, by their counts; only the rows of the
    bucket in which the sample ends are sorted.
    """
    placed = rows.withColumn("_lot", lot(seed, F.col(key))).withColumn("_bucket", F.substring("_lot", 1, 3))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    whole = W.partitionBy()  # at most 4096 rows
    room = (F.sum("_n").over(whole) * F.lit(share)).cast("bigint") - (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n"))
    joined = placed.join(F.broadcast(counts.select("_bucket", "_n", room.alias("_room")).filter("_room > 0")), "_bucket")
    last = joined.filter("_room < _n").withColumn("_in", F.row_number().over(W.partitionBy("_bucket").orderBy("_lot", key))).filter("_in <= _room").drop("_in")
    return joined.filter("_room >= _n").unionByName(last).select(rows.columns)


def ranked(rows: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """rows with _rank (from 1, in a random order inside the stratum) and _all (rows of the stratum).

    Ranks come from the counts of 256 buckets of the random order, so a stratum that holds a third of all
    rows is spread over as many tasks.
    """
    placed = rows.withColumn("_lot", lot(seed, F.col(key))).withColumn("_bucket", F.substring("_lot", 1, 2))
    counts = placed.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(stratum)
    before = counts.select(F.col(stratum).alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    inside = placed.withColumn("_in", F.row_number().over(W.partitionBy(stratum, "_bucket").orderBy("_lot", key)))
    joined = inside.join(F.broadcast(before), F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))  # 256 rows a stratum
    return joined.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_lot", "_bucket", "_in", "_s", "_b", "_before")


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """split_part of each row: in every stratum int(n * train), int(n * val) and the rest, in a random order."""
    first, second = (F.col("_all") * F.lit(train)).cast("int"), (F.col("_all") * F.lit(val)).cast("int")
    part = F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= first + second, "val").otherwise("test")
    return ranked(rows, stratum, key, seed).withColumn("split_part", part).drop("_rank", "_all")


def resampled(rows: DataFrame, stratum: str, key: str, wanted: DataFrame, seed: str, chunk: int = 65_536) -> DataFrame:
    """Draws with replacement: wanted (stratum, n) slots, each taking the row of a drawn rank in its stratum.

    The slots of a large stratum are made in chunks by several tasks.
    """
    placed = ranked(rows, stratum, key, seed).withColumn("_rank", F.col("_rank") - 1)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_all"))
    chunks = wanted.join(sizes, stratum).filter("n > 0").select(stratum, "_all", F.col("n").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("n") - 1) / chunk).cast("bigint"))).alias("_c"))
    slots = chunks.repartition(stratum, "_c").select(stratum, "_all", F.explode(F.sequence(F.col("_c") * chunk + 1, F.least(F.col("n"), (F.col("_c") + 1) * chunk))).alias("slot"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(stratum).cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return slots.withColumn("_rank", number % F.col("_all")).drop("_all").join(placed.drop("_all"), [stratum, "_rank"]).drop("_rank")


def gap_plan(counts: DataFrame, total: int, coverage: float, first: float = 0.4, second: float = 0.6) -> DataFrame:
    """How many rows each label lacks to int(total * coverage), and how the gap is filled."""
    target = F.lit(int(total * coverage))
    gap = F.greatest(target - F.col("cnt"), F.lit(0))
    return counts.select("aspect_id", "cnt", target.alias("target"), gap.alias("gap"), (gap * F.lit(first)).cast("int").alias("augment"), (gap * F.lit(second)).cast("int").alias("generate"))


def class_weights(counts: DataFrame, total: int, n: int, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """total / (n * count), 1 for a label that never occurs, between low and high."""
    raw = F.when(F.col("cnt") == 0, F.lit(1.0)).otherwise(F.lit(float(total)) / (F.lit(n) * F.col("cnt")))
    return counts.select("aspect_id", "cnt", F.round(F.least(F.greatest(raw, F.lit(low)), F.lit(high)), 6).alias("weight"))


def relabelled(rows: DataFrame, relabels: DataFrame, key: str, labels: str = "aspects", model: str = "model") -> DataFrame:
    """rows with the labels and model of their relabelling; without one they keep their labels under the model fallback."""
    new = relabels.select(key, F.col(labels).alias("_labels"), F.col(model).alias("_model"))
    joined = rows.join(new, key, "left")
    return joined.withColumns({labels: F.coalesce("_labels", labels), model: F.coalesce("_model", F.lit("fallback"))}).drop("_labels", "_model")
