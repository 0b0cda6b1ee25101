"""Counts and shares by time, group and label. One shuffle on the keys each, with partial sums before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.labels import share


def totals(rows: DataFrame, keys: list[str], flag: str = "stressed", score: str = "confidence") -> DataFrame:
    """total_cnt, stress_cnt, pct_stress (0 to 100) and avg_score for each key."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total_cnt"), F.count_if(flag).alias("stress_cnt"), F.round(F.avg(score), 6).alias("avg_score"))
    return out.withColumn("pct_stress", share(F.col("stress_cnt"), F.col("total_cnt"), 100))


def label_counts(rows: DataFrame, labels: str, keys: list[str] = ()) -> DataFrame:
    """How many times each label stands in the arrays, for each key."""
    return rows.select(*keys, F.explode(labels).alias("aspect_id")).groupBy(*keys, "aspect_id").agg(F.count("*").alias("cnt"))


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str, value: str = "cnt") -> DataFrame:
    """A row for each row of the (small, fixed) dimension."""
    return F.broadcast(dimension).join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def label_shares(rows: DataFrame, group: str, labels: str, flag: str = "stressed") -> DataFrame:
    """Labels of flagged rows by group, in percent of the group's flagged rows (they may add up to more than 100)."""
    flagged = rows.filter(flag)
    whole = flagged.groupBy(group).agg(F.count("*").alias("rows"))
    counts = label_counts(flagged, labels, [group])
    return counts.join(whole, group).select(group, "aspect_id", "cnt", share(F.col("cnt"), F.col("rows"), 100).alias("pct"))


def pairs(rows: DataFrame, labels: str, keys: list[str] = ()) -> DataFrame:
    """Ordered pairs of labels inside a row, with themselves; repeated labels count each time."""
    exploded = rows.select(*keys, F.explode(labels).alias("aspect_a"), F.col(labels).alias("_all")).select(*keys, "aspect_a", F.explode("_all").alias("aspect_b"))
    return exploded.groupBy(*keys, "aspect_a", "aspect_b").agg(F.count("*").alias("cnt"))


def unpivoted(rows: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Counts by key, attribute name and value; null and empty values are unknown."""
    values = [F.struct(F.lit(a).alias("demographic_type"), F.coalesce(F.nullif(F.col(a), F.lit("")), F.lit("unknown")).alias("value")) for a in attributes]
    return rows.select(*keys, F.explode(F.array(*values)).alias("_v")).groupBy(*keys, "_v.demographic_type", "_v.value").agg(F.count("*").alias("cnt"))


def deltas(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Change of a value against the row before. The rows are one a time bucket, already summed."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(W.orderBy(order)))


def banded(value: Column, edges: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the highest edge that the value reaches."""
    out = None
    for edge, name in sorted(edges, reverse=True):
        out = F.when(value >= edge, name) if out is None else out.when(value >= edge, name)
    return out.otherwise(lowest)


def hours_until(last: DataFrame, column: str, n: int) -> DataFrame:
    """The n hour buckets that end with the hour of the one timestamp in last."""
    steps = F.sequence(F.date_trunc("hour", column) - F.expr(f"INTERVAL {n - 1} HOURS"), F.date_trunc("hour", column), F.expr("INTERVAL 1 HOUR"))
    return last.select(F.explode(steps).alias("hour")).select(F.date_format("hour", "yyyy-MM-dd-HH").alias("hour_bucket"))


def best_epoch(rows: DataFrame, order: str, metric: str, min_delta: float, patience: int) -> DataFrame:
    """Last step that raised the metric by more than min_delta before patience steps in a row failed to.

    One row a step, folded in order.
    """
    steps = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(metric).alias("m")))).alias("steps"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(None).cast(rows.schema[order].dataType).alias("at"), F.lit(0).alias("missed"))

    def step(state: Column, x: Column) -> Column:
        better = (x["m"] > state["best"] + min_delta) & (state["missed"] < patience)
        best, at = F.when(better, x["m"]).otherwise(state["best"]), F.when(better, x["o"]).otherwise(state["at"])
        missed = F.when(state["missed"] >= patience, state["missed"]).when(better, 0).otherwise(state["missed"] + 1)
        return F.struct(best.alias("best"), at.alias("at"), missed.alias("missed"))

    return steps.select(F.aggregate("steps", start, step).alias("s")).select(F.col("s.at").alias("best_step"), F.col("s.best").alias("best_metric"))
