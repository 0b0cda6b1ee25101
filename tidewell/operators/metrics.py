"""Agreement of label sets and quality of predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import in_range, one_hot, share


def set_columns(a: Column, b: Column) -> dict[str, Column]:
    """Size of the symmetric difference, Jaccard (1 for two empty sets) and equality of two arrays as sets."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    apart = F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return {"diff": apart, "jaccard": F.when(either == 0, F.lit(1.0)).otherwise(F.round(both / either, 6)), "same": apart == 0}


def cells(rows: DataFrame, key: str, truth: str, predicted: str, n: int) -> DataFrame:
    """key, aspect_id, y, p: one row for each row and label."""
    zipped = F.arrays_zip(one_hot(in_range(truth, n), n).alias("y"), one_hot(in_range(predicted, n), n).alias("p"))
    return rows.select(key, F.posexplode(zipped).alias("aspect_id", "_c")).select(key, "aspect_id", "_c.y", "_c.p")


def confusion(cells_: DataFrame, keys: list[str]) -> DataFrame:
    both = (F.col("y") == 1) & (F.col("p") == 1)
    return cells_.groupBy(*keys).agg(
        F.count_if(both).alias("tp"),
        F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"),
        F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp and fn; 0 where undefined."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "support": tp + fn})


def kappa(counts: DataFrame) -> DataFrame:
    """Cohen's kappa from tp, fp, fn, tn; 1 if chance alone agrees fully and so do the raters."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    seen = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return counts.withColumn("kappa", F.round(F.when(chance == 1, F.when(seen == 1, 1.0).otherwise(0.0)).otherwise((seen - chance) / (1 - chance)), 6))
