"""Columns over label arrays (lists of ids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(aspects: Column | str) -> Column:
    """The array itself, empty for null."""
    column = F.col(aspects) if isinstance(aspects, str) else aspects
    return F.coalesce(column, F.array().cast("array<int>"))


def in_range(aspects: Column | str, n: int) -> Column:
    """Ids from 0 to n - 1, in order, repeats kept; empty for null."""
    return F.filter(listed(aspects), lambda x: x.between(0, n - 1))


def one_hot(aspects: Column | str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(listed(aspects), i).cast("int"))


def from_one_hot(labels: Column | str, n: int) -> Column:
    """Ids whose place is 1; empty if the vector hasn't n places."""
    column = F.col(labels) if isinstance(labels, str) else labels
    ids = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(column, i) == 1)
    return F.when(F.size(column) == n, ids).otherwise(F.array().cast("array<int>"))


def joined(ids: Column) -> Column:
    """Sorted distinct ids as text."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda x: x.cast("string")), ",")


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double"))))


def above(probabilities: Column, threshold: float) -> Column:
    """Places whose probability is strictly above the threshold."""
    return F.filter(F.sequence(F.lit(0), F.size(probabilities) - 1), lambda i: F.get(probabilities, i) > threshold)


def clamp(value: Column, default: float = 0.8) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole to six places, 0 where whole is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double") * scale, whole.cast("double")), F.lit(0.0)), 6)
