"""Feeds and top lists; ties are broken by explicit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def ordered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The whole result in order, for tables of one row a bucket."""
    return rows.orderBy(*order)


def limited(rows: DataFrame, n: int) -> DataFrame:
    """Any n rows."""
    return rows.limit(n)


def latest_by(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key (WindowGroupLimit keeps n of each before the shuffle)."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def upserted(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Last writer wins; a hot key shrinks to one row a task before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def first_by_hash(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """The first row in order of each digest."""
    others = [c for c in rows.columns if c != digest]
    return rows.groupBy(digest).agg(F.min_by(F.struct(*others), order).alias("_r")).select(digest, "_r.*")
