"""Feeds with their filters as parameters."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"
#: Spans that a feed offers.
SPANS = {"1h": "1 HOUR", "24h": "24 HOURS", "7d": "7 DAYS"}


def selected(rows: DataFrame, equal: dict[str, object] | None = None, among: dict[str, list] | None = None, any_of: dict[str, list] | None = None) -> DataFrame:
    """Rows whose columns equal a value, are among some, or (arrays) hold any of some; All, None and an empty list ask for nothing."""
    for column, value in (equal or {}).items():
        if value is not None and value != ALL:
            rows = rows.filter(F.col(column) == F.lit(value))
    for column, values in (among or {}).items():
        if values and ALL not in values:
            rows = rows.filter(F.col(column).isin(list(values)))
    for column, values in (any_of or {}).items():
        if values and ALL not in values:
            rows = rows.filter(F.arrays_overlap(column, F.array(*(F.lit(v) for v in values))))
    return rows


def between(rows: DataFrame, at: str, first: datetime.datetime | None = None, last: datetime.datetime | None = None) -> DataFrame:
    """Rows from first up to before last; a plain comparison of the column, so that it reaches the scan."""
    if first is not None:
        rows = rows.filter(F.col(at) >= F.lit(first))
    return rows if last is None else rows.filter(F.col(at) < F.lit(last))


def latest(rows: DataFrame, at: str) -> datetime.datetime | None:
    """The last time in a table: one value."""
    return rows.agg(F.max(at)).first()[0]


def recent(rows: DataFrame, at: str, span: str, as_of: datetime.datetime | None = None) -> DataFrame:
    """Rows of a span (SPANS) up to as_of, which defaults to the last time in the table; none of an empty table."""
    as_of = latest(rows, at) if as_of is None else as_of
    hours = {"1h": 1, "24h": 24, "7d": 168}[span]
    if as_of is None:
        return rows.limit(0)
    return rows.filter((F.col(at) >= F.lit(as_of - datetime.timedelta(hours=hours))) & (F.col(at) <= F.lit(as_of)))


def bucket_time(bucket: Column) -> Column:
    """The time at which an hour bucket begins; null for anything else."""
    return F.try_to_timestamp(bucket, F.lit("yyyy-MM-dd-HH"))
