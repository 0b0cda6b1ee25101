"""JSON objects inside model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The last object without inner objects; the stretch from the first to the last brace.
LAST_OBJECT = r"(?s)(\{[^{]*\})[^{}]*$"
WIDEST = r"(?s)\{.*\}"


def after_thinking(reply: Column) -> Column:
    return F.substring_index(reply, "</think>", -1)


def last_object(reply: Column) -> Column:
    return F.regexp_extract(reply, LAST_OBJECT, 1)


def widest_object(reply: Column) -> Column:
    return F.regexp_extract(reply, WIDEST, 0)


def parsed(json: Column, schema: str) -> Column:
    """Fields of a schema; null where they are missing or malformed."""
    return F.from_json(F.nullif(json, F.lit("")), schema)


def one_of(value: Column, allowed: list[str], default: str = "unknown") -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))
