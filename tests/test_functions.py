import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions import replies, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    ("given", "want"),
    [("a&nbsp;b &#39; c", "a b c"), ("xem https://x.example/a?b=1 nhé", "xem nhé"), ("mail a.b@c.example ok", "mail ok"), ("gọi 0912345678 ngay", "gọi ngay"), ("vui 😀  quá ²", "vui quá ²"), ("ế nhỏ", "ế nhỏ"), (None, None), ("", ""), (" \t ", "")],
)
def test_clean(spark, given, want):
    assert one(spark, text.clean, given) == want


def test_composed_and_decomposed_texts_have_one_digest(spark):
    assert one(spark, lambda c: text.digest(text.clean(c)), "Tiếng Việt") == one(spark, lambda c: text.digest(text.clean(c)), "Tiếng Việt")


@pytest.mark.parametrize(("size", "want"), [(0, "empty"), (49, "short"), (50, "kept"), (2000, "kept"), (2001, "long")])
def test_verdict_bounds_are_inclusive(spark, size, want):
    assert one(spark, text.verdict, "x" * size) == want


def test_labels(spark):
    assert one(spark, lambda c: L.joined(L.in_range(c, 9)), [8, -1, 9, 3, 3], "array<int>") == "3,8"
    assert one(spark, lambda c: L.one_hot(c, 4), [1, 3, 7], "array<int>") == [0, 1, 0, 1]
    assert one(spark, lambda c: L.one_hot(c, 2), None, "array<int>") == [0, 0]
    assert one(spark, lambda c: L.from_one_hot(c, 3), [1, 0, 1], "array<int>") == [0, 2]
    assert one(spark, lambda c: L.from_one_hot(c, 3), [1, 0], "array<int>") == []
    assert one(spark, lambda c: L.above(c, 0.5), [0.5, 0.51, 0.1], "array<double>") == [1]
    for value, want in ((1.7, 1.0), (-0.2, 0.0), (None, 0.8)):
        assert one(spark, L.clamp, value, "double") == want


def test_reply_objects_agree_with_plain_search(spark):
    random.seed(3)
    texts = ["".join(random.choice("{}ab\n ") for _ in range(14)) for _ in range(300)] + ['<think>{"a": 1}</think> so {"a": 2} ok', "none", '{"a": {"b": 1}}']
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", replies.last_object(F.col("v")).alias("last"), replies.widest_object(F.col("v")).alias("widest")).collect()
    for r in rows:
        a, b = r.v.find("{"), r.v.rfind("}")
        assert r.widest == (r.v[a : b + 1] if 0 <= a < b else "")
        a = r.v.rfind("{")
        assert r.last == (r.v[a : b + 1] if 0 <= a < b else "") or re.search(r"\}[^{]*\}", r.v[a:])
    fields = spark.createDataFrame([('{"a": "x"}',), ("",), (None,), ("{broken",)], "v string").select(replies.parsed(F.col("v"), "a string")["a"].alias("a")).collect()
    assert [r.a for r in fields] == ["x", None, None, None]


def test_seeded_changes(spark):
    changed = one(spark, lambda c: text.replace_first(c, "b", ["x", "y"], "s", F.lit("1")), "a b c b")
    assert changed in ("a x c b", "a y c b")
    mixed = one(spark, lambda c: text.shuffle_middle(c, "s", F.lit("1")), "a b c d e f")
    assert mixed[0] == "a" and mixed[-1] == "f" and sorted(mixed.split()) == list("abcdef")
    assert one(spark, lambda c: text.shuffle_middle(c, "s", F.lit("1")), "a b c d") == "a b c d"
