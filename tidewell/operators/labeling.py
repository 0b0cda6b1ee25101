"""Pluggable readers of texts: fields of a person by rules, and labelers that answer in JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.labels import clamp, in_range
from ..functions.replies import after_thinking, last_object, one_of, parsed
from ..functions.text import mentions

_OPEN: dict[str, Callable] = {}


def field(text: Column, rules: dict[str, list[str]], allowed: list[str], default: str = "unknown") -> Column:
    """The first value of rules one of whose words stands in the text, if it is an allowed one; else the default."""
    found = F.lit(None).cast("string")
    for value, words in reversed(rules.items()):
        found = F.when(mentions(text, words), F.lit(value)).otherwise(found)
    return F.coalesce(one_of(found, allowed, default), F.lit(default))


def reply(text: Column, open_labeler: Callable[[], Callable[[list[str]], list[str | None]]], version: str) -> Column:
    """The answer of a labeler to each text, in batches; it is opened once in each worker. Null texts, and batches on which it fails, get none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if version not in _OPEN:
            _OPEN[version] = open_labeler()
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            some = [i for i, t in enumerate(texts) if t is not None]
            try:
                for i, answer in zip(some, _OPEN[version]([texts.iloc[i] for i in some]), strict=True):
                    out[i] = answer
            except (RuntimeError, ValueError):
                pass
            yield out

    return run(text)


def labels_of(answer: Column, n: int = 9) -> tuple[Column, Column]:
    """(ids in range, confidence between 0 and 1) of an answer; no ids and null without a readable object."""
    fields = parsed(last_object(after_thinking(answer)), "aspects array<int>, confidence double")
    return F.array_sort(F.array_distinct(in_range(fields["aspects"], n))), F.when(fields.isNotNull(), clamp(fields["confidence"]))


def word_labeler(words: dict[int, str]) -> Callable[[list[str]], list[str]]:
    """A stand-in: the ids whose words stand in the text, after some thinking aloud."""

    def answer(texts: list[str]) -> list[str]:
        ids = [[i for i, w in words.items() if w in t] for t in texts]
        return [f'<think>{{maybe 9}}</think> {{"aspects": {found + [99]}, "confidence": {0.5 + len(found) / 2}}}' for found in ids]

    return answer
