"""Cleaning of forum texts, with classes spelled out so that engines agree on them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the cleaning chain.
WHITE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
ENTITY = r"&[a-zA-Z]+;|&#\p{Nd}+;"
URL = r"https?://[^\t-\r\x1c-\x20\x85\p{Z}]+|www\.[^\t-\r\x1c-\x20\x85\p{Z}]+"
EMAIL = r"[^\t-\r\x1c-\x20\x85\p{Z}]+@[^\t-\r\x1c-\x20\x85\p{Z}]+\.[^\t-\r\x1c-\x20\x85\p{Z}]+"
PHONE = r"(\+84|0)\p{Nd}{9,10}"
OTHER = r"""[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}.,!?;:\-'"]"""
SHORTEST, LONGEST = 50, 2000


def nfc(text: Column) -> Column:
    """Unicode normal form C; Spark has no expression for it."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return compose(text)


def held(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of a value that it may name several times; the value is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def stripped(text: Column) -> Column:
    """Entities, links, addresses, phone numbers and odd characters to spaces, then single spaces.

    A pattern runs only over texts with a character that it needs.
    """
    for signs, pattern in ((("&",), ENTITY), (("http", "www."), URL), (("@",), EMAIL)):

        def without(t: Column) -> Column:  # built at once, so the names of this round hold
            needed = reduce(lambda x, y: x | y, [F.contains(t, F.lit(s)) for s in signs])  # noqa: B023
            return F.when(needed, F.regexp_replace(t, pattern, " ")).otherwise(t)  # noqa: B023

        text = held(text, without)
    for pattern in (PHONE, OTHER):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def clean(text: Column) -> Column:
    return stripped(nfc(text))


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def verdict(cleaned: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """First rule that drops a cleaned text, else kept; null texts are empty."""
    size = F.length(cleaned)
    return F.when(cleaned.isNull() | (cleaned == ""), "empty").when(size < shortest, "short").when(size > longest, "long").otherwise("kept")


def mentions(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text, whatever its case, also inside other words."""
    low, found = F.lower(text), F.lit(False)
    for word in words:
        found = found | F.contains(low, F.lit(word.lower()))
    return F.coalesce(found, F.lit(False))


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def replace_first(text: Column, word: str, choices: list[str], seed: str, key: Column) -> Column:
    """The first word of the text that equals word becomes one of choices, picked by a digest of seed and key."""
    pick = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 6), 16, 10).cast("int") % len(choices) + 1).cast("int")
    words = F.split(text, " ", -1)
    at = F.array_position(words, word)
    chosen = F.element_at(F.array(*map(F.lit, choices)), pick)
    return F.when(at > 0, F.array_join(F.transform(words, lambda w, i: F.when(i == at - 1, chosen).otherwise(w)), " ")).otherwise(text)


def shuffle_middle(sentence: Column, seed: str, key: Column) -> Column:
    """The words between the first and the last one in an order drawn from seed, key, place and word; up to four words stay."""
    words = F.split(sentence, " ", -1)
    middle = F.slice(words, 2, F.size(words) - 2)
    marked = F.transform(middle, lambda w, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key, i.cast("string"), w)).alias("h"), w.alias("w")))
    mixed = F.transform(F.array_sort(marked), lambda s: s["w"])
    return F.when(F.size(words) > 4, F.array_join(F.concat(F.slice(words, 1, 1), mixed, F.slice(words, -1, 1)), " ")).otherwise(sentence)


def longer_than(text: Column, size: int = 50) -> Column:
    """Strictly more characters than size; false for null."""
    return F.coalesce(F.length(text) > size, F.lit(False))


def replace_words(text: Column, choices: dict[str, list[str]], seed: str, key: Column) -> Column:
    """One pass for each word: its first place becomes one of its choices. A later pass sees what the earlier ones made."""
    for word, others in choices.items():
        text = held(text, lambda t: replace_first(t, word, others, f"{seed}{word}", key))  # noqa: B023 - built at once
    return text


def shuffle_sentences(text: Column, seed: str, key: Column) -> Column:
    """shuffle_middle of every sentence (parts between '. ')."""
    parts = F.transform(F.split(text, r"\. ", -1), lambda s, i: shuffle_middle(s, seed, F.concat(key, F.lit("."), i.cast("string"))))
    return F.array_join(parts, ". ")
