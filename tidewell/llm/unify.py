"""One consistent form for texts that look the same but are stored with different characters.

A compiled longest-match transducer runs over grapheme clusters: a pattern finds the clusters that may
need a change (a character of a mapped kind with all its marks, or any base with combining marks), and a
table gives the form of each. The table is made from the rules below when the module is loaded; each
entry's form is its own form, so one pass gives the final text.

Two outputs: ``skeleton`` maps look-alike letters of Cyrillic and Greek to Latin whatever the script
around them, and is what comparisons use; ``unified`` is a function of the skeleton that gives words
of those scripts their own letters back.

Kept as visible: letter case, accents and their place, digits, punctuation, the number of spaces and line
breaks, the joiner inside emoji and between letters of scripts that need it, direction marks.
Defined results: null stays null, empty stays empty; a text without any mapped cluster is unchanged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Letters that look like a Latin one, "from to" pairs by script (Unicode confusables).
CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ҮY ԌG ԚQ ԜW ӀI"
GREEK = "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC"
LATIN = "ɑa ɡg ðđ ÐĐ ƉĐ ꜱs ʏy ƽs"
# Characters without a width that are removed.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u2060\u2061\u2062\u2063\u2064\ufeff"
# Joiners, which are removed unless emoji, Arabic or Indic letters stand before them.
JOINERS = "\u200c\u200d"
# Letters written as one character.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st"}

_LETTERS = {pair[0]: pair[1] for line in (CYRILLIC, GREEK, LATIN) for pair in line.split()}
_BACK = {"Cyrl": {pair[1]: pair[0] for pair in reversed(CYRILLIC.split())}, "Grek": {pair[1]: pair[0] for pair in reversed(GREEK.split())}}


def _width(char: str) -> str:
    code = ord(char)
    if 0xFF01 <= code <= 0xFF5E:
        return chr(code - 0xFEE0)
    if 0xFF61 <= code <= 0xFFDC or 0xFFE0 <= code <= 0xFFEE:
        return unicodedata.normalize("NFKC", char)
    return LIGATURES.get(char, char)


def _space(char: str) -> str:
    return " " if unicodedata.category(char) == "Zs" else char


def rule(cluster: str) -> str:
    """The form of one grapheme cluster: widths, spaces, letters below their marks, then accents."""
    out = "".join(_space(d) for c in cluster if c not in INVISIBLE for d in _width(c))
    out = "".join(_LETTERS.get(c, c) for c in unicodedata.normalize("NFD", out))
    return unicodedata.normalize("NFC", out)


class Table(dict):
    """Cluster to form. The entries of all mapped characters are made and checked for conflicts when the module is loaded; a cluster of
    such a character with its marks is added by the same rule when it is first seen, and brought to a form that is its own."""

    def __init__(self, characters: str):
        super().__init__((c, rule(c)) for c in characters)
        wrong = [c for c, form in self.items() if rule(form) != form]
        if wrong:
            raise ValueError(f"conflicting mappings: {wrong}")

    def __missing__(self, cluster: str) -> str:
        form = rule(cluster)
        while (again := rule(form)) != form:
            form = again
        self[cluster] = form
        return form


_MAPPED = "".join(_LETTERS) + "".join(LIGATURES)
TABLE = Table(_MAPPED + "".join(map(chr, [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFEF)])) + INVISIBLE)
#: Longest match first: a mapped or composed character with its marks, any character with marks, what is removed.
TRANSDUCER = regex.compile(
    rf"[{_MAPPED}\p{{Cyrillic}}\p{{Greek}}\uff01-\uff5e\uff61-\uffee]\p{{M}}*|[\p{{L}}\p{{N}}][{INVISIBLE}]*(?:\p{{M}}[{INVISIBLE}]*)+|[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]|[\u1100-\u11ff\ua960-\ua97c\ud7b0-\ud7fb]+|[{INVISIBLE}]+"
)
_JOINED = regex.compile(rf"(?<![\p{{Emoji_Presentation}}\p{{Extended_Pictographic}}\p{{Emoji_Modifier}}\ufe0f\p{{Arabic}}\p{{Devanagari}}\p{{Bengali}}\p{{Tamil}}])[{JOINERS}]+")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_ONLY = {"Cyrl": regex.compile(r"\p{Cyrillic}"), "Grek": regex.compile(r"\p{Greek}")}


class Tokens(dict):
    """A function of the parts of a text between white space, remembered for parts of ordinary length."""

    def __init__(self, function: Callable, most: int = 200_000, longest: int = 48):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, token: str):
        value = self.function(token)
        if len(token) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[token] = value
        return value

    def of(self, text: str) -> Iterator:
        return map(self.__getitem__, text.split())


def skeleton(text: str) -> str:
    if text.isascii():
        return text
    if JOINERS[0] in text or JOINERS[1] in text:
        text = _JOINED.sub("", text)
    return TRANSDUCER.sub(lambda m: TABLE[m.group()], text)


def display(form: str) -> str:
    """Gives words with a letter that only Cyrillic or Greek has all their letters of that script; words
    of shared letters alone follow the script that most such words of the text have, if none is Latin only."""
    if form.isascii() or not any(p.search(form) for p in _ONLY.values()):
        return form
    words = _WORD.findall(form)
    votes = {script: sum(bool(p.search(w)) for w in words) for script, p in _ONLY.items()}
    main = max(votes, key=lambda s: votes[s])
    shared = set(_BACK[main])
    plain = sum(not set(unicodedata.normalize("NFD", w)) - {c for c in w if unicodedata.combining(c)} <= shared and not any(p.search(w) for p in _ONLY.values()) for w in words)

    def own(match) -> str:
        word = match.group()
        script = next((s for s, p in _ONLY.items() if p.search(word)), None)
        if script is None:
            letters = [c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)]
            if plain * 2 > votes[main] or not all(c in shared for c in letters):
                return word
            script = main
        back = _BACK[script]
        return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in unicodedata.normalize("NFD", word)))

    return _WORD.sub(own, form)


def with_forms(documents: DataFrame, text: str = "text", unified: bool = True) -> DataFrame:
    """documents with ``skeleton`` (and ``unified``) beside their columns; the text is read once, in Arrow batches."""
    base = spread(documents.drop("skeleton", "unified"))
    names = ["skeleton", *(["unified"] if unified else [])]
    schema = base.select("*", *(F.lit(None).cast("string").alias(n) for n in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if t is None else skeleton(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            more = [pa.array(forms, pa.string())]
            if unified:
                more.append(pa.array([None if f is None else display(f) for f in forms], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class, form: documents of one class look the same, and those of one form are stored the same.

    Blank and null texts have no class and are left out. Digests of 256 bits stand for the texts.
    """
    formed = with_forms(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\S")), "text", unified=False)
    shown = formed.filter(F.col("skeleton").rlike(r"[^\s\p{Z}]"))
    return shown.select(F.col("key").alias(key), F.unhex(F.sha2("skeleton", 256)).alias("class"), F.unhex(F.sha2("text", 256)).alias("form"))


def look_alikes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (key_a < key_b) of documents that look the same but are stored differently.

    Only classes with more than one stored form are joined; copies of one form never meet each other.
    """
    rows = classes(documents, key, text)
    mixed = rows.groupBy("class").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low <> high").select("class")
    rows = rows.join(mixed, "class", "left_semi")
    a, b = rows.select("class", F.col(key).alias("a"), F.col("form").alias("fa")), rows.select("class", F.col(key).alias("b"), F.col("form").alias("fb"))
    pairs = a.join(b, (a["class"] == b["class"]) & (F.col("fa") != F.col("fb")) & (F.col("a") < F.col("b")))
    return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")).distinct()


def linked(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class, links: the class of each document that is not blank, and how many documents look the same but are stored differently."""
    rows = classes(documents, key, text)
    forms = rows.groupBy("class", "form").agg(F.count("*").alias("own"))
    sizes = forms.groupBy("class").agg(F.sum("own").alias("all"))
    counted = forms.join(sizes, "class").select("class", "form", (F.col("all") - F.col("own")).alias("links"))
    return rows.join(counted, ["class", "form"]).select(key, F.hex("class").alias("class"), "links")
