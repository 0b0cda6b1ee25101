"""Sentences of texts in many languages and scripts: candidate boundaries and a maximum-entropy classifier.

Line breaks always end a sentence. Inside a line every place that may end one is a candidate: final marks
(with closing marks, quotation marks and smileys behind them), smileys alone, final marks without a space
behind them, and spaces behind the final particles of Thai. Nothing inside a quotation is a candidate.

Counts over the whole corpus (hashed to a fixed number of places) tell of each word before a full stop how
often it stands before other ends of sentences, and of each word how often it begins one. Words that always
have their stop, and never at the end of a line, are abbreviations; ends by other marks are reliable
boundaries. On these a maximum-entropy (logistic) classifier of neighbouring words, length, digits, case
of what follows an abbreviation, kind of mark and script is trained, from the candidates of at most
``sample`` documents (about so many, those with the lowest hashes of their keys), and decides about all candidates.

Defined results: null, empty and blank texts, and texts without visible characters, give no row; a line
without letters or digits is one sentence; closing marks without anything before them join what follows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .logistic import train
from .pii import normal

PLACES = 1 << 18
WEIGHTS = 1 << 17
#: Documents whose candidates train the classifier.
SAMPLE = 8000
#: Characters before a mark in which its word, and the word before that, are looked for.
SIGHT = 60
#: A word needs so many stops to be judged by its counts.
ENOUGH = 8

# Smileys of letters and signs.
_EMOJI = "\\U0001F300-\\U0001FAFF\\u2600-\\u27BF"
SMILEY = rf"(?:[:;=][\-'’]?[()\[\]DPpvVoO3|]+\)*|[xX]D+|T_T|\^_?\^|<3+|[{_EMOJI}][\U0001F3FB-\U0001F3FF\ufe0f]*(?:\u200d[{_EMOJI}]\ufe0f?)*)"
# Particles that end sentences in Thai.
THAI = ("ครับ", "ค่ะ", "คะ", "ค๊ะ", "จ้ะ", "จ้า", "ฮะ", "ครับผม")
# Quotation marks that open and close.
QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", '"': '"', "《": "》"}

# Signs that may begin a sentence.
OPENERS = "\"“«„「『¿¡([<'‘—-+#@*&_~"

_SMILEYS = rf"(?:\s*{SMILEY}(?=\s|$|{SMILEY}))"
_CLOSERS = r"[\"”“»’」』)\]]"
END = regex.compile(rf"(?P<marks>(?:\s(?=[!?]))?[.!?…。।؟｡]+(?:\s?[!?]+)*)(?P<close>(?:\s?»|{_CLOSERS})*)(?P<smile>{_SMILEYS}*)|\s(?P<alone>{SMILEY}(?:\s*{SMILEY})*)(?=\s|$)|(?<=[\u0e00-\u0e7f])(?P<thai>\s+)(?=\S)")
_DOTTED = r"(?:\p{L}\p{M}*){1,2}(?:\.(?:\p{L}\p{M}*){1,2})+(?![\p{L}\p{M}])"
TOKEN = regex.compile(rf"{_DOTTED}|\p{{L}}[\p{{L}}\p{{M}}'’]*|\d+(?:[.,:]\d+)*|\S")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_BEFORE = regex.compile(rf"(?r)(?:(?P<prior>[\p{{L}}\p{{M}}\d.,]+)\.? )?(?P<word>(?<![\p{{L}}\p{{M}}]){_DOTTED}|\p{{L}}[\p{{L}}\p{{M}}'’]*|\d+(?:[.,:]\d+)*|\S)$")
_QUOTE = regex.compile("[" + "".join(QUOTES) + "]")
_GAP = regex.compile(r"\s*")
_BREAK = regex.compile(r"[\n\r\u2028\u2029]")
_TAIL = regex.compile(rf"(?r)([.!?…]*){_CLOSERS}*\s*(?:{SMILEY}\s*)*$")
_SHORT = regex.compile(r"\W*\p{L}{1,2}(?:\.\p{L}{1,2})+\.?\W*")
_VOWEL = regex.compile(r"[aeiouyăâêôơưаеиоуыэюяé]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SOLID = regex.compile(r"[\p{L}\p{N}]")
_UNSEEN = regex.compile(r"[\s\p{Z}\p{Cc}\p{Cf}]")


_places: dict[str, int] = {}


def _place(text: str) -> int:
    if text not in _places:
        if len(_places) > 1_000_000:
            _places.clear()
        _places[text] = zlib.crc32(text.encode())
    return _places[text]


def quoted(line: str) -> list[tuple[int, int]]:
    """Spans of quotations (with their marks) in a line; marks without a partner are no quotation."""
    out, gone = [], set()
    m = _QUOTE.search(line)
    while m:
        at = m.start()
        # a mark that isn't found once is not found further on either
        ends = [j for c in QUOTES[m.group()] if c not in gone and (j := line.find(c, at + 1)) >= 0]
        if ends:
            out.append((at, min(ends) + 1))
            at = min(ends)
        else:
            gone.update(QUOTES[m.group()])
        m = _QUOTE.search(line, at + 1)
    return out


def lines(norm: str) -> list[tuple[int, int]]:
    edges, start = [], 0
    for m in _BREAK.finditer(norm):
        edges.append((start, m.start()))
        start = m.end()
    return [*edges, (start, len(norm))]


class Candidate:
    __slots__ = ("colon", "end", "follow", "key", "kind", "near", "next", "script", "space", "word")


def _key(line: str, at: int) -> tuple[str, str]:
    """(key of the counts, last word) of the SIGHT characters before a mark: a number counts with the word before it."""
    m = _BEFORE.search(line[max(0, at - SIGHT) : at])
    if not m:
        return "", ""
    word = m.group("word").lower()
    prior = (m.group("prior") or "").lower()
    if word[0].isdigit():
        return f"{'#' if prior[:1].isdigit() else prior} #", "#"
    if len(word) == 1 and prior[:1].isdigit():
        return f"{'000' if prior.endswith('000') else '#'} {word}", word
    return word, word


def find(line: str) -> list[Candidate]:
    """Candidates of a line, in order; the end of the line is none."""
    spans, out, span = quoted(line), [], 0
    stop = len(line.rstrip())
    for m in END.finditer(line):
        end = m.end() if m.group("thai") is None else m.start()
        if end >= stop:
            break
        while span < len(spans) and spans[span][1] <= m.start():
            span += 1
        within = spans[span] if span < len(spans) and spans[span][0] <= m.start() else None
        if within and end < within[1]:
            continue
        after = _GAP.match(line, end).end()
        c = Candidate()
        c.end, c.space, c.colon = end, line[end : end + 1].isspace(), False
        first = TOKEN.match(line, after)
        c.next = ("#" if first.group()[0].isdigit() else first.group().lower()) if first else ""
        char = line[after : after + 1]
        c.follow = "u" if char.isupper() else "l" if char.islower() else "d" if char.isdigit() else "q" if char in OPENERS else "c" if _CJK.match(char) else "a" if char.isalpha() else "o"
        c.key, c.word = _key(line, m.start())
        c.near = line[max(0, m.start() - 1) : m.start()]
        marks = m.group("marks") or ""
        c.script = "t" if "\u0e00" <= c.near <= "\u0e7f" else "j" if _CJK.search(line[max(0, m.start() - 2) : m.start()] + char) else "x"
        if m.group("thai") is not None:
            if not line.endswith(THAI, 0, m.start()) or within:
                continue
            c.kind = "T"
        elif m.group("alone") or m.group("smile"):
            c.kind = "E"
        elif within:
            if c.script == "j" or not c.space:
                continue
            if char in "—–-,;:":
                continue
            c.kind, c.colon = "Q", line[max(0, within[0] - SIGHT) : within[0]].rstrip().endswith((":", "："))
        elif any(x in marks for x in "。।؟｡"):
            c.kind = "C"
        elif "!" in marks or "?" in marks:
            c.kind = "C" if c.script == "j" else "X"
        elif marks != ".":
            c.kind = "C" if c.script == "j" and "…" in marks else "D"
        else:
            c.kind = "P"
        if not c.space and c.kind in "PD" and (not char.isalpha() or _chunk(line, m.start())):
            continue
        if c.kind == "P" and c.near.isspace():
            continue
        if c.kind in "PDX" and c.follow == "o":
            continue
        if c.kind == "X" and not c.space and (char.isdigit() or char.islower() and marks == "!"):
            continue  # a sign that stands for a letter
        out.append(c)
    return out


def _chunk(line: str, at: int) -> bool:
    """Whether the place lies in a part without spaces that looks like an address, a number or an abbreviation."""
    a = max(line.rfind(" ", 0, at), line.rfind("\n", 0, at)) + 1
    b = line.find(" ", at)
    part = line[a : len(line) if b < 0 else b]
    return "@" in part or "://" in part or part.lower().startswith("www.") or at - a < 2 or _SHORT.fullmatch(part) is not None


FOUND = "array<struct<line:int,end:int,solid:boolean,seen:boolean,kind:string,space:boolean,follow:string,script:string,colon:boolean,key:string,word:string,next:string>>"


def _entries(norm: str, at: Sequence[int], text: str, spans: list[tuple[int, int]], found: list[list[Candidate]]) -> list[tuple]:
    """What the decision needs of each candidate and (kind empty) of each end of a line: its line, the end of the text before it
    in the stored text, and whether there are letters or digits, or anything visible, since the candidate before it."""
    out = []
    for number, ((a, b), candidates) in enumerate(zip(spans, found, strict=True)):
        start = a
        for c in [*candidates, None]:
            cut = b if c is None else a + c.end
            i = cut
            while i > start and _UNSEEN.match(norm, i - 1):
                i -= 1
            seen = i > start
            end = at[i]
            while seen and end > at[i - 1] + 1 and _UNSEEN.match(text, end - 1):
                end -= 1
            solid = _SOLID.search(norm, start, cut) is not None
            out.append((number, end, solid, seen, "", False, "", "", False, "", "", "") if c is None else (number, end, solid, seen, c.kind, c.space, c.follow, c.script, c.colon, c.key, c.word, c.next))
            start = cut
    return out


def _scan(frames: Iterator[pd.DataFrame], places: int) -> Iterator[pd.DataFrame]:
    """Candidates of every text, and (count not null) the counts by place: stops inside lines, stops at ends, other ends; beginnings of sentences, occurrences."""
    counts = np.zeros((5, places), np.int32)
    for frame in frames:
        hits: list[list[int]] = [[], [], [], [], []]
        out = []
        for k, text in zip(frame.key, frame.text, strict=True):
            norm, at = normal(text)
            spans = lines(norm)
            found = [find(norm[a:b]) for a, b in spans]
            for (a, b), candidates in zip(spans, found, strict=True):
                body = norm[a:b].rstrip()
                if not body:
                    continue
                first = TOKEN.match(body, _GAP.match(body).end())
                hits[3].append(_place(first.group().lower()))
                hits[4] += map(_place, _WORD.findall(body.lower()))
                for c in candidates:
                    if c.kind == "P" and c.space:
                        hits[0].append(_place(c.key))
                    elif c.kind in "XCDE":
                        hits[2].append(_place(c.key))
                    if c.kind in "XCE" and c.next:
                        hits[3].append(_place(c.next))
                tail = _TAIL.search(body, max(0, len(body) - 40))
                key = _key(body, len(body[: tail.start()].rstrip()))[0]
                hits[1 if tail.group(1) == "." else 2].append(_place(key))
            out.append((k, lower_style(norm, found, spans), _entries(norm, at, text, spans, found)))
        for kind, spots in enumerate(hits):
            counts[kind] += np.bincount(np.array(spots, np.int64) % places, minlength=places).astype(np.int32)
        if out:
            yield pd.DataFrame(out, columns=["key", "lower", "found"]).assign(kind=None, place=None, count=None)
    kind, place = counts.nonzero()
    none = [None] * len(kind)
    if none:
        yield pd.DataFrame({"key": none, "lower": none, "found": none, "kind": kind, "place": place, "count": counts[kind, place]})


class Counts:
    """What the corpus tells of words at stops and at beginnings."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.places = counts, counts.shape[1]

    def group(self, key: str, word: str) -> str:
        """n: ends sentences by other marks too; t: always with a stop, never at an end of a line; v: with a stop, also there; r: too rare."""
        inside, last, other = (int(x) for x in self.counts[:3, _place(key) % self.places])
        if len(word) == 1 and word.isalpha() and inside + last + other < ENOUGH:
            return "t"
        if other >= max(2, 0.03 * (inside + last)):
            return "n"
        if inside + last < (2 * ENOUGH if word == "#" else ENOUGH):
            return "r"
        return "t" if last <= 0.01 * inside else "v" if other <= 0.01 * (inside + last) else "n"

    def starts(self, word: str) -> str:
        """How often a word begins a sentence: 0 never or rare, 1 sometimes, 2 often."""
        begun, all_ = (int(x) for x in self.counts[3:, _place(word) % self.places])
        return "0" if begun < 2 or not all_ else "2" if begun > 0.15 * all_ else "1" if begun > 0.01 * all_ else "0"


def features(c: Candidate, known: Counts, size: int) -> tuple[list[int], str]:
    """(places of the features, group of the word before)."""
    group, begins = known.group(c.key, c.word), known.starts(c.next)
    kind = c.kind + ("" if c.space else "0")
    shape = ("#" if c.word == "#" else "." if "." in c.word else str(min(len(c.word), 4))) + ("" if _VOWEL.search(c.word) else "c")
    out = [f"k{kind}", f"g{kind}{group}", f"s{kind}{shape}", f"b{kind}{begins}", f"x{kind}{c.script}"]
    if kind[0] in "PDQ":
        out += [f"n{kind}{c.next}", f"w{kind}{c.key}"]
    if kind == "P" and group in "vr":
        out += [f"f{group}{c.follow}", f"f{group}{shape}{c.follow}"]
    if kind[0] == "D":
        out += [f"d{c.key} {c.next}", f"db{begins}{group}"]
    if kind == "Q":
        out += [f"q{c.colon}", f"q{c.colon}{begins}"]
    if not c.space:
        out += [f"o{kind}{group}{begins}", f"o{kind}{c.follow}{begins}"]
    return [_place(f) % size for f in out], group


def label(c: Candidate, group: str, begins: str, lower: bool) -> int | None:
    """1 a reliable boundary, 0 reliably none, None neither; lower: the text begins sentences without capitals."""
    new = c.follow in "uqda"
    if c.kind in "CET":
        return 1
    if c.kind == "X":
        if not c.space and c.follow in "ld" and begins == "0":
            return 0
        return 1 if c.follow in "uqdc" else None
    if c.kind == "P":
        if group == "t" or not c.space and c.follow == "l" and begins == "0":
            return 0
        if group == "n":
            return 1 if new and c.follow != "a" or c.script == "x" and c.follow == "a" else None
        if lower or group == "r" and c.follow != "l" and (len(c.word) < 4 and c.word != "#" or "." in c.word):
            return None
        return int(new)
    if c.kind == "Q" and c.follow == "a":
        return int(c.colon)
    return None if lower else int(new)


def lower_style(text: str, found: list[list[Candidate]], spans: list[tuple[int, int]]) -> bool:
    """Whether a text begins lines, or sentences after reliable marks, in lower case."""
    return any(text[a:b].lstrip()[:1].islower() for a, b in spans) or any(c.kind in "XE" and c.follow == "l" for cs in found for c in cs)


def _candidate(entry: dict) -> Candidate:
    c = Candidate()
    c.kind, c.space, c.follow, c.script, c.colon, c.key, c.word, c.next = (entry[f] for f in ("kind", "space", "follow", "script", "colon", "key", "word", "next"))
    return c


def _labelled(frames: Iterator[pd.DataFrame], counts: np.ndarray, size: int) -> Iterator[pd.DataFrame]:
    known = Counts(counts)
    for frame in frames:
        out = []
        for lower, found in zip(frame.lower, frame.found, strict=True):
            for c in (_candidate(e) for e in found if e["kind"]):
                places, group = features(c, known, size)
                if (y := label(c, group, known.starts(c.next), lower)) is not None:
                    out.append((places, y))
        yield pd.DataFrame(out, columns=["places", "y"])


class Judge:
    """Decides about candidates; what was decided once is remembered."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, most: int = 300_000):
        self.known, self.weights, self.most = Counts(counts), weights, most
        self.cache: dict[tuple, bool] = {}

    def boundary(self, entry: dict) -> bool:
        what = tuple(entry[f] for f in ("kind", "space", "follow", "script", "colon", "key", "word", "next"))
        if what not in self.cache:
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[what] = bool(self.weights[features(_candidate(entry), self.known, len(self.weights))[0]].sum() > 0)
        return self.cache[what]

    def ends(self, found: list[dict]) -> list[int]:
        """end_pos of every sentence of a text."""
        out = []
        left = [False] * len(found)  # whether letters or digits come later in the line
        for i in range(len(found) - 2, -1, -1):
            left[i] = found[i]["line"] == found[i + 1]["line"] and (left[i + 1] or found[i + 1]["solid"])
        solid = seen = False
        for e, more in zip(found, left, strict=True):
            solid, seen = solid or e["solid"], seen or e["seen"]
            if not e["kind"]:
                if seen:
                    out.append(e["end"])
            elif solid and more and self.boundary(e):  # a piece needs a letter or digit of its own, and one must be left after it
                out.append(e["end"])
            else:
                continue
            solid = seen = False
        return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, places: int = PLACES, weights: int = WEIGHTS) -> DataFrame:
    """key, end_pos of every sentence: code points of the stored text up to its last visible character.

    Every text is read once; its candidates are stored. To the driver go the counts (5 * places at most) and the labelled
    candidates of about sample documents, those with the lowest hashes of their keys.
    """
    spark = documents.sparkSession
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != "")))
    kind = rows.schema["key"].dataType.simpleString()
    scanned = stored(rows.mapInPandas(lambda frames: _scan(frames, places), f"key {kind}, lower boolean, found {FOUND}, kind int, place int, count int"), "candidates")
    summed = scanned.filter("count IS NOT NULL").groupBy("kind", "place").agg(F.sum("count").alias("n")).toPandas()
    counts = np.zeros((5, places), np.int64)
    counts[summed.kind, summed.place] = summed.n
    shared = spark.sparkContext.broadcast(counts)
    texts = scanned.filter("found IS NOT NULL").select("key", "lower", "found")
    part = min(1.0, sample / max(1, texts.count()))
    chosen = texts.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= int((1 << 30) * part))
    taught = chosen.mapInPandas(lambda frames: _labelled(frames, shared.value, weights), "places array<int>, y int").toPandas()
    model = spark.sparkContext.broadcast(train(list(taught.places), taught.y.to_numpy(float), weights))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value, model.value)
        for frame in frames:
            ends = [judge.ends(found) for found in frame.found]
            yield pd.DataFrame({"key": frame.key.repeat([len(e) for e in ends]), "end_pos": [x for e in ends for x in e]})

    return texts.mapInPandas(decide, f"key {kind}, end_pos bigint").withColumnRenamed("key", key)
