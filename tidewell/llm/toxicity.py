"""Scores of abusive, hateful and sexual content: maximum-scoring segments of token log-odds.

Texts become plain words (look-alike letters, accents, case, stretched letters, separators and digits inside
words set aside). Sentences that hold a word or phrase of a short general lexicon are the first toxic sample, all other words
the background. Counts of words and word pairs, hashed to ``places`` places, give log-odds with Dirichlet priors in
proportion to the corpus; a linear scan (Ruzzo and Tompa) finds every maximal segment of each document, and
the significant ones are the next round's sample. So what surrounds the lexicon's words is learned, and
lexicon words in calm surroundings drop out.

Significance is by extreme-value statistics: lambda solves sum p(s) exp(lambda s) = 1 over the scores of the background, K is
the likeliest value for the best segments of background documents, and E = K * words * exp(-lambda * score)
segments so good are expected by chance. A document is judged by all its segments together: the least
expectation of its best r segments by the statistics of their sum (Karlin and Altschul), over r.

Defined results: null, empty and blank texts score 0 and are never flagged. Without any toxic sentence
nothing is flagged. Repeated rows each keep their own score. Null sources are a source of their own.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .unify import Tokens, display, skeleton

#: Hashed places of words, and as many of word pairs (a power of two).
PLACES = 1 << 20
#: Prior strength in sizes of the toxic sample, bounds of a place's log-odds, cost of each word.
PRIOR, LOW, HIGH, COST = 1.0, -4.0, 5.0, 0.7
#: Most log-odds of a place that toxic and other sentences hold equally often.
BALANCE = 3.0
#: A document is flagged if its segments have at most this expectation; segments up to SAMPLED make the next sample.
EXPECTED, SAMPLED = 1e-6, 1e-5
ROUNDS = 2
BIN = 0.1

# General abusive, hateful and sexual words and set phrases, as they are written.
LEXICON = """
ngu si|đồ ngu|ngu dốt|óc chó|đồ chó|chó đẻ|chó má|mặt dày|súc sinh|súc vật|khốn nạn|khốn kiếp|mất dạy|vô học|hèn mạt|rác rưởi|bẩn thỉu|đồ vô dụng|ăn hại|ăn bám|hạ đẳng|trộm cắp|óc bã đậu|như mày|mày là|mày đi|con đĩ|con mụ|quét sạch|xóa sổ
cút đi|cút xéo|biến mẹ|biến khỏi|câm mồm|ngậm mồm|chết quách|địt mẹ|đụ má|giết mày|nhổ vào mặt|cho ma|đuổi hết|ai cũng khinh|xấu xa|thằng chó|lũ chó|làm tình|khỏa thân|chat sex|clip sex|một đêm
moron|filthy|disgusting|pathetic|worthless|loser|freak|thieves|beaten|asshole|bastard|dickhead|whore|slut|scum|subhuman|stupid bitch|piece of shit|piece of trash|eradicated|wiped out|burn them|throw them|kick them|go to hell|drop dead|get lost|shut your|choke on|kill yourself|not even human|nudes|porn|horny|uncensored|fuck
connard|abruti|dégage|nue|salope|ordure|merde|pute|pauvre con|ta gueule|crever|baiser
dumme|blöde|arschloch|vollidiot|hurensohn|fresse|stück dreck|versager|verpiss|schlampe|nacktbilder|ficken|halt den mund
cabrón|gilipollas|imbécil|mierda|puta|inútil|asqueroso|cállate|lárgate|desnuda|follar|follarte
тупая|гнать|голые|заткнись|сволочь|мразь|тварь|дебил|урод|ничтожный|козёл|шлюха|исчезни|трахнуть
裸|クズ|馬鹿|野郎|消えろ|やらせろ
闭上|蠢猪|贱人|滚|臭嘴|废物|裸照|上床
"""
# Words that also have a calm meaning; they count in a sentence with another entry of either list.
AMBIGUOUS = """
đần độn|ký sinh|nô lệ|con điên|người lớn|nhập cư|dân tộc|theo đạo|của mày|idiot|bitch|vermin|parasite|parasites|rats|nude|naked|useless|stupid|ugly|dumb|animal|trash|pig|disease|migrant|immigrants|foreigners|tribe
ungeziefer|sau|kuh|ratas|virer|vache|паразиты|приезжие|рот|infierno|la boca
"""
# What stands for letters inside words.
LEET = str.maketrans("0134579@$!", "oieastgasi")

_SPACED = regex.compile(r"(?<![\p{L}\p{N}])\p{L}\p{M}*(?:([_*.\-·])\p{L}\p{M}*)(?:\1\p{L}\p{M}*)+(?![\p{L}\p{N}])")
_MIXED = regex.compile(r"(?<![\p{L}\p{N}])\p{Latin}\p{M}*(?:[\p{Latin}\p{M}]|[0-9@$!]{1,3}(?=\p{Latin})){2,}")
_STRETCH = regex.compile(r"(\p{L})\1{2,}")
_MARKS = regex.compile(r"\p{Mn}+")
_SENTENCE = regex.compile(r"[.!?…。！？।]+(?=[\s\"'»”’)」』\]]|$)|[。！？।]")
_WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|\p{L}(?:[\p{L}*]*\p{L})?|\p{N}+")
END = -1


def plain(text: str) -> str:
    text = display(skeleton(text))
    if "*" in text or "_" in text or "-" in text or "." in text:
        text = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text)
    text = unicodedata.normalize("NFKD", text.casefold())
    text = _MARKS.sub("", text).replace("đ", "d")
    text = _MIXED.sub(lambda m: m.group().translate(LEET) if not m.group().isalpha() else m.group(), text)
    return _STRETCH.sub(r"\1", text)


def phrases(lexicon: str = LEXICON) -> list[list[str]]:
    """The plain words of each entry of a lexicon (entries by line and bar)."""
    return [words for line in lexicon.strip().split("\n") for entry in line.split("|") if (words := _WORDS.findall(plain(entry)))]


_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted({w for p in phrases(LEXICON + AMBIGUOUS) for w in p if len(w) > 2}):
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


def _unmask(word: str) -> str:
    """A word with masked letters (kh*n) becomes the first word of the lexicon that fits it."""
    shape = regex.compile(word.replace("*", "."))
    return next((w for w in _BY_LENGTH.get(len(word), []) if shape.fullmatch(w)), word)


def _code(word: str) -> int:
    return zlib.crc32(("0" if word.isdigit() else _unmask(word) if "*" in word else word).encode())


def _token(token: str) -> tuple[int, ...]:
    """Codes of the words of a part without spaces, END after the ends of sentences."""
    if token.isascii() and token.isalpha() and token.islower():
        return (_code(_STRETCH.sub(r"\1", token)),)
    out: list[int] = []
    parts = _SENTENCE.split(plain(token))
    for i, part in enumerate(parts):
        out += map(_code, _WORDS.findall(part))
        if i + 1 < len(parts):
            out.append(END)
    return tuple(out)


_tokens = Tokens(_token)


def codes(text: str) -> list[int]:
    """Word codes of a text, END after each sentence."""
    out: list[int] = []
    for line in text.splitlines():
        for part in _tokens.of(line):
            out += part
        out.append(END)
    return out


class Words:
    """The words of a batch of documents, as arrays."""

    def __init__(self, batch: pa.RecordBatch, places: int):
        column = batch.column(batch.schema.get_field_index("codes"))
        offsets = column.offsets.to_numpy()
        values = column.flatten().to_numpy(zero_copy_only=False)
        word = values != END
        before = np.concatenate([[True], ~word[:-1]]) if len(values) else np.zeros(0, bool)
        self.bounds = np.concatenate([[0], np.cumsum(word)])[offsets - offsets[0]]
        self.codes, self.first = values[word], before[word]
        self.sizes = np.diff(self.bounds)
        self.sentence = np.cumsum(self.first)
        prior = np.where(self.first, 0, np.roll(self.codes, 1)) if len(self.codes) else self.codes
        #: places of the words and of the pairs with the word before; the first word of a sentence pairs with nothing
        self.places = self.codes & (places - 1), ((prior * np.int64(0x9E3779B1) + self.codes * np.int64(40503)) >> 7) & (places - 1)

    def scores(self, odds: np.ndarray) -> np.ndarray:
        words, pairs = self.places
        own = odds[0][words]
        return np.where(self.first, own, (own + odds[1][pairs]) / 2).astype(float) - COST

    def best(self, scores: np.ndarray) -> np.ndarray:
        """Score of the best segment of each document, 0 without a positive word."""
        out, some = np.zeros(len(self.sizes)), self.sizes > 0
        if len(scores):
            # a drop before each document makes its first word the new least sum
            drop = np.zeros(len(scores) + 1)
            drop[self.bounds[:-1][some]] = 1e5
            sums = np.cumsum(np.column_stack([-drop[:-1], scores]).ravel())
            rise = sums[1::2] - np.minimum.accumulate(sums)[::2]
            out[some] = np.maximum(0, np.maximum.reduceat(rise, self.bounds[:-1][some]))
        return out


def _rolled(codes_: np.ndarray, n: int) -> np.ndarray:
    """One number for each run of n codes."""
    out = codes_[: max(0, len(codes_) - n + 1)]
    for k in range(1, n):
        out = out * np.int64(1000003) + codes_[k : k + len(out)]
    return out


def lexicon_numbers(entries: list[list[str]]) -> dict[int, np.ndarray]:
    by: dict[int, set[int]] = {}
    for words in entries:
        by.setdefault(len(words), set()).add(int(_rolled(np.array([zlib.crc32(w.encode()) for w in words], np.int64), len(words))[0]))
    return {n: np.array(sorted(v), np.int64) for n, v in by.items()}


def seeded(words: Words, sure: dict[int, np.ndarray], ambiguous: dict[int, np.ndarray]) -> np.ndarray:
    """Which words stand in a sentence with a sure entry of the lexicon, or with two ambiguous ones."""
    hits = np.zeros(words.sentence[-1] + 1 if len(words.sentence) else 1, int)
    for numbers, weight in ((sure, 2), (ambiguous, 1)):
        for n, wanted in numbers.items():
            runs = _rolled(words.codes, n)
            table = np.zeros(1 << 16, bool)
            table[wanted & 0xFFFF] = True
            spots = table[runs & 0xFFFF].nonzero()[0]
            spots = spots[np.isin(runs[spots], wanted)]
            np.add.at(hits, words.sentence[spots[words.sentence[spots] == words.sentence[spots + n - 1]]], weight)
    return hits[words.sentence] > 1


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before = i, total
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, before, total))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Model:
    """Log-odds of the places, lambda and K."""

    def __init__(self, odds: np.ndarray, rate: float = 1.0, k: float = 1.0):
        self.odds, self.rate, self.k = odds, rate, k

    def significant(self, words: Words, expected: float) -> Iterator[tuple[int, int, list[tuple[int, int, float, float]]]]:
        """(document, its first word, segments (start, end, score, expectation up to expected)) of the documents that have such.

        A segment scores no more than the best one of its document, so documents whose best one isn't good enough are passed over.
        """
        scores = words.scores(self.odds)
        chance = self.k * np.maximum(words.sizes, 1) * np.exp(-self.rate * words.best(scores))
        for d in (chance <= expected).nonzero()[0]:
            a, b = words.bounds[d], words.bounds[d + 1]
            found = [(x, y, s, float(self.k * (b - a) * math.exp(-self.rate * s))) for x, y, s in segments(scores[a:b])]
            yield d, a, [f for f in found if f[3] <= expected]

    def marked(self, words: Words, expected: float) -> np.ndarray:
        """Which words stand in a segment of at most this expectation."""
        out = np.zeros(len(words.codes), bool)
        for _, a, found in self.significant(words, expected):
            for x, y, _, _ in found:
                out[a + x : a + y] = True
        return out


def joint(expectations: list[float]) -> float:
    """Least expectation of the best r segments together, over r, each further one at the cost of a factor of 2."""
    best, total = 1.0, 0.0
    for r, e in enumerate(sorted(expectations), 1):
        total -= math.log(max(e, 1e-300))
        if total > 0:
            best = min(best, math.exp(min(0.0, (r - 1) * math.log(2 * total) - total - math.lgamma(r + 1) - math.lgamma(r))))
    return best


def log_odds(toxic: np.ndarray, both: np.ndarray, sample: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """(kind, place) from counts (kind, place) in the sample and in all texts, which need be known only where the sample has any.

    Priors are in proportion to the whole corpus, so places that the sample doesn't have all get the same odds.
    """
    out = np.zeros(toxic.shape, np.float32)
    for kind in (0, 1):
        t, n = max(1.0, sample[kind]), max(2.0, corpus[kind])
        known = np.maximum(both[kind], 1)
        prior = PRIOR * t * known / n
        calm, marked = both[kind] - toxic[kind] + prior, toxic[kind] + prior
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log(marked / (t * (1 + PRIOR))) - np.log(calm / (n - t + PRIOR * t))
        # what the background holds as often can't count for much, however small the toxic sample is
        most = np.log((toxic[kind] + 0.5) / (both[kind] - toxic[kind] + 0.5)) + BALANCE
        never = math.log(PRIOR / (1 + PRIOR)) - math.log1p((PRIOR - 1) * t / n)
        out[kind] = np.where(toxic[kind] > 0, np.clip(np.minimum(np.nan_to_num(odds, nan=LOW), most), LOW, HIGH), never)
    return out


def solve_lambda(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive solution of sum p exp(lambda s) = 1; 1 if there is none (no positive score, or a mean not under 0)."""
    if not len(scores) or scores.max() <= 0 or (scores * chances).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (chances * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (chances * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return (low + high) / 2


Mark = Callable[[Words], np.ndarray]


def _sampled(batches: Iterator[pa.RecordBatch], mark: Mark, places: int) -> Iterator[pd.DataFrame]:
    """Counts of the places in marked words (kind 0 and 1); kinds 2 and 3: marked words and pairs, 4 and 5: all of them."""
    counts, sums = np.zeros((2, places), np.int64), np.zeros(4, np.int64)
    for batch in batches:
        words = Words(batch, places)
        toxic = mark(words)
        pair = ~words.first
        sums += [toxic.sum(), (toxic & pair).sum(), len(toxic), pair.sum()]
        counts[0] += np.bincount(words.places[0][toxic], minlength=places)
        counts[1] += np.bincount(words.places[1][toxic & pair], minlength=places)
    kind, place = counts.nonzero()
    yield pd.DataFrame({"kind": [*kind, 2, 3, 4, 5], "place": [*place, 0, 0, 0, 0], "n": [*counts[kind, place], *sums]})


def _totals(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pd.DataFrame]:
    """Counts of the wanted places in all words."""
    places = wanted.shape[1]
    counts = np.zeros((2, places), np.int64)
    for batch in batches:
        words = Words(batch, places)
        for kind, of in enumerate((words.places[0], words.places[1][~words.first])):
            counts[kind] += np.bincount(of[wanted[kind][of]], minlength=places)
    kind, place = counts.nonzero()
    yield pd.DataFrame({"kind": kind, "place": place, "n": counts[kind, place]})


def _calm(batches: Iterator[pa.RecordBatch], mark: Mark, odds: np.ndarray) -> Iterator[pd.DataFrame]:
    """Histograms of the background: scores of words (kind 0); best segments of documents, in documents (1) and in words (2)."""
    bins: dict[tuple[int, int], float] = {}

    def add(kind: int, at: np.ndarray, weight: np.ndarray | None = None) -> None:
        values, where = np.unique(np.round(at / BIN).astype(int), return_inverse=True)
        for b, n in zip(values, np.bincount(where, weight, len(values)), strict=True):
            bins[kind, int(b)] = bins.get((kind, int(b)), 0.0) + float(n)

    for batch in batches:
        words = Words(batch, odds.shape[1])
        toxic, scores = mark(words), words.scores(odds)
        add(0, scores[~toxic])
        held = np.concatenate([[0], np.cumsum(toxic)])
        calm = (words.sizes > 0) & (held[words.bounds[1:]] == held[words.bounds[:-1]])
        best = words.best(scores)[calm]
        add(1, best)
        add(2, best, words.sizes[calm])
    yield pd.DataFrame({"kind": [k for k, _ in bins], "place": [b for _, b in bins], "n": list(bins.values())})


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        yield pa.RecordBatch.from_arrays([pa.array(frame.kind.to_numpy(np.int64)), pa.array(frame.place.to_numpy(np.int64)), pa.array(frame.n.to_numpy(float))], names=["kind", "place", "n"])


def _summed(coded: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pd.DataFrame]]) -> pd.DataFrame:
    """Sums of n by kind and place over all tasks."""
    found = coded.select("codes").mapInArrow(lambda batches: _batches(run(batches)), "kind bigint, place bigint, n double")
    return found.groupBy("kind", "place").agg(F.sum("n").alias("n")).toPandas()


def learn(coded: DataFrame, lexicon: str, ambiguous: str, rounds: int, places: int, sampled: float) -> Model | None:
    """The model of the last round; None without any toxic sentence.

    A round reads the word codes three times: the sample's counts, those of its places in all texts, and the background's
    histograms. Only places of the sample are shuffled and go to the driver, at most 2 * places numbers.
    """
    context, numbers = coded.sparkSession.sparkContext, (lexicon_numbers(phrases(lexicon)), lexicon_numbers(phrases(ambiguous)))
    mark: Mark = lambda words: seeded(words, *numbers)
    model = None
    for _ in range(rounds):
        counts = _summed(coded, lambda batches, mark=mark: _sampled(batches, mark, places))
        sums = [counts.n[counts.kind == k].sum() for k in range(2, 6)]
        if not sums[0]:
            return model
        toxic, both = np.zeros((2, places)), np.zeros((2, places))
        part = counts[counts.kind < 2]
        toxic[part.kind, part.place] = part.n
        wanted = context.broadcast(toxic > 0)
        all_ = _summed(coded, lambda batches, wanted=wanted: _totals(batches, wanted.value))
        both[all_.kind, all_.place] = all_.n
        odds = context.broadcast(log_odds(toxic, both, np.array(sums[:2]), np.array(sums[2:])))
        bins = _summed(coded, lambda batches, mark=mark, odds=odds: _calm(batches, mark, odds.value))
        words, best, sizes = ({int(p): n for p, n in zip(b.place, b.n, strict=True)} for b in (bins[bins.kind == k] for k in range(3)))
        values = np.array(list(words), float) * BIN
        rate = solve_lambda(values, np.array(list(words.values())) / max(1.0, sum(words.values())))
        over = sum(n * math.exp(-rate * b * BIN) for b, n in sizes.items())
        model = Model(odds.value, rate, sum(best.values()) / over if over else 1.0)
        shared = context.broadcast(model)
        mark = lambda words, shared=shared: shared.value.marked(words, sampled)
    return model


def score(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", expected: float = EXPECTED, lexicon: str = LEXICON, ambiguous: str = AMBIGUOUS, rounds: int = ROUNDS, places: int = PLACES, sampled: float = SAMPLED) -> DataFrame:
    """key, source, score, expectation, flagged, segments of every document.

    segments: first word, word after the last, score, expectation of every segment expected less than once; expectation: of
    them together; score: its negative logarithm.
    """
    spark = documents.sparkSession
    base = spread(documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")))
    kinds = f"key {base.schema['key'].dataType.simpleString()}, source string"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes(t) if t else [] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["key", "source", "codes"])

    coded = stored(base.mapInArrow(code, f"{kinds}, codes array<bigint>"), "coded")
    model = learn(coded, lexicon, ambiguous, rounds, places, sampled)
    if model is None:
        none = F.lit(None).cast("array<struct<first:int,last:int,score:double,expectation:double>>")
        return coded.select(F.col("key").alias(key), "source", F.lit(0.0).alias("score"), F.lit(1.0).alias("expectation"), F.lit(False).alias("flagged"), none.alias("segments"))
    shared = spark.sparkContext.broadcast(model)  # 2 * places numbers, whatever the corpus

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch, places)
            all_, chance = [[] for _ in range(batch.num_rows)], np.ones(batch.num_rows)
            for d, _, found in shared.value.significant(words, 1.0):
                all_[d] = [{"first": int(x), "last": int(y), "score": float(s), "expectation": e} for x, y, s, e in found]
                chance[d] = joint([e for *_, e in found])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(-np.log(chance) + 0.0), pa.array(chance), pa.array(chance <= expected), pa.array(all_, kind)], names=["key", "source", "score", "expectation", "flagged", "segments"])

    schema = f"{kinds}, score double, expectation double, flagged boolean, segments array<struct<first:int,last:int,score:double,expectation:double>>"
    return coded.mapInArrow(judge, schema).withColumnRenamed("key", key)


def rates(scored: DataFrame) -> DataFrame:
    """documents, flagged and their share by source."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged")).withColumn("share", F.col("flagged") / F.col("documents"))
