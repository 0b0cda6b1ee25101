"""Records of evaluation splits that also stand in the training split, exactly or almost.

Texts are folded (look-alike letters, widths, accents, case, punctuation, spaces, common chat spellings set
aside) to words; equal folded texts are one class. A training and an evaluation class are a pair if their longest
common subsequence of words holds ``share`` of the longer text's words. Candidates come from a prefix filter that is exact for
that rule: the words of each text, repeats numbered, go from rare to common, and all alike texts have one of their
first words in common, however common the rest is. Texts whose first words are all rare are joined at them; the others
are held against each other by sketches, which needs one row a text on disk. Candidates are then held against each other word by word.

For the coverage, the passages of the evaluation classes (runs of words that overlap by half) are put into
Aho-Corasick automata, sharded by a fixed number of passages, which scan the folded training texts once. Matched
intervals are merged into the coverage of each evaluation record.

Defined results: null and blank ids match nothing; rows with null or blank text, or without any word,
match by id only; rows of other splits than given are left out; repeated rows each give their pairs.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import spread, stored
from .unify import Tokens, skeleton

TRAIN, EVALUATION = ("train",), ("val", "test")
SHARE = 0.75
#: Evaluation texts in one piece that is held against training texts, and how many such pieces of training texts a task holds.
PIECE, PIECES = 4_000, 10
#: Pairs at a word up to which rows are joined one by one.
LIGHT = 20_000
#: Pairs that are compared at once, and of how many evaluation texts.
BLOCK, TALL = 1 << 17, 16
#: Hashed places of the counts that put words in order.
PLACES = 1 << 18
#: Bits of a text's parity sketch, and the longs that hold them.
SKETCH, LONGS = 512, 8
#: Two longs of a sketch are looked at first, and one more for so many words of the text.
TOLD = 34
#: Words above which a text has a wide sketch too, of as many more bits as it has more words.
WIDE = 256
#: Words in a passage by the number of words of the record: (from, words).
PASSAGE = ((30, 5), (12, 3), (6, 2), (0, 1))
#: Passages in one automaton.
SHARD = 40_000
#: Characters of training text that a task holds while it goes through the automata.
HELD = 16_000_000
BLANKS = r"^[\s\p{Z}\p{Cc}\p{Cf}]*$"
# Chat spellings of Vietnamese and English words, "spelling word" after folding.
CHAT = dict(
    pair.split(" ", 1)
    for pair in (
        "ko khong|k khong|kh khong|hok khong|hong khong|khum khong|kg khong|hem khong|dc duoc|dk duoc|mk minh|mik minh|mn moi nguoi|bt biet|bit biet|"
        "vs voi|j gi|r roi|rui roi|oy roi|ntn nhu the nao|tks cam on|thks cam on|ng nguoi|nch noi chuyen|cx cung|cg cung|cug cung|ms moi|lm lam|trc truoc|"
        "hnay hom nay|hqua hom qua|bh bay gio|bg bay gio|gd gia dinh|ae anh em|ck chong|vk vo|ny nguoi yeu|nyc nguoi yeu cu|sn sinh nhat|"
        "u you|ur your|im i m|ive i ve|pls please|plz please|thx thanks|ppl people|bc because|cuz because|rn right now|tho though|thru through"
    ).split("|")
)
_WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{N}]+")
_MARKS = regex.compile(r"\p{Mn}+")
_APOSTROPHE = regex.compile(r"['’`]")
_LONG = regex.compile(r"(\p{L})\1{2,}")


def _folded_token(token: str) -> str:
    plain = unicodedata.normalize("NFKD", skeleton(token)).casefold()
    plain = _MARKS.sub("", plain).replace("đ", "d").replace("ı", "i")
    plain = _LONG.sub(r"\1", _APOSTROPHE.sub("", plain))
    return " ".join(CHAT.get(w, w) for w in _WORDS.findall(plain))


_tokens = Tokens(_folded_token)


def fold(text: str) -> str:
    """Folded words joined by single spaces."""
    return " ".join(filter(None, _tokens.of(text)))


def places(n: int) -> tuple[int, list[int]]:
    """(words in a passage, where the passages of a text of n words start): half overlapping, to the last word."""
    size = next(k for least, k in PASSAGE if n >= least)
    starts = list(range(0, n - size + 1, (size + 1) // 2)) or [0]
    return size, starts if starts[-1] + size >= n else [*starts, n - size]


def passages(words: list[str]) -> list[str]:
    size, starts = places(len(words))
    return [" " + " ".join(words[s : s + size]) + " " for s in starts]


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if (m := at.get(w)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str, share: float = SHARE) -> bool:
    """Whether share of the longer text's words stand in the other in the same order."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    need = share * max(len(x), len(y))
    return min(len(x), len(y)) >= need and (Counter(x) & Counter(y)).total() >= need and common(x, y) >= need


def folded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, class, folded of the rows that have words."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame.iloc[:, 0], "folded": [fold(t) for t in frame.iloc[:, 1]]})

    some = spread(rows.select(key, text)).filter(F.col(text).isNotNull() & ~F.col(text).rlike(BLANKS))
    done = some.mapInPandas(run, f"key {kind}, folded string").filter("folded <> ''")
    return done.select("key", F.unhex(F.substring(F.sha2("folded", 256), 1, 32)).alias("class"), "folded")


class Shards:
    """The passages of the evaluation classes, in shards of a fixed number, as a stored table that tasks read by shard."""

    def __init__(self, records: DataFrame, shard: int):
        """records: class, folded, one row a class."""

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for cls, text in zip(frame["class"], frame.folded, strict=True):
                    words = text.split(" ")
                    size, starts = places(len(words))
                    out += [(cls, s, min(s + size, len(words)), p) for s, p in zip(starts, passages(words), strict=True)]
                yield pd.DataFrame(out, columns=["class", "start", "end", "passage"])

        each = records.select("class", "folded").mapInPandas(cut, "class binary, start int, end int, passage string").withColumn("id", F.xxhash64("passage"))
        each = stored(each, "passages")
        self.of = each.select("class", "start", "end", "id")
        texts = each.select("passage", "id").distinct()
        self.number = max(1, -(-texts.count() // shard))
        self.path = self._write(texts)

    def _write(self, texts: DataFrame) -> str | None:
        files = stored(texts.withColumn("shard", F.pmod("id", F.lit(self.number)).cast("int")), "automata", ["shard"]).inputFiles()
        return files[0].rsplit("/shard=", 1)[0] if files else None


def _automaton(path: str, shard: int):
    """The automaton of one shard; None for an empty one."""
    import ahocorasick
    import pyarrow.fs
    import pyarrow.parquet as pq

    where, root = pyarrow.fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    folder = f"{root}/shard={shard}"
    if where.get_file_info(folder).type == pyarrow.fs.FileType.NotFound:
        return None
    rows = pq.read_table(folder, columns=["passage", "id"], filesystem=where, partitioning=None)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for text, number in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        automaton.add_word(text, number)
    automaton.make_automaton()
    return automaton


def scan(texts: DataFrame, path: str | None, number: int, held: int = HELD) -> DataFrame:
    """id: which passages stand in any of the texts (class, folded), each once.

    A task holds a bounded piece of its texts and one automaton at a time.
    """
    schema = "id bigint"
    if path is None:
        return texts.sparkSession.createDataFrame([], schema)

    def through(kept: list[str]) -> Iterator[pd.DataFrame]:
        for shard in range(number):
            if (automaton := _automaton(path, shard)) is None:
                continue
            found = {p for text in kept for _, p in automaton.iter(f" {text} ")}
            yield pd.DataFrame({"id": list(found)}, dtype="int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0
        for frame in frames:
            for text in frame.folded:
                kept.append(text)
                size += len(text)
                if size >= held:
                    yield from through(kept)
                    kept, size = [], 0
        if kept:
            yield from through(kept)

    return texts.select("folded").mapInPandas(run, schema).distinct()


def _ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (not negative) of the words of all texts, repeats in a text numbered so that they differ, and where each text begins and ends in them."""
    each = [t.split(" ") for t in texts]
    bounds = np.cumsum([0, *map(len, each)])
    codes, known = pd.factorize(np.array([w for words in each for w in words], dtype=object))
    own = np.repeat(np.arange(len(each)), np.diff(bounds)) * len(known) + codes
    order = np.argsort(own, kind="stable")
    first = np.concatenate([[True], own[order][1:] != own[order][:-1]])[: len(own)]
    at = np.arange(len(own))
    times = np.empty(len(own), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return (pd.util.hash_array(known, categorize=False)[codes] + times * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64), bounds


def _chunks(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Some rows (class, folded) at a time with their _ids()."""
    for whole in frames:
        for start in range(0, len(whole), rows):
            frame = whole.iloc[start : start + rows]
            yield frame, *_ids(list(frame.folded))


def _counted(texts: DataFrame) -> np.ndarray:
    """How many numbered words of texts (class, folded) fall on each of PLACES places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(PLACES, np.int64)
        for _, ids, _ in _chunks(frames, 5000):
            counts += np.bincount(ids % PLACES, minlength=PLACES)
        place = counts.nonzero()[0]
        yield pd.DataFrame({"place": place, "n": counts[place]})

    summed = texts.select("folded").mapInPandas(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(PLACES, np.int64)
    out[summed.place] = summed.n
    return out


def _first(size, share: float):
    """So many of the rarest words of a text of size words that it and any alike one have one of theirs in common."""
    return size - np.ceil(share * size - 1e-9).astype(np.int64) + 1


def _sketched(texts: DataFrame, shared, share: float, light: int) -> DataFrame:
    """class, words, heavy, s0.., wide of each row: parity sketches of all words, wide ones (else null) for texts of more than WIDE words.

    heavy: at one of the text's first words more than light pairs can meet.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, m = shared.value
        heavy = n * m > light
        for frame, ids, bounds in _chunks(frames):
            size = np.diff(bounds)
            row, bits = np.repeat(np.arange(len(size)), size), ids // PLACES
            odd = (np.bincount(row * SKETCH + bits % SKETCH, minlength=len(size) * SKETCH) & 1).astype(np.uint8)
            sketch = np.packbits(odd).view(np.int64).reshape(-1, LONGS)
            rare = size - np.bincount(row, heavy[ids % PLACES], len(size)).astype(np.int64)
            wide: list[bytes | None] = [None] * len(size)
            for r in (size > WIDE).nonzero()[0]:
                most = SKETCH << math.ceil(math.log2(size[r] / WIDE))
                wide[r] = np.packbits((np.bincount(bits[bounds[r] : bounds[r + 1]] % most, minlength=most) & 1).astype(np.uint8)).tobytes()
            columns = {"class": frame["class"].to_numpy(), "words": size, "heavy": rare < _first(size, share)} | {f"s{k}": sketch[:, k] for k in range(LONGS)}
            yield pd.DataFrame(columns | {"wide": pd.Series(wide, dtype=object)})

    longs = ", ".join(f"s{k} bigint" for k in range(LONGS))
    return texts.select("class", "folded").mapInPandas(run, f"class binary, words int, heavy boolean, {longs}, wide binary")


def _light(texts: DataFrame, shared, share: float, light: int, every: bool) -> DataFrame:
    """id, ref, words, place, heavy: the first words of each text (ref: hash of its class) at which at most light pairs can meet.

    place counts from the rarest word. Words whose place only one side has come first: they count, but match nothing and
    are left out. every: of heavy texts too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, m = shared.value
        rank = n * m
        for frame, ids, bounds in _chunks(frames):
            ranks, refs, parts = rank[ids % PLACES], frame.ref.to_numpy(), []
            for ref, a, b in zip(refs, bounds[:-1], bounds[1:], strict=True):
                mine, own = ids[a:b], ranks[a:b]
                first = np.lexsort((mine, own))[: _first(b - a, share)]
                heavy = own[first[-1]] > light
                if every or not heavy:
                    place = ((own[first] > 0) & (own[first] <= light)).nonzero()[0]
                    parts.append(pd.DataFrame({"id": mine[first[place]], "ref": ref, "words": b - a, "place": place, "heavy": heavy}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    rows = texts.select(F.xxhash64("class").alias("ref"), F.lit(None).cast("binary").alias("class"), "folded")
    return rows.mapInPandas(run, "id bigint, ref bigint, words int, place int, heavy boolean")


class _Side:
    """Sketches of some texts as arrays, in order of their sizes."""

    def __init__(self, rows):
        """rows: Arrow table of what _sketched() gives."""
        rows = rows.filter(rows["heavy"]).sort_by("words")
        self.words, self.cls, self.wide = rows["words"].to_numpy(), rows["class"], rows["wide"]
        self.sketch = [rows[f"s{k}"].to_numpy().view(np.uint64) for k in range(LONGS)]


def _apart(x: bytes, y: bytes) -> int:
    """Places in which two wide sketches differ, the longer one folded to the length of the shorter."""
    u, v = int.from_bytes(x), int.from_bytes(y)
    size, other = len(x) * 8, len(y) * 8
    while size > other:
        size //= 2
        u = u >> size ^ u & (1 << size) - 1
    while other > size:
        other //= 2
        v = v >> other ^ v & (1 << other) - 1
    return (u ^ v).bit_count()


def _meet(a: _Side, b: _Side, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in a and b of the pairs that can be alike by their sizes and sketches.

    For some rows of b at a time those of a are looked at whose sizes fit. So much of the sketches as tells texts of that
    size apart drops most of them; the rest of the sketches is held against each other only for those that are left.
    """
    left, right = [np.array([], np.int64)], [np.array([], np.int64)]
    across = BLOCK // TALL
    space = np.empty(BLOCK, np.uint64), np.empty(BLOCK, np.uint8), np.empty(BLOCK, np.uint16)
    spans = []
    for at in range(0, len(b.words), TALL):
        own = b.words[at : at + TALL]
        low, high = np.searchsorted(a.words, share * own[0] - 1e-9), np.searchsorted(a.words, own[-1] / share + 1e-9, "right")
        spans += [(at, own, begin, min(high, begin + across)) for begin in range(low, high, across)]
    for at, own, low, high in spans:
        size = a.words[low:high]
        differ, more, apart = (x[: len(own) * len(size)].reshape(len(own), len(size)) for x in space)
        most = np.clip(size + own[-1] - 2 * share * np.maximum(size, own[0]) + 1e-6, 0, SKETCH).astype(np.uint16)
        longs = min(LONGS, 2 + int(own[-1]) // TOLD)
        for k in range(longs):
            np.bitwise_xor(a.sketch[k][low:high], b.sketch[k][at : at + TALL, None], out=differ)
            np.bitwise_count(differ, out=more)
            if k:
                np.add(apart, more, out=apart)
            else:
                np.copyto(apart, more)
        flat = np.flatnonzero(apart <= most)
        j, i = np.divmod(flat, len(size))
        apart, i, j = apart.ravel()[flat].astype(np.int32), i + low, j + at
        x, y = a.words[i], b.words[j]
        most = x + y - 2 * (share * np.maximum(x, y) - 1e-9)
        still = (apart <= most) & (np.minimum(x, y) >= share * np.maximum(x, y) - 1e-9)
        i, j, apart, most = i[still], j[still], apart[still], most[still]
        for k in range(longs, LONGS):
            apart += np.bitwise_count(a.sketch[k][i] ^ b.sketch[k][j])
            still = apart <= most
            i, j, apart, most = i[still], j[still], apart[still], most[still]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    long = ((a.words[i] > WIDE) & (b.words[j] > WIDE)).nonzero()[0]
    good = np.ones(len(i), bool)
    for k in long:
        x, y = a.words[i[k]], b.words[j[k]]
        good[k] = _apart(a.wide[int(i[k])].as_py(), b.wide[int(j[k])].as_py()) <= x + y - 2 * (share * max(x, y) - 1e-9)
    return i[good], j[good]


def _read(file: str, rows: int):
    """The rows of a stored file, so many at a time, as Arrow tables."""
    import pyarrow as pa
    import pyarrow.fs
    import pyarrow.parquet as pq

    where, path = pyarrow.fs.FileSystem.from_uri(file.replace("file:///", "file:/").replace("file:/", "file:///"))
    with where.open_input_file(path) as opened:
        for batch in pq.ParquetFile(opened).iter_batches(rows):
            yield pa.Table.from_batches([batch])


def _held(a: DataFrame, b: DataFrame, share: float, shard: int) -> DataFrame:
    """train_class, class of the heavy texts of stored sketches a and b that can be alike: each file of a is held against all of b, a piece at a time, read where they are stored."""
    old, new = a.inputFiles(), b.inputFiles()
    schema = "train_class binary, class binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number in (k for frame in frames for k in frame.id):
            for mine in map(_Side, _read(old[number], PIECES * shard)):
                for other in (_Side(rows) for file in new for rows in _read(file, shard)):
                    i, j = _meet(mine, other, share)
                    yield pd.DataFrame({"train_class": mine.cls.take(i).to_pylist(), "class": other.cls.take(j).to_pylist()}, dtype=object)

    return a.sparkSession.range(0, len(old), 1, max(1, len(old))).mapInPandas(run, schema)


def candidates(train: DataFrame, records: DataFrame, parts: int, share: float = SHARE, shard: int = PIECE, light: int = LIGHT) -> DataFrame:
    """train_class, class: every pair that can be alike by its sizes and words; none that alike() takes is left out.

    Alike texts have share of the longer one's words in common, repeats counted. So whatever the order of the
    words, the two share one among the first size - share * size + 1 of each. The order is from rare to common, by counts
    of a fixed number of hashed places that go to the driver. Texts with a first word at which more than light pairs can
    meet are heavy. Heavy texts of both sides are held against each other by size and sketch, as arrays that tasks read
    from one stored row a text, so that no row is repeated on disk however many pairs meet. All other pairs have a first
    word in common at which no more than light pairs meet, and are joined. Pairs stay if the sketches differ in no more places than the words can.
    train, records: class, folded; rows of one class may repeat.
    """
    shared = train.sparkSession.sparkContext.broadcast((_counted(train), _counted(records)))
    columns = ("words", "heavy", *(f"s{k}" for k in range(LONGS)), "wide")

    def side(texts: DataFrame, name: str) -> DataFrame:
        each = _sketched(texts, shared, share, light).repartition(parts, "class")
        return stored(each.groupBy("class").agg(F.first(F.struct(*columns)).alias("of")).select("class", "of.*"), name)

    a, b = side(train, "sketches"), side(records, "sketches")
    some_a, some_b = (not x.filter("NOT heavy").isEmpty() for x in (a, b))
    hot = _held(a, b, share, shard)
    if not some_a and not some_b:
        return hot
    need = lambda x, y: f"({share}D * greatest({x}.words, {y}.words) - 1e-9D)"
    x, y = _light(train, shared, share, light, some_b).alias("x"), _light(records, shared, share, light, some_a).alias("y")
    on = F.expr(f"x.id = y.id AND NOT (x.heavy AND y.heavy) AND least(x.words - x.place, y.words - y.place) >= {need('x', 'y')}")
    met = x.join(y, on).select(F.col("x.ref").alias("ref"), F.col("y.ref").alias("other")).distinct()
    a, b = a.withColumn("ref", F.xxhash64("class")).alias("a"), b.withColumn("other", F.xxhash64("class")).alias("b")
    differ = " + ".join(f"bit_count(a.s{k} ^ b.s{k})" for k in range(LONGS))
    fit = F.expr(f"least(a.words, b.words) >= {need('a', 'b')} AND {differ} <= a.words + b.words - 2 * {need('a', 'b')}")
    rare = met.join(b, "other").join(a, "ref").filter(fit).select(F.col("a.class").alias("train_class"), F.col("b.class").alias("class"))
    return rare.unionByName(hot).distinct()


def near(rows: DataFrame, key: str = "row_id", text: str = "text", split: str = "split_name", train: tuple[str, ...] = TRAIN, evaluation: tuple[str, ...] = EVALUATION, share: float = SHARE, shard: int = PIECE, light: int = LIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of classes train_class, class; members train_class, key; members class, key)."""
    old = stored(folded(rows.filter(F.col(split).isin(list(train))), key, text), "train")
    new = stored(folded(rows.filter(F.col(split).isin(list(evaluation))), key, text), "evaluation")
    size = old.agg(F.sum(F.length("folded"))).first()[0] or 0
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // HELD))
    pairs = stored(candidates(old, new, parts, share, shard, light), "candidates")
    # one text of each class that a candidate has
    one = lambda df, cls: df.join(pairs.select(F.col(cls).alias("class")).distinct(), "class", "left_semi").groupBy("class").agg(F.first("folded").alias("folded"))
    old_texts, new_texts = one(old, "train_class"), one(new, "class")
    joined = pairs.join(new_texts, "class").join(old_texts.select(F.col("class").alias("train_class"), F.col("folded").alias("train_folded")), "train_class")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [alike(a, b, share) for a, b in zip(frame.folded, frame.train_folded, strict=True)]
            yield frame.loc[good, ["train_class", "class"]]

    verified = stored(joined.mapInPandas(verify, "train_class binary, class binary"), "near")
    return verified, old.select(F.col("class").alias("train_class"), F.col("key").alias("train_key")), new.select("class", "key")


def same_id(rows: DataFrame, key: str, ident: str, split: str, train: tuple[str, ...] = TRAIN, evaluation: tuple[str, ...] = EVALUATION) -> DataFrame:
    named = rows.filter(F.col(ident).isNotNull() & ~F.col(ident).rlike(BLANKS)).select(F.col(key).alias("key"), F.col(ident).alias("ident"), split)
    a, b = named.filter(F.col(split).isin(list(train))), named.filter(F.col(split).isin(list(evaluation)))
    return a.select("ident", F.col("key").alias("train_key")).join(b.select("ident", "key"), "ident").select("train_key", "key")


def overlaps(rows: DataFrame, key: str = "row_id", ident: str = "post_id", text: str = "text", split: str = "split_name", **options) -> DataFrame:
    """train_key, key: every pair of a training and an evaluation row with the same id or nearly the same text."""
    classes, old, new = near(rows, key, text, split, **options)
    by_text = classes.join(old, "train_class").join(new, "class").select("train_key", "key")
    return by_text.unionByName(same_id(rows, key, ident, split, options.get("train", TRAIN), options.get("evaluation", EVALUATION))).distinct()


def coverage(rows: DataFrame, key: str = "row_id", text: str = "text", split: str = "split_name", train: tuple[str, ...] = TRAIN, evaluation: tuple[str, ...] = EVALUATION, shard: int = SHARD, **options) -> DataFrame:
    """key, partners, covered of each evaluation record: near training rows, and the share of its words that lie in passages of any training texts.

    The passages of records of fewer than 30 words are shorter (PASSAGE), single words under 6, so common phrases cover more of them.
    """
    classes, old, new = near(rows, key, text, split, train, evaluation, **options)
    one = lambda splits: stored(folded(rows.filter(F.col(split).isin(list(splits))), key, text).groupBy("class").agg(F.first("folded").alias("folded")), "texts")
    words = one(evaluation)
    shards = Shards(words, shard)
    spans = shards.of.join(scan(spread(one(train)), shards.path, shards.number), "id").select("class", "start", "end").distinct()
    reach = F.max("end").over(W.partitionBy("class").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    merged = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0)))))
    covered = merged.groupBy("class").agg(F.sum("fresh").alias("words_covered"))
    sizes = words.select("class", F.size(F.split("folded", " ")).alias("words"))
    partners = classes.join(old, "train_class").groupBy("class").agg(F.count("*").alias("partners"))
    joined = new.join(sizes, "class").join(covered, "class", "left").join(partners, "class", "left")
    return joined.select(F.col("key").alias(key), F.coalesce("partners", F.lit(0)).alias("partners"), (F.coalesce("words_covered", F.lit(0)) / F.col("words")).alias("covered"))


def partners(rows: DataFrame, key: str = "row_id", ident: str = "post_id", text: str = "text", split: str = "split_name", **options) -> DataFrame:
    """key, class, pairs of each evaluation row: its class of equal folded texts (null without words) and how many training rows overlap it.

    Counted from classes and their sizes; the pairs themselves are not made. Rows that overlap by id and by text count once.
    """
    train, evaluation = options.get("train", TRAIN), options.get("evaluation", EVALUATION)
    classes, old, new = near(rows, key, text, split, **options)
    asked = rows.filter(F.col(split).isin(list(evaluation))).select(F.col(key).alias("key"), F.when(~F.col(ident).rlike(BLANKS), F.col(ident)).alias("ident")).distinct()
    given = rows.filter(F.col(split).isin(list(train))).select(F.col(key).alias("train_key"), F.when(~F.col(ident).rlike(BLANKS), F.col(ident)).alias("ident")).distinct()
    asked, given = asked.join(new.distinct(), "key", "left"), given.join(old.distinct(), "train_key", "left")
    sizes = given.groupBy("train_class").agg(F.count("*").alias("n"))
    by_text = classes.join(sizes, "train_class").groupBy("class").agg(F.sum("n").alias("by_text"))
    by_id = given.filter("ident IS NOT NULL").groupBy("ident").agg(F.count("*").alias("by_id"))
    held = given.filter("ident IS NOT NULL AND train_class IS NOT NULL").groupBy("ident", "train_class").agg(F.count("*").alias("n"))
    own = asked.filter("ident IS NOT NULL AND class IS NOT NULL").select("ident", "class").distinct()
    both = own.join(held, "ident").join(classes, ["train_class", "class"]).groupBy("ident", "class").agg(F.sum("n").alias("both"))
    joined = asked.join(by_text, "class", "left").join(by_id, "ident", "left").join(both, ["ident", "class"], "left")
    pairs = F.coalesce("by_text", F.lit(0)) + F.coalesce("by_id", F.lit(0)) - F.coalesce("both", F.lit(0))
    return joined.select("key", "class", pairs.alias("pairs"))


def report(rows: DataFrame, key: str = "row_id", ident: str = "post_id", text: str = "text", split: str = "split_name", source: str = "source", **options) -> DataFrame:
    """split, source, rows, overlapping rows and pairs of the evaluation splits, from counts."""
    evaluation = options.get("evaluation", EVALUATION)
    by_row = partners(rows, key, ident, text, split, **options).groupBy("key").agg(F.max("pairs").alias("pairs"))
    asked = rows.filter(F.col(split).isin(list(evaluation))).select(F.col(key).alias("key"), split, source)
    counted = asked.join(by_row, "key", "left").groupBy(split, source)
    return counted.agg(F.count("*").alias("rows"), F.count_if(F.col("pairs") > 0).alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
