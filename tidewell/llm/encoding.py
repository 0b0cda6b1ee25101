"""Token ids of whole texts under a public tokenizer.

Short texts are encoded in one piece. A text longer than ``chunk`` is cut into overlapping chunks, which
become rows of their own; each chunk is pre-tokenised by itself, neighbours are stitched at the first
position in their overlap where both have a pre-token boundary, and the pieces between the stitches are
encoded in parallel. The pre-token pattern only looks forward, so once two scans share a boundary, all
later boundaries are equal too, and the joined pieces give the ids of the whole text.

Defined results: an empty text gives an empty list; a null text gives an empty list as well (parameter
``null_ids``). Characters that spell a special token are ordinary text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 1 << 12, 1 << 8

_open: dict = {}


def _package(folder: str):
    """The module that describes the vocabulary files, read from their folder."""
    spec = importlib.util.spec_from_file_location("public_tokenizers_at", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """(tiktoken encoding, compiled pre-token pattern), opened once in each Python worker."""
    key = (folder, vocabulary)
    if key not in _open:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = _package(folder).PATTERN
        _open[key] = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)
    return _open[key]


def decode(ids: list[int], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes joined, then read as UTF-8."""
    return b"".join(encoder(folder, vocabulary)[0].decode_tokens_bytes(ids)).decode("utf-8")


def windows(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk with the overlap on its left."""
    return [(max(0, at - overlap), min(length, at + chunk)) for at in range(0, length, chunk)]


def boundaries(text: str, pattern, start: int, last: bool) -> list[int]:
    """Absolute starts of the pre-tokens of a window, and its end if it is the last one.

    The final pre-token of a window that isn't the last may go on behind it, so its end is left out.
    """
    at = [start + m.start() for m in pattern.finditer(text)]
    return [*at, start + len(text)] if last else at


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int] | None:
    """First common boundary of each pair of neighbours; None if a pair has none."""
    cuts = []
    for tail, head in zip(tails[:-1], heads[1:], strict=True):
        common = sorted(set(tail) & set(head))
        if not common:
            return None
        cuts.append(common[0])
    return cuts if cuts == sorted(set(cuts)) else None


def encode_long(text: str, encoding, pattern, chunk: int, overlap: int) -> list[int]:
    """The chunked path in one process; the distributed one does the same in rows."""
    spans = windows(len(text), chunk, overlap)
    found = [boundaries(text[a:b], pattern, a, b == len(text)) for a, b in spans]
    cuts = stitches([[x for x in f if x <= a + 2 * overlap] for f, (a, _) in zip(found, spans, strict=True)], [[x for x in f if x >= b - overlap] for f, (_, b) in zip(found, spans, strict=True)])
    if cuts is None:
        return encoding.encode_ordinary(text)
    edges = [0, *cuts, len(text)]
    return [i for a, b in zip(edges[:-1], edges[1:], strict=True) for i in encoding.encode_ordinary(text[a:b])]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, null_ids: tuple[int, ...] = ()) -> DataFrame:
    """key and ids (list of int) of every row of documents; rows with equal keys each give a row."""
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    short = rows.filter(F.col("text").isNull() | (F.length("text") <= chunk))
    none = list(null_ids)

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(folder, vocabulary)
        for batch in batches:
            ids = [none if t is None else encoding.encode_ordinary(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    done = short.mapInArrow(encode_short, f"key {kind}, ids array<int>")
    return done.unionByName(_encode_chunks(rows.filter(F.length("text") > chunk), kind, folder, vocabulary, chunk, overlap)).select(F.col("key").alias(key), "ids")


def _encode_chunks(rows: DataFrame, kind: str, folder: str, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """Texts over one chunk: chunks as rows, stitched by text, pieces encoded in parallel."""
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "long")  # the numbers must be the same wherever they are read
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    cut = numbered.select("key", "row", F.length("text").alias("length"), F.posexplode(starts).alias("n", "start"), "text")
    begin = F.greatest(F.lit(0), F.col("start") - overlap)
    # a chunk holds its overlap on the left, and on the right as much as its piece may reach beyond it
    cut = cut.select("key", "row", "length", "n", begin.alias("begin"), F.substring("text", begin + 1, F.col("start") + chunk + overlap - begin).alias("window"), (F.col("start") + chunk).alias("end"))
    cut = cut.repartition("row", "n")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, pattern = encoder(folder, vocabulary)
        for frame in frames:
            heads, tails = [], []
            for begin, end, length, window in zip(frame.begin, frame.end, frame.length, frame.window, strict=True):
                found = boundaries(window[: end - begin], pattern, begin, end >= length)
                heads.append([x for x in found if x <= begin + 2 * overlap])
                tails.append([x for x in found if x >= end - overlap])
            yield frame[["key", "row", "length", "n", "begin", "window"]].assign(heads=heads, tails=tails)

    scanned = cut.mapInPandas(scan, f"key {kind}, row bigint, length int, n int, begin int, window string, heads array<int>, tails array<int>")
    marks = scanned.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "heads", "tails"))).alias("marks"))

    @F.pandas_udf("array<int>")
    def join_marks(all_marks: pd.Series) -> pd.Series:
        return pd.Series([stitches([list(m["heads"]) for m in marks], [list(m["tails"]) for m in marks]) for marks in all_marks])

    cuts = marks.select("row", join_marks("marks").alias("cuts"))
    pieces = scanned.select("key", "row", "length", "n", "begin", "window").join(cuts, "row")
    first = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.get("cuts", F.col("n") - 1))
    last = F.coalesce(F.get("cuts", F.col("n")), F.col("length"))
    inner = pieces.filter(F.col("cuts").isNotNull()).select("key", "row", "n", F.expr("window").alias("window"), (first - F.col("begin")).alias("a"), (last - F.col("begin")).alias("b"))
    # without a common boundary the text has a pre-token longer than the overlap: it is encoded whole
    whole = numbered.join(cuts.filter(F.col("cuts").isNull()).select("row"), "row", "left_semi").select("key", "row", F.lit(0).alias("n"), F.col("text").alias("window"), F.lit(0).alias("a"), F.length("text").alias("b"))

    def piece(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, _ = encoder(folder, vocabulary)
        for frame in frames:
            ids = [encoding.encode_ordinary(w[a:b]) for w, a, b in zip(frame.window, frame.a, frame.b, strict=True)]
            yield frame[["key", "row", "n"]].assign(ids=ids)

    encoded = inner.unionByName(whole).mapInPandas(piece, f"key {kind}, row bigint, n int, ids array<int>")
    joined = encoded.groupBy("row").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("parts"))
    return joined.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def count_tokens(documents: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with n_tokens (0 for null and empty texts) in place of the text."""
    others = [c for c in documents.columns if c != text]
    schema = documents.select(*others, F.lit(0).cast("bigint").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(folder, vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes = pa.array([0 if not t else len(encoding.encode_ordinary(t)) for t in batch.column(at).to_pylist()], pa.int64())
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, sizes], names=[*others, "n_tokens"])

    return spread(documents.select(*others, text)).mapInArrow(count, schema)
