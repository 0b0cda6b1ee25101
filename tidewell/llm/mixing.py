"""Mixing sources to target weights of the total tokens, by pivotal dependent rounding.

Every source gets an amount of tokens: its weight of the total, but at most max_repeats times what it has;
what a capped source cannot give is shared among the others by weight. A document of a source then has
amount / available expected copies: the whole part is certain, the fraction is rounded by pairing documents
and moving mass at random from one to the other (in tokens, so that the size of the mixture stays) until
one of the two is integral. A task keeps one open document a source; the open ones meet in a reduction
tree, and the last of each source is decided by its own fraction.

Defined results: documents of other sources, or of no source, are left out; documents without tokens get
0 copies; a source without documents, or with a weight that is null or not positive, gets 0 and is
reported; max_repeats null or under 0 counts as 0. Repeated target rows of a source: the first by weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .encoding import TOKENIZERS, VOCABULARY, count_tokens

FAN_IN = 64
EPS = 1e-9


def allot(available: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens for each source; total defaults to all tokens that the sources hold."""
    caps = {s: available.get(s, 0) * repeats[s] for s in weights}
    goal = float(sum(available.get(s, 0) for s in weights)) if total is None else float(total)
    given: dict[str, float] = {}
    rest = {s for s in weights if caps[s] > 0}
    given |= {s: 0.0 for s in weights if s not in rest}
    while rest:
        left, share = goal - sum(given.values()), sum(weights[s] for s in rest)
        full = {s for s in rest if left * weights[s] / share >= caps[s]}
        given |= {s: float(caps[s]) for s in full} if full else {s: left * weights[s] / share for s in rest}
        rest = rest - full if full else set()
    return given


def _uniform(*parts: object) -> float:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=7).digest(), "big") / 2**56


def pivot(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """(key, size, p) twice: moves mass so that sizes times p keep their sum and one p becomes 0 or 1.

    The two possible moves are drawn so that each p keeps its expectation. Returns (decided, open).
    """
    (ka, wa, pa), (kb, wb, pb) = a, b
    up = min((1 - pa) * wa, pb * wb)  # mass from b to a
    down = min(pa * wa, (1 - pb) * wb)  # mass from a to b
    move = up if _uniform(seed, ka, kb) * (up + down) < down else -down
    pa, pb = pa + move / wa, pb - move / wb
    a, b = (ka, wa, min(1.0, max(0.0, pa))), (kb, wb, min(1.0, max(0.0, pb)))
    return (a, b) if min(a[2], 1 - a[2]) <= min(b[2], 1 - b[2]) else (b, a)


def _reduce(frames: Iterator[pd.DataFrame], seed: int, close: bool) -> Iterator[pd.DataFrame]:
    """Rounds one partition; its last open document of each source goes on, or is decided if close."""
    waiting: dict[str, tuple] = {}
    for frame in frames:
        out = []
        for source, key, size, p in zip(frame.source, frame.key, frame.n_tokens, frame.p, strict=True):
            if p <= EPS or p >= 1 - EPS:
                out.append((source, key, size, float(round(p)), False))
                continue
            item = (key, size, p)
            if source in waiting:
                decided, item = pivot(waiting.pop(source), item, seed)
                out.append((source, decided[0], decided[1], float(round(decided[2])), False))
                if item[2] <= EPS or item[2] >= 1 - EPS:
                    out.append((source, item[0], item[1], float(round(item[2])), False))
                    continue
            waiting[source] = item
        yield pd.DataFrame(out, columns=["source", "key", "n_tokens", "p", "open"])
    last = [(s, k, w, float(_uniform(seed, "last", k) < p) if close else p, not close) for s, (k, w, p) in waiting.items()]
    yield pd.DataFrame(last, columns=["source", "key", "n_tokens", "p", "open"])


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", total_tokens: float | None = None, seed: int = 7, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies: key, source, n_tokens, copies >= 1; report by source).

    The targets table is fixed and small (one row a source); it, and one sum a source, go to the driver.
    """
    spark = documents.sparkSession
    asked = targets.groupBy("source").agg(F.max_by(F.struct("target_weight", "max_repeats"), F.coalesce("target_weight", F.lit(-1.0))).alias("t")).select("source", "t.*").filter(F.col("source").isNotNull()).collect()
    weights = {r.source: float(r.target_weight or 0) for r in asked if (r.target_weight or 0) > 0}
    repeats = {r.source: max(0, r.max_repeats or 0) for r in asked}
    picked = documents.select(F.col(key).alias("key"), "source", "text").filter(F.col("source").isin(list(repeats)))
    sized = stored(count_tokens(picked, folder=folder, vocabulary=vocabulary), "sized")
    have = {r.source: (r.n, r.tokens) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    given = allot({s: t for s, (_, t) in have.items()}, weights, repeats, total_tokens)
    rates = spark.createDataFrame([(s, given.get(s, 0.0) / t if t else 0.0) for s, (_, t) in have.items()], "source string, rate double")
    rated = sized.filter(F.col("n_tokens") > 0).join(F.broadcast(rates), "source")
    whole = F.floor(F.col("rate") + EPS)
    rated = rated.withColumns({"whole": whole, "p": F.greatest(F.lit(0.0), F.col("rate") - whole)})

    schema = f"source string, key {sized.schema['key'].dataType.simpleString()}, n_tokens bigint, p double, open boolean"
    step = lambda close: lambda frames: _reduce(frames, seed, close)
    level = stored(rated.select("source", "key", "n_tokens", "p").mapInPandas(step(False), schema), "rounded")
    decided, waiting, parts = [level.filter(~F.col("open"))], level.filter("open").drop("open"), rated.rdd.getNumPartitions()
    while True:  # open documents: at most one for each source and partition
        parts = max(1, -(-parts // FAN_IN))
        order = [F.xxhash64("key"), "key"]
        gathered = waiting.repartition(parts, F.spark_partition_id()) if parts > 1 else waiting.repartition(1)
        level = stored(gathered.sortWithinPartitions("source", *order).mapInPandas(step(parts == 1), schema), "rounded")
        decided.append(level.filter(~F.col("open")))
        if parts == 1:
            break
        waiting = level.filter("open").drop("open")
    rounded = decided[0]
    for more in decided[1:]:
        rounded = rounded.unionByName(more)
    copies = rounded.select("source", "key", "n_tokens", "p").join(F.broadcast(rates), "source")
    copies = copies.withColumn("copies", (F.floor(F.col("rate") + EPS) + F.col("p")).cast("int")).filter("copies > 0").select(F.col("key").alias(key), "source", "n_tokens", "copies")

    plan = spark.createDataFrame([(r.source, float(r.target_weight or 0), repeats[r.source], *have.get(r.source, (0, 0)), given.get(r.source, 0.0)) for r in asked], "source string, target_weight double, max_repeats int, documents bigint, tokens bigint, planned_tokens double")
    used = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.sum("copies").alias("actual_documents"), F.max("copies").alias("most_copies"))
    share = used.agg(F.sum("actual_tokens").alias("all"))
    report = plan.join(F.broadcast(used), "source", "left").fillna(0, ["actual_tokens", "actual_documents", "most_copies"]).crossJoin(F.broadcast(share))
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.col("all")), F.lit(0.0))).drop("all")
    # the share that a limited source lacks is with the others, which then exceed theirs
    limited = (F.col("planned_tokens") >= F.col("tokens") * F.col("max_repeats")) & (F.col("target_weight") > 0)
    return copies, report.withColumns({"limited": limited, "met": F.col("actual_share") >= 0.98 * F.col("target_weight")})
