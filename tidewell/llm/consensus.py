"""Consensus of several raters' label sets: a mean-field variational confusion model.

Each (post, aspect) is a yes/no item; a rater has for each aspect and each true answer a row of chances
with a Dirichlet prior, centred on the rater's own row over all aspects, and each aspect a class prior.
Posterior answers and Dirichlet parameters are updated in turn: expected counts by (rater, aspect) come
from one group-by a round, expected log chances from the digamma function. Reliabilities are posterior
means with 90 % intervals; agreement is Krippendorff's alpha (nominal, missing votes allowed).

Defined results: a null set is no vote, an empty one a vote for no aspect; ids out of range and repeats
are ignored; rows with a null post or rater are left out; several votes of one rater on one post are one
(the union); votes on posts that aren't asked for are left out; a post without votes has no aspects;
equal chances (0.5) are no consensus. Without any vote all results are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

N_ASPECTS = 9
#: Priors: of the class (no, yes), of a rater's row over all aspects (wrong, right), and the weight of that row in each aspect.
CLASS_PRIOR, ROW_PRIOR, SHRINK = (2.0, 1.0), (2.0, 6.0), 8.0
ROUNDS, TOLERANCE = 40, 1e-3
#: Most raters whose rows are kept on the driver; more would need the rows as a table.
MOST_RATERS = 100_000


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def mask(aspects: Column, n: int = N_ASPECTS) -> Column:
    """Bit i is set if i is among aspects; null for null."""
    inside = F.array_distinct(F.filter(aspects, lambda x: x.between(0, n - 1)))
    return F.aggregate(inside, F.lit(0), lambda acc, x: acc + F.pow(F.lit(2), x).cast("int"))


def votes(validation: DataFrame, annotations: DataFrame, n: int = N_ASPECTS) -> DataFrame:
    """post_id, rater, mask: one vote of each rater on each post of validation."""
    models = validation.select("post_id", F.explode(F.create_map(F.lit("model:qwen"), "qwen_aspects", F.lit("model:claude"), "claude_aspects")).alias("rater", "aspects"))
    asked = validation.filter(F.col("post_id").isNotNull()).select("post_id").distinct()
    people = annotations.select("post_id", F.col("annotator_id").alias("rater"), "aspects").join(asked, "post_id", "left_semi")
    cast = models.unionByName(people).filter(F.col("post_id").isNotNull() & F.col("rater").isNotNull() & F.col("aspects").isNotNull())
    return cast.select("post_id", "rater", mask(F.col("aspects"), n).alias("mask")).groupBy("post_id", "rater").agg(F.bit_or("mask").alias("mask"))


class Model:
    """Fitted parameters: rows (raters, aspects, truth, answer) and classes (aspects, truth), as Dirichlet counts."""

    def __init__(self, raters: list[str], n: int):
        self.raters, self.n = raters, n
        self.rows = np.zeros((len(raters), n, 2, 2))
        self.classes = np.tile(np.array(CLASS_PRIOR), (n, 1))
        self.pooled = np.zeros((len(raters), 2, 2))
        #: rounds taken, and whether the last one moved no rate by TOLERANCE
        self.rounds, self.converged = 0, False

    def update(self, counts: np.ndarray, truths: np.ndarray) -> None:
        """counts (raters, aspects, truth, answer) and truths (aspects, truth): expected numbers."""
        wrong, right = ROW_PRIOR
        prior = np.array([[right, wrong], [wrong, right]])
        self.pooled = counts.sum(1) + prior
        centre = self.pooled / self.pooled.sum(-1, keepdims=True)
        self.rows = counts + SHRINK * centre[:, None]
        self.classes = truths + np.array(CLASS_PRIOR)

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """Expected log chances of rows and classes."""
        return digamma(self.rows) - digamma(self.rows.sum(-1, keepdims=True)), digamma(self.classes) - digamma(self.classes.sum(-1, keepdims=True))


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n)) & 1


def _posterior(post: np.ndarray, rater: np.ndarray, answers: np.ndarray, size: int, logs: tuple | None, n: int) -> np.ndarray:
    """Chance of yes (posts, aspects); without logs the smoothed share of votes."""
    if logs is None:
        total, yes = np.bincount(post, minlength=size)[:, None], np.zeros((size, n))
        np.add.at(yes, post, answers)
        return (yes + 0.2) / (total + 1)
    rows, classes = logs
    score = np.tile(classes[:, 1] - classes[:, 0], (size, 1))
    ratio = np.where(answers == 1, (rows[..., 1, 1] - rows[..., 0, 1])[rater], (rows[..., 1, 0] - rows[..., 0, 0])[rater])
    np.add.at(score, post, ratio)
    return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = frame.raters.map(len).to_numpy()
    post = np.repeat(np.arange(len(frame)), sizes)
    return post, np.concatenate([*frame.raters, np.array([], int)]).astype(int), np.concatenate([*frame.masks, np.array([], int)]).astype(int)


def _count(frames: Iterator[pd.DataFrame], logs: tuple | None, n: int, raters: int) -> Iterator[pd.DataFrame]:
    """Expected counts of one partition: a row for each (rater, aspect), rater -1 for the classes."""
    counts, truths = np.zeros((raters, n, 2, 2)), np.zeros((n, 2))
    for frame in frames:
        post, rater, masks = _flat(frame)
        answers = _bits(masks, n)
        q = _posterior(post, rater, answers, len(frame), logs, n)
        truths += np.stack([(1 - q).sum(0), q.sum(0)], -1)
        for truth, weight in ((0, 1 - q[post]), (1, q[post])):
            for answer in (0, 1):
                np.add.at(counts[:, :, truth, answer], rater, weight * (answers == answer))
    seen = counts.sum((1, 2, 3)).nonzero()[0]
    out = [(int(r), a, *counts[r, a].ravel()) for r in seen for a in range(n)] + [(-1, a, truths[a, 0], truths[a, 1], 0.0, 0.0) for a in range(n)]
    yield pd.DataFrame(out, columns=["rater", "aspect", "c00", "c01", "c10", "c11"])


def fit(cast: DataFrame, n: int = N_ASPECTS, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(model, packed posts). The votes are shuffled once, by post; a post has at most one vote a rater."""
    names = [r.rater for r in cast.select("rater").distinct().orderBy("rater").limit(MOST_RATERS + 1).collect()]
    if len(names) > MOST_RATERS:
        raise ValueError(f"more than {MOST_RATERS} raters")
    spark = cast.sparkSession
    index = spark.createDataFrame(list(enumerate(names)), "index int, rater string")
    packed = cast.join(F.broadcast(index), "rater").groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("index", "mask"))).alias("v"))
    packed = stored(packed.select("post_id", F.col("v.index").alias("raters"), F.col("v.mask").alias("masks")), "votes")
    model, logs, before = Model(names, n), None, None
    for _ in range(rounds if names else 0):
        found = packed.mapInPandas(lambda frames, logs=logs: _count(frames, logs, n, len(names)), "rater int, aspect int, c00 double, c01 double, c10 double, c11 double")
        sums = found.groupBy("rater", "aspect").agg(*(F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11"))).collect()
        counts, truths = np.zeros((len(names), n, 2, 2)), np.zeros((n, 2))
        for r in sums:
            if r.rater < 0:
                truths[r.aspect] = r.c00, r.c01
            else:
                counts[r.rater, r.aspect] = [[r.c00, r.c01], [r.c10, r.c11]]
        model.update(counts, truths)
        model.rounds += 1
        logs = model.logs()
        rates = model.rows[..., 1] / model.rows.sum(-1)
        model.converged = before is not None and np.abs(rates - before).max() < TOLERANCE
        if model.converged:
            break
        before = rates
    return model, packed


def posteriors(model: Model, packed: DataFrame) -> DataFrame:
    """post_id, aspect_id, chance, votes for every post and aspect."""
    logs, n = model.logs(), model.n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            post, rater, masks = _flat(frame)
            q = _posterior(post, rater, _bits(masks, n), len(frame), logs, n)
            yield pd.DataFrame({"post_id": np.repeat(frame.post_id.to_numpy(), n), "aspect_id": np.tile(np.arange(n), len(frame)), "chance": q.ravel(), "votes": np.repeat(frame.raters.map(len).to_numpy(), n)})

    return packed.mapInPandas(run, "post_id string, aspect_id int, chance double, votes int")


def reliabilities(model: Model, spark) -> pd.DataFrame:
    """rater, aspect_id (null: all), sensitivity and specificity with 90 % intervals, informedness."""
    out = []
    for i, name in enumerate(model.raters):
        for aspect, rows in [(None, model.pooled[i]), *enumerate(model.rows[i])]:
            line = [name, aspect]
            for truth in (1, 0):
                good, all_ = rows[truth, truth], rows[truth].sum()
                mean = good / all_
                wide = 1.645 * np.sqrt(mean * (1 - mean) / (all_ + 1))
                line += [float(mean), float(max(0, mean - wide)), float(min(1, mean + wide))]
            out.append((*line, line[2] + line[5] - 1))
    schema = "rater string, aspect_id int, sensitivity double, sensitivity_low double, sensitivity_high double, specificity double, specificity_low double, specificity_high double, informedness double"
    return spark.createDataFrame(out, schema)


def krippendorff(cast: DataFrame, n: int = N_ASPECTS) -> DataFrame:
    """aspect_id (null: all aspects together), posts with two votes or more, alpha (1 if no two answers could differ)."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(F.col("mask") / F.pow(F.lit(2), i)).cast("bigint") % 2)
    cells = cast.select("post_id", F.posexplode(bits).alias("aspect_id", "answer")).groupBy("post_id", "aspect_id").agg(F.count("*").alias("m"), F.sum("answer").alias("yes")).filter("m > 1")
    apart = 2 * F.col("yes") * (F.col("m") - F.col("yes")) / (F.col("m") - 1)
    sums = cells.rollup("aspect_id").agg(F.count("*").alias("items"), F.sum(apart).alias("observed"), F.sum("m").alias("values"), F.sum("yes").alias("ones"))
    expected = 2 * F.col("ones") * (F.col("values") - F.col("ones")) / (F.col("values") - 1)
    return sums.filter("items > 0").select("aspect_id", "items", F.round(1 - F.coalesce(F.try_divide(F.col("observed"), expected), F.lit(0.0)), 9).alias("alpha"))
