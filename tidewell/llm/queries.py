"""Named queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..tables import table
from . import consensus, encoding, mixing, overlap, pii, sampling, sentences, toxicity, unify
from .sql import SQL  # noqa: F401


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(table(spark, folder, "documents", "doc_id", "source", "text"))
    return scored.select("doc_id", "source", "score", "expectation", "flagged", "segments")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_scores(spark, folder).filter("flagged").select("doc_id")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(p1_scores(spark, folder))


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "training_rows", "row_id", "post_id", "text", "source", "split_name")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.overlaps(_training(spark, folder))
    return pairs.select(F.least("train_key", "key").alias("row_id_a"), F.greatest("train_key", "key").alias("row_id_b")).distinct()


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.coverage(_training(spark, folder))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(_training(spark, folder))


def p2_partners(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows with the class of their text and the number of training rows that overlap them."""
    return overlap.partners(_training(spark, folder)).select(F.col("key").alias("row_id"), F.hex("class").alias("class"), "pairs")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return unify.look_alikes(table(spark, folder, "documents", "doc_id", "text"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the class of their look and the number of others that look the same but are stored differently."""
    return unify.linked(table(spark, folder, "documents", "doc_id", "text"))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every document."""
    return unify.with_forms(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", F.col("unified").alias("text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.spans(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", F.col("kind").alias("pii_type")).distinct()


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with placeholders."""
    return pii.redact(table(spark, folder, "documents", "doc_id", "text"))


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.votes(table(spark, folder, "validation", "post_id", "qwen_aspects", "claude_aspects"), table(spark, folder, "annotations", "post_id", "annotator_id", "aspects"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.posteriors(*consensus.fit(_votes(spark, folder))).filter("chance > 0.5").select("post_id", "aspect_id")


def p6_raters(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliabilities(consensus.fit(_votes(spark, folder))[0], spark)


def p6_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Krippendorff's alpha by aspect and over all."""
    return consensus.krippendorff(_votes(spark, folder))


def p6_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """How often the stored agreement of the two models contradicts their sets (equal sets agree)."""
    rows = table(spark, folder, "validation", "agreement", "qwen_aspects", "claude_aspects")
    same = consensus.mask(F.col("qwen_aspects")) == consensus.mask(F.col("claude_aspects"))
    return rows.groupBy(F.col("agreement").alias("stored"), same.alias("sets_agree")).agg(F.count("*").alias("posts"))


def _sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(what each target asks, the samples drawn)."""
    found = stored(sampling.posts(table(spark, folder, "labeled_posts", "post_id", "aspects")), "posts")
    asked = sampling.needs(found, table(spark, folder, "sample_targets"))
    return asked, sampling.draw(found, asked)


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    found = sampling.posts(table(spark, folder, "labeled_posts", "post_id", "aspects"))
    return sampling.needs(found, table(spark, folder, "sample_targets"))


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[1]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What was drawn beside what was asked."""
    return sampling.outcome(*_sample(spark, folder)).select("plan_name", "category", "target_share", "size", "need", "posts", "drawn", "share", "met")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of which the drawn and repaired sample holds less than the need; the count of posts confirms each."""
    short = sampling.outcome(*_sample(spark, folder)).filter(~F.col("met") & (F.col("posts") < F.col("need")))
    return short.select("plan_name", "category").distinct()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(table(spark, folder, "documents", "doc_id", "text"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents", "doc_id", "text")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p1_rates, p2_found, p2_coverage, p2_report, p2_partners, p3_found, p3_classes, p3_text, p5_found, p5_text, p6_found, p6_raters, p6_agreement, p6_contradictions, p7_found, p7_report, p7_sample, p7_shares, p8_ids, p9_mix, p9_shares, p10_found)}
