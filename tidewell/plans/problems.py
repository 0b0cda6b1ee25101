"""Queries of the training-data problems that belong to the core (p4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import DeliveryLedger, admit_deliveries
from ..session import work
from ..tables import table


def _ledger(spark: SparkSession) -> DeliveryLedger:
    return DeliveryLedger(spark, work(spark, "ledger"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries to drop: the arrivals that the ledger doesn't admit."""
    messages = table(spark, folder, "post_messages", "delivery_id", "post_id", "crawled_at")
    return admit_deliveries(messages, _ledger(spark)).filter(F.col("admitted") == F.lit(False)).select("delivery_id")


def p4_once(spark: SparkSession, folder: str) -> DataFrame:
    """Kept deliveries by source: the first arrival of each post, and the rows without an identifier."""
    messages = table(spark, folder, "post_messages", "delivery_id", "post_id", "crawled_at", "source")
    kept = admit_deliveries(messages, _ledger(spark)).filter(F.coalesce("admitted", F.lit(True)))
    return kept.groupBy("source").agg(F.count("*").alias("deliveries"), F.count_if(F.col("admitted").isNull()).alias("without_id"))


P4_RANKED = r"""
SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY moment NULLS LAST, delivery_id) AS rn
FROM (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(trim(crawled_at), '\d{4}-\d{2}-\d{2}[T ].*') THEN trim(crawled_at) END AS TIMESTAMPTZ) AS moment FROM post_messages)
WHERE post_id IS NOT NULL AND regexp_replace(post_id, '[\s\p{Z}]', '', 'g') <> ''
"""

QUERIES = {"p4_found": p4_found, "p4_once": p4_once}
SQL = {
    "p4_found": f"SELECT delivery_id FROM ({P4_RANKED}) WHERE rn > 1",
    "p4_once": f"""SELECT source, count(*) AS deliveries, count_if(post_id IS NULL OR regexp_replace(post_id, '[\\s\\p{{Z}}]', '', 'g') = '') AS without_id
FROM post_messages WHERE delivery_id NOT IN (SELECT delivery_id FROM ({P4_RANKED}) WHERE rn > 1) GROUP BY source""",
}
