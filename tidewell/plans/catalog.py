"""Named queries over the project's tables, each beside equivalent SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import replies, text
from ..operators import curation, feeds, metrics, rollups, topk
from ..session import spread
from ..tables import table

N = 9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR, DAY, STAMP = "yyyy-MM-dd-HH", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def utc(*parts: int) -> datetime.datetime:
    return datetime.datetime(*parts, tzinfo=datetime.UTC)


def dim(spark: SparkSession, d: str, version: str = "1.0") -> DataFrame:
    """The label names of one taxonomy version: a fixed table of a few rows."""
    return table(spark, d, "stress_taxonomy").filter(F.col("taxonomy_version") == version).select("aspect_id", "aspect_name")


def classified(spark: SparkSession, d: str, posts: DataFrame | None = None) -> DataFrame:
    """Labelled posts (or those given of them) with their board, time buckets, labels in range and the flag of any label."""
    boards = table(spark, d, "post_messages", "post_id", "source").filter(F.col("post_id").isNotNull()).groupBy("post_id").agg(F.min("source").alias("board"))
    rows = (table(spark, d, "labeled_posts") if posts is None else posts).join(boards, "post_id", "left")
    valid = L.in_range("aspects", N)
    return rows.select(
        "post_id", "text", L.listed("aspects").alias("aspects"), valid.alias("valid"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "model", F.coalesce("board", F.lit("unknown")).alias("board"),
        F.date_format("labeled_at", HOUR).alias("hour_bucket"), F.date_format("labeled_at", DAY).alias("day_bucket"), "labeled_at", (F.size(valid) > 0).alias("stressed"),
    )


CLASSIFIED = """
WITH boards AS (SELECT post_id, min(source) AS board FROM post_messages WHERE post_id IS NOT NULL GROUP BY post_id),
classified AS (
  SELECT l.post_id, l.text, coalesce(l.aspects, []) AS aspects, list_filter(coalesce(l.aspects, []), lambda x: x BETWEEN 0 AND 8) AS valid,
    coalesce(l.confidence, 0.0) AS confidence, l.model, coalesce(b.board, 'unknown') AS board,
    strftime(l.labeled_at AT TIME ZONE 'UTC', '%Y-%m-%d-%H') AS hour_bucket, strftime(l.labeled_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_bucket, l.labeled_at AT TIME ZONE 'UTC' AS labeled_at,
    len(list_filter(coalesce(l.aspects, []), lambda x: x BETWEEN 0 AND 8)) > 0 AS stressed
  FROM labeled_posts l LEFT JOIN boards b USING (post_id))
"""


def profiled(spark: SparkSession, d: str) -> DataFrame:
    """Votes with the team and the year of joining of their annotator."""
    people = table(spark, d, "annotators").select("annotator_id", "team", F.date_format("joined_on", "yyyy").alias("cohort"))
    rows = table(spark, d, "annotations").join(F.broadcast(people), "annotator_id", "left")  # the table of people is fixed and small
    valid = L.in_range("aspects", N)
    return rows.select("annotation_id", F.coalesce("team", F.lit("unknown")).alias("team"), F.coalesce("cohort", F.lit("unknown")).alias("cohort"), valid.alias("valid"), (F.size(valid) > 0).alias("stressed"), F.date_format("labeled_at", DAY).alias("day_bucket"))


PROFILED = """
WITH profiled AS (
  SELECT a.annotation_id, coalesce(p.team, 'unknown') AS team, coalesce(strftime(p.joined_on, '%Y'), 'unknown') AS cohort,
    list_filter(coalesce(a.aspects, []), lambda x: x BETWEEN 0 AND 8) AS valid, len(list_filter(coalesce(a.aspects, []), lambda x: x BETWEEN 0 AND 8)) > 0 AS stressed,
    strftime(a.labeled_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_bucket
  FROM annotations a LEFT JOIN annotators p USING (annotator_id))
"""
TOTALS = "count(*) AS total_cnt, count_if(stressed) AS stress_cnt, round(coalesce(count_if(stressed) * 100.0 / nullif(count(*), 0), 0), 6) AS pct_stress, round(avg(confidence), 6) AS avg_score"


# ---- time buckets


@query(f"{CLASSIFIED} SELECT hour_bucket, {TOTALS} FROM classified GROUP BY hour_bucket")
def hourly_global(spark, d):
    return rollups.totals(classified(spark, d), ["hour_bucket"])


@query(f"{CLASSIFIED} SELECT board, hour_bucket, {TOTALS} FROM classified GROUP BY board, hour_bucket")
def hourly_by_group(spark, d):
    return rollups.totals(classified(spark, d), ["board", "hour_bucket"])


@query(f"{CLASSIFIED} SELECT hour_bucket, {TOTALS} FROM classified GROUP BY hour_bucket ORDER BY hour_bucket DESC LIMIT 1")
def current_hour_stats(spark, d):
    return topk.top(rollups.totals(classified(spark, d), ["hour_bucket"]), [F.desc("hour_bucket")], 1)


@query(f"{CLASSIFIED}, h AS (SELECT day_bucket, {TOTALS} FROM classified GROUP BY day_bucket) SELECT day_bucket, pct_stress, CASE WHEN pct_stress >= 60 THEN 'red' WHEN pct_stress >= 30 THEN 'yellow' ELSE 'green' END AS band FROM h")
def stress_bands(spark, d):
    days = rollups.totals(classified(spark, d), ["day_bucket"])
    return days.select("day_bucket", "pct_stress", rollups.banded(F.col("pct_stress"), [(60, "red"), (30, "yellow")], "green").alias("band"))


@query("""SELECT strftime(kafka_ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_bucket, count(*) AS rows_in, count_if(coalesce(text, '') <> '') AS kept, count(*) - count_if(coalesce(text, '') <> '') AS skipped,
round(count_if(coalesce(text, '') <> '') * 100.0 / count(*), 6) AS match_rate, round(count(*) / 24.0, 6) AS per_hour FROM post_messages GROUP BY 1""")
def ingest_rate(spark, d):
    rows = table(spark, d, "post_messages", "kafka_ts", "text")
    kept = F.count_if(F.coalesce("text", F.lit("")) != "")
    return rows.groupBy(F.date_format("kafka_ts", DAY).alias("day_bucket")).agg(F.count("*").alias("rows_in"), kept.alias("kept"), (F.count("*") - kept).alias("skipped"), L.share(kept, F.count("*"), 100).alias("match_rate"), F.round(F.count("*") / 24.0, 6).alias("per_hour"))


@query(f"{CLASSIFIED}, h AS (SELECT hour_bucket, {TOTALS} FROM classified GROUP BY hour_bucket) SELECT hour_bucket, stress_cnt, total_cnt - stress_cnt AS calm_cnt FROM h")
def stressed_vs_not(spark, d):
    return rollups.totals(classified(spark, d), ["hour_bucket"]).select("hour_bucket", "stress_cnt", (F.col("total_cnt") - F.col("stress_cnt")).alias("calm_cnt"))


@query(f"{CLASSIFIED} SELECT board, {TOTALS} FROM classified GROUP BY board ORDER BY pct_stress DESC, board LIMIT 10")
def top_groups_pct(spark, d):
    return topk.top(rollups.totals(classified(spark, d), ["board"]), [F.desc("pct_stress"), F.asc("board")], 10)


@query(f"{CLASSIFIED} SELECT board, {TOTALS} FROM classified GROUP BY board ORDER BY total_cnt DESC, board LIMIT 20")
def top_groups_volume(spark, d):
    return topk.top(rollups.totals(classified(spark, d), ["board"]), [F.desc("total_cnt"), F.asc("board")], 20)


@query(f"""{CLASSIFIED}, g AS (SELECT board FROM classified GROUP BY board ORDER BY count(*) DESC, board LIMIT 1)
SELECT board, day_bucket, {TOTALS} FROM classified WHERE board IN (SELECT board FROM g) AND day_bucket BETWEEN '2026-02-01' AND '2026-02-28' GROUP BY board, day_bucket""")
def group_trend(spark, d):
    largest = topk.top(classified(spark, d).groupBy("board").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("board")], 1).select("board")
    month = feeds.between(table(spark, d, "labeled_posts"), "labeled_at", utc(2026, 2, 1), utc(2026, 3, 1))
    return rollups.totals(classified(spark, d, month).join(F.broadcast(largest), "board", "left_semi"), ["board", "day_bucket"])


@query(f"{CLASSIFIED} SELECT hour_bucket, {TOTALS} FROM classified WHERE hour_bucket >= '2026-03-01-00' AND hour_bucket <= '2026-03-07-23' GROUP BY hour_bucket")
def hour_range_trend(spark, d):
    week = feeds.between(table(spark, d, "labeled_posts"), "labeled_at", utc(2026, 3, 1), utc(2026, 3, 8))
    return topk.ordered(rollups.totals(classified(spark, d, week), ["hour_bucket"]), [F.asc("hour_bucket")])


@query(f"{CLASSIFIED}, last AS (SELECT DISTINCT hour_bucket FROM classified ORDER BY hour_bucket DESC LIMIT 24) SELECT board, hour_bucket, {TOTALS} FROM classified WHERE hour_bucket IN (SELECT hour_bucket FROM last) GROUP BY board, hour_bucket")
def hour_list_trend(spark, d):
    """A list of hour partitions (here the last 24 that hold rows); the list's bounds reach the scan."""
    posts = table(spark, d, "labeled_posts")
    hours = topk.top(posts.select(F.date_format("labeled_at", HOUR).alias("h")).distinct().filter("h IS NOT NULL"), [F.desc("h")], 24).collect()
    return rollups.totals(hours_in(spark, d, [r.h for r in hours]), ["board", "hour_bucket"])


def hours_in(spark: SparkSession, d: str, hours: list[str]) -> DataFrame:
    """Classified posts of the listed hour buckets."""
    times = [datetime.datetime.strptime(h, "%Y-%m-%d-%H").replace(tzinfo=datetime.UTC) for h in hours]
    posts = table(spark, d, "labeled_posts")
    posts = feeds.between(posts, "labeled_at", min(times), max(times) + datetime.timedelta(hours=1)) if times else posts.limit(0)
    return classified(spark, d, posts).filter(F.col("hour_bucket").isin(hours))


@query("SELECT strftime(h, '%Y-%m-%d-%H') AS hour_bucket FROM (SELECT unnest(generate_series(date_trunc('hour', m) - INTERVAL 23 HOURS, date_trunc('hour', m), INTERVAL 1 HOUR)) AS h FROM (SELECT max(labeled_at AT TIME ZONE 'UTC') AS m FROM labeled_posts))")
def hour_partitions(spark, d):
    return rollups.hours_until(table(spark, d, "labeled_posts", "labeled_at").agg(F.max("labeled_at").alias("m")), "m", 24)


@query(f"{CLASSIFIED} SELECT DISTINCT hour_bucket FROM classified")
def distinct_buckets(spark, d):
    return table(spark, d, "labeled_posts", "labeled_at").select(F.date_format("labeled_at", HOUR).alias("hour_bucket")).distinct()


@query(f"{CLASSIFIED}, x AS (SELECT day_bucket, {TOTALS} FROM classified GROUP BY day_bucket) SELECT day_bucket, total_cnt, total_cnt - lag(total_cnt) OVER (ORDER BY day_bucket) AS delta FROM x")
def hour_delta(spark, d):
    return rollups.deltas(rollups.totals(classified(spark, d), ["day_bucket"]).select("day_bucket", "total_cnt"), "day_bucket", "total_cnt")


@query(f"{CLASSIFIED} SELECT strftime(labeled_at, '%Y-%m-%d %H:00') AS hour, count(*) AS total, count_if(stressed) AS stress FROM classified WHERE labeled_at IS NOT NULL GROUP BY 1")
def timeline(spark, d):
    rows = classified(spark, d).filter(F.col("labeled_at").isNotNull())
    return rows.groupBy(F.date_format("labeled_at", "yyyy-MM-dd HH:00").alias("hour")).agg(F.count("*").alias("total"), F.count_if("stressed").alias("stress"))


@query(f"{CLASSIFIED} SELECT count(*) AS posts, count_if(stressed) AS stressed_posts, round(count_if(stressed) * 100.0 / count(*), 6) AS pct, round(avg(confidence), 6) AS avg_confidence, round(avg(len(valid)), 6) AS avg_labels, count_if(len(valid) = 0) AS no_label, count_if(len(valid) > 1) AS multi_label, count_if(board <> 'unknown') AS known_board FROM classified")
def overview_metrics(spark, d):
    size = F.size("valid")
    return classified(spark, d).agg(
        F.count("*").alias("posts"), F.count_if("stressed").alias("stressed_posts"), L.share(F.count_if("stressed"), F.count("*"), 100).alias("pct"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.round(F.avg(size), 6).alias("avg_labels"), F.count_if(size == 0).alias("no_label"), F.count_if(size > 1).alias("multi_label"), F.count_if(F.col("board") != "unknown").alias("known_board"),
    )


@query(r"""SELECT source, count(moment) AS timed, round(avg(epoch_us(kafka_ts) - epoch_us(moment)) / 1e6, 3) AS avg_seconds FROM (
SELECT source, kafka_ts, TRY_CAST(CASE WHEN regexp_full_match(trim(crawled_at), '\d{4}-\d{2}-\d{2}[T ].*') THEN trim(crawled_at) END AS TIMESTAMPTZ) AS moment FROM post_messages) GROUP BY source""")
def latency_avg(spark, d):
    from ..operators.delivery import instant

    rows = table(spark, d, "post_messages", "source", "kafka_ts", "crawled_at").withColumn("at", instant("crawled_at"))
    return rows.groupBy("source").agg(F.count("at").alias("timed"), F.round(F.avg(F.unix_micros("kafka_ts") - F.col("at")) / 1e6, 3).alias("avg_seconds"))


# ---- feeds

FEED = "post_id, strftime(labeled_at, '%Y-%m-%d %H:%M:%S') AS labeled, model, confidence, array_to_string(list_sort(list_distinct(valid)), ',') AS labels"


def feed(rows: DataFrame) -> DataFrame:
    return rows.select("post_id", F.date_format("labeled_at", STAMP).alias("labeled"), "model", "confidence", L.joined(F.col("valid")).alias("labels"))


def newest(rows: DataFrame, n: int) -> DataFrame:
    return feed(topk.top(rows, [F.desc("labeled_at"), F.asc("post_id"), F.asc("model"), F.asc("confidence")], n))


@query(f"{CLASSIFIED} SELECT {FEED} FROM classified WHERE hour_bucket >= (SELECT strftime(date_trunc('hour', max(labeled_at)) - INTERVAL 23 HOURS, '%Y-%m-%d-%H') FROM classified) ORDER BY labeled_at DESC, post_id, model, confidence LIMIT 50")
def recent_posts(spark, d):
    posts = table(spark, d, "labeled_posts")
    last = feeds.latest(posts, "labeled_at")
    first = None if last is None else last.astimezone(datetime.UTC).replace(minute=0, second=0, microsecond=0) - datetime.timedelta(hours=23)
    return newest(classified(spark, d, feeds.between(posts.filter("labeled_at IS NOT NULL"), "labeled_at", first)), 50)


def _span(name: str, span: str):
    interval = feeds.SPANS[span]

    @query(f"{CLASSIFIED} SELECT {FEED} FROM classified WHERE labeled_at >= (SELECT max(labeled_at) FROM classified) - INTERVAL {interval}")
    def run(spark, d):
        return feed(classified(spark, d, feeds.recent(table(spark, d, "labeled_posts"), "labeled_at", span)))

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _s in feeds.SPANS:
    _span(f"feed_last_{_s}", _s)


@query(f"{CLASSIFIED} SELECT {FEED} FROM classified WHERE stressed ORDER BY confidence DESC, post_id, model, labeled_at LIMIT 50")
def recent_high_score(spark, d):
    return feed(topk.top(classified(spark, d).filter("stressed"), [F.desc("confidence"), F.asc("post_id"), F.asc("model"), F.asc("labeled_at")], 50))


@query(f"{CLASSIFIED} SELECT {FEED} FROM classified WHERE stressed AND list_has_any(aspects, [0, 3]) AND model = 'sageling-14b'")
def filtered_feed(spark, d):
    return feed(feeds.selected(classified(spark, d).filter("stressed"), equal={"model": "sageling-14b", "board": feeds.ALL}, any_of={"aspects": [0, 3]}))


@query(f"{CLASSIFIED} SELECT {FEED} FROM classified WHERE model IN ('sageling-14b', 'sageling-7b') AND list_has_any(aspects, [1, 2, 5])")
def multi_select_feed(spark, d):
    return feed(feeds.selected(classified(spark, d), equal={"board": feeds.ALL}, among={"model": ["sageling-14b", "sageling-7b"]}, any_of={"aspects": [1, 2, 5]}))


@query(f"{PROFILED} SELECT annotation_id, team, cohort FROM profiled WHERE cohort = '2024' AND stressed")
def person_feed(spark, d):
    """Votes filtered by fields of their person; All asks for nothing."""
    return feeds.selected(profiled(spark, d).filter("stressed"), equal={"team": feeds.ALL, "cohort": "2024"}).select("annotation_id", "team", "cohort")


@query("SELECT DISTINCT hour_bucket, CAST(epoch_us(strptime(hour_bucket, '%Y-%m-%d-%H')) AS BIGINT) AS begins FROM (SELECT strftime(labeled_at AT TIME ZONE 'UTC', '%Y-%m-%d-%H') AS hour_bucket FROM labeled_posts)")
def bucket_times(spark, d):
    return distinct_buckets(spark, d).select("hour_bucket", F.unix_micros(feeds.bucket_time(F.col("hour_bucket"))).alias("begins"))


@query(f"""{CLASSIFIED}, names AS (SELECT list(aspect_name ORDER BY aspect_id) AS names FROM stress_taxonomy WHERE taxonomy_version = '1.0'), top AS (SELECT * FROM classified ORDER BY labeled_at DESC, post_id, model, confidence LIMIT 30)
SELECT post_id, array_to_string(list_transform(valid[1:3], lambda x: names[x + 1]), ', ') || CASE WHEN len(valid) > 3 THEN ' +' || CAST(len(valid) - 3 AS VARCHAR) ELSE '' END AS chips,
CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM top CROSS JOIN names""")
def feed_preview(spark, d):
    latest = topk.top(classified(spark, d), [F.desc("labeled_at"), F.asc("post_id"), F.asc("model"), F.asc("confidence")], 30)
    names = dim(spark, d).agg(F.transform(F.sort_array(F.collect_list(F.struct("aspect_id", "aspect_name"))), lambda s: s["aspect_name"]).alias("names"))
    rows = latest.join(F.broadcast(names))  # one row
    chips = F.array_join(F.transform(F.slice("valid", 1, 3), lambda x: F.get("names", x)), ", ")
    more = F.when(F.size("valid") > 3, F.concat(F.lit(" +"), (F.size("valid") - 3).cast("string"))).otherwise("")
    return rows.select("post_id", F.concat(chips, more).alias("chips"), text.preview(F.col("text")).alias("preview"))


@query(f"{CLASSIFIED}, r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY labeled_at DESC, post_id, model, confidence) AS rn FROM classified) SELECT board, rn, post_id, confidence FROM r WHERE rn <= 3")
def latest_per_group(spark, d):
    rows = classified(spark, d).select("board", "post_id", "confidence", "labeled_at", "model")
    return topk.latest_by(rows, ["board"], [F.desc("labeled_at"), F.asc("post_id"), F.asc("model"), F.asc("confidence")], 3).select("board", "rn", "post_id", "confidence")


@query(f"{CLASSIFIED} SELECT post_id, {FEED.split(', ', 1)[1]} FROM classified WHERE contains(lower(text), 'deadline') OR contains(lower(text), 'phép')")
def text_search(spark, d):
    return feed(classified(spark, d).filter(text.mentions(F.col("text"), ["deadline", "phép"])))


@query(f"{CLASSIFIED} SELECT post_id, confidence, strftime(labeled_at, '%Y-%m-%d %H:%M:%S') AS labeled, array_to_string(aspects, ',') AS original FROM classified WHERE confidence < 0.5 ORDER BY confidence, labeled_at DESC, post_id, model LIMIT 100")
def low_confidence(spark, d):
    rows = topk.top(classified(spark, d).filter("confidence < 0.5"), [F.asc("confidence"), F.desc("labeled_at"), F.asc("post_id"), F.asc("model")], 100)
    return rows.select("post_id", "confidence", F.date_format("labeled_at", STAMP).alias("labeled"), F.array_join(F.transform("aspects", lambda x: x.cast("string")), ",").alias("original"))


# ---- labels


@query(f"{CLASSIFIED} SELECT aspect_id, count(*) AS cnt FROM (SELECT unnest(aspects) AS aspect_id FROM classified WHERE stressed) GROUP BY aspect_id")
def aspect_counts(spark, d):
    return rollups.label_counts(classified(spark, d).filter("stressed"), "aspects")


@query(f"{CLASSIFIED}, c AS (SELECT aspect_id, count(*) AS cnt FROM (SELECT unnest(valid) AS aspect_id FROM classified) GROUP BY aspect_id) SELECT t.aspect_id, t.aspect_name, coalesce(c.cnt, 0) AS cnt FROM stress_taxonomy t LEFT JOIN c USING (aspect_id) WHERE taxonomy_version = '1.0'")
def aspect_counts_zero_filled(spark, d):
    return rollups.zero_filled(rollups.label_counts(classified(spark, d), "valid"), dim(spark, d), "aspect_id").select("aspect_id", "aspect_name", "cnt")


@query(f"{CLASSIFIED} SELECT hour_bucket, aspect_id, count(*) AS cnt FROM (SELECT hour_bucket, unnest(valid) AS aspect_id FROM classified) GROUP BY ALL")
def aspect_hourly(spark, d):
    return rollups.label_counts(classified(spark, d), "valid", ["hour_bucket"])


@query(f"{CLASSIFIED} SELECT x.aspect_id, coalesce(t.aspect_name, 'aspect_' || CAST(x.aspect_id AS VARCHAR)) AS aspect_name, count(*) AS cnt FROM (SELECT unnest(aspects) AS aspect_id FROM classified) x LEFT JOIN (SELECT * FROM stress_taxonomy WHERE taxonomy_version = '1.0') t USING (aspect_id) GROUP BY ALL")
def aspect_lookup(spark, d):
    counts = rollups.label_counts(classified(spark, d), "aspects")
    name = F.coalesce("aspect_name", F.concat(F.lit("aspect_"), F.col("aspect_id").cast("string")))
    return counts.join(F.broadcast(dim(spark, d)), "aspect_id", "left").select("aspect_id", name.alias("aspect_name"), "cnt")


@query(f"{CLASSIFIED} SELECT a AS aspect_a, b AS aspect_b, count(*) AS cnt FROM (SELECT a, unnest(valid) AS b FROM (SELECT valid, unnest(valid) AS a FROM classified)) GROUP BY ALL")
def cooccurrence(spark, d):
    return rollups.pairs(classified(spark, d), "valid")


@query(f"{CLASSIFIED} SELECT day_bucket, a AS aspect_a, b AS aspect_b, count(*) AS cnt FROM (SELECT day_bucket, a, unnest(valid) AS b FROM (SELECT day_bucket, valid, unnest(valid) AS a FROM classified)) GROUP BY ALL")
def cooccurrence_daily(spark, d):
    return rollups.pairs(classified(spark, d), "valid", ["day_bucket"])


@query(f"{CLASSIFIED}, p AS (SELECT a, b, count(*) AS cnt FROM (SELECT a, unnest(valid) AS b FROM (SELECT valid, unnest(valid) AS a FROM classified)) GROUP BY ALL) SELECT a AS aspect_a, " + ", ".join(f"CAST(coalesce(sum(cnt) FILTER (b = {i}), 0) AS BIGINT) AS with_{i}" for i in range(N)) + " FROM p GROUP BY a")
def cooccurrence_matrix(spark, d):
    wide = rollups.pairs(classified(spark, d), "valid").groupBy("aspect_a").pivot("aspect_b", list(range(N))).agg(F.sum("cnt"))
    return wide.select("aspect_a", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"with_{i}") for i in range(N)))


@query(f"{CLASSIFIED}, t AS (SELECT count(*) AS n FROM classified) SELECT aspect_id, count(*) AS cnt, round(count(*) * 100.0 / max(n), 6) AS pct FROM (SELECT unnest(valid) AS aspect_id FROM classified) CROSS JOIN t GROUP BY aspect_id")
def aspect_distribution(spark, d):
    rows = classified(spark, d)
    counts = rollups.label_counts(rows, "valid")
    return counts.join(F.broadcast(rows.agg(F.count("*").alias("n")))).select("aspect_id", "cnt", L.share(F.col("cnt"), F.col("n"), 100).alias("pct"))  # one row


@query(f"{CLASSIFIED} SELECT post_id, model, " + ", ".join(f"CAST(list_contains(valid, {i}) AS INT) AS label_{i}" for i in range(N)) + " FROM classified")
def one_hot(spark, d):
    rows = classified(spark, d).select("post_id", "model", L.one_hot("valid", N).alias("hot"))
    return rows.select("post_id", "model", *(F.get("hot", F.lit(i)).alias(f"label_{i}") for i in range(N)))


@query("SELECT row_id, array_to_string(list_filter(range(0, 9), lambda i: len(labels) = 9 AND labels[i + 1] = 1), ',') AS ids FROM training_rows")
def labels_of_one_hot(spark, d):
    return table(spark, d, "training_rows", "row_id", "labels").select("row_id", L.joined(F.coalesce(L.from_one_hot("labels", N), F.array().cast("array<int>"))).alias("ids"))


@query(f"{CLASSIFIED} SELECT post_id, model, len(aspects) AS labels FROM classified WHERE len(aspects) <= 2 AND model IS NOT DISTINCT FROM 'sageling-7b'")
def quality_filter(spark, d):
    rows = classified(spark, d).filter(F.size("aspects") <= 2).filter(F.col("model").eqNullSafe("sageling-7b"))
    return rows.select("post_id", "model", F.size("aspects").alias("labels"))


@query(f"{CLASSIFIED}, m AS (SELECT post_id, map_from_entries(list_transform(list_distinct(valid), lambda x: {{'k': x, 'v': CASE WHEN confidence >= 0.75 THEN 1 WHEN confidence >= 0.6 THEN 0 ELSE -1 END}})) AS s FROM classified) SELECT post_id, len(map_keys(s)) AS labels, list_contains(map_keys(s), 2) AS has_health, len(list_filter(map_values(s), lambda v: v < 0)) > 0 AS any_negative FROM m WHERE list_contains(map_keys(s), 2)")
def map_aspect_sentiment(spark, d):
    tone = F.when(F.col("confidence") >= 0.75, 1).when(F.col("confidence") >= 0.6, 0).otherwise(-1)
    sentiments = F.map_from_entries(F.transform(F.array_distinct("valid"), lambda x: F.struct(x, tone)))
    rows = classified(spark, d).select("post_id", sentiments.alias("s")).filter(F.map_contains_key("s", F.lit(2)))
    return rows.select("post_id", F.size(F.map_keys("s")).alias("labels"), F.map_contains_key("s", F.lit(2)).alias("has_health"), F.exists(F.map_values("s"), lambda v: v < 0).alias("any_negative"))


# ---- groups of people


@query(f"{PROFILED} SELECT team, count(*) AS cnt FROM profiled GROUP BY team")
def demographic_counts(spark, d):
    return profiled(spark, d).groupBy("team").agg(F.count("*").alias("cnt"))


@query(f"{PROFILED} SELECT team, count(*) AS total, count_if(stressed) AS stress, count_if(NOT stressed) AS calm FROM profiled GROUP BY team")
def demographic_stress_split(spark, d):
    return profiled(spark, d).groupBy("team").agg(F.count("*").alias("total"), F.count_if("stressed").alias("stress"), F.count_if(~F.col("stressed")).alias("calm"))


@query(f"{PROFILED}, w AS (SELECT team, count(*) AS rows FROM profiled WHERE stressed GROUP BY team), c AS (SELECT team, aspect_id, count(*) AS cnt FROM (SELECT team, unnest(valid) AS aspect_id FROM profiled WHERE stressed) GROUP BY ALL) SELECT team, aspect_id, cnt, round(cnt * 100.0 / rows, 6) AS pct FROM c JOIN w USING (team)")
def demographic_aspect_pct(spark, d):
    return rollups.label_shares(profiled(spark, d), "team", "valid")


@query(f"{PROFILED} SELECT day_bucket, t AS demographic_type, v AS value, count(*) AS cnt FROM (SELECT day_bucket, 'team' AS t, team AS v FROM profiled UNION ALL SELECT day_bucket, 'cohort', cohort FROM profiled) GROUP BY ALL")
def demographics_daily(spark, d):
    return rollups.unpivoted(profiled(spark, d), ["day_bucket"], ["team", "cohort"])


# ---- texts


def _sql_clean(column: str) -> str:
    out = f"nfc_normalize({column})"
    white = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
    solid = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
    for pattern in (r"&[a-zA-Z]+;|&#\p{Nd}+;", rf"https?://{solid}+|www\.{solid}+", rf"{solid}+@{solid}+\.{solid}+", r"(\+84|0)\p{Nd}{9,10}", r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}.,!?;:\-''\"]"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{white}+', ' ', 'g'))"


CLEANED = f"WITH cleaned AS (SELECT delivery_id, {_sql_clean('text')} AS cleaned FROM post_messages)"


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "post_messages", "delivery_id", "text")).select("delivery_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"{CLEANED} SELECT delivery_id, cleaned, length(cleaned) AS char_count, left(sha256(cleaned), 16) AS text_hash FROM cleaned")
def clean_text(spark, d):
    return cleaned(spark, d).select("delivery_id", "cleaned", F.length("cleaned").alias("char_count"), text.digest(F.col("cleaned")).alias("text_hash"))


@query(f"""{CLEANED}, v AS (SELECT *, CASE WHEN coalesce(cleaned, '') = '' THEN 'empty' WHEN length(cleaned) < 50 THEN 'short' WHEN length(cleaned) > 2000 THEN 'long' ELSE 'kept' END AS status FROM cleaned),
f AS (SELECT min(delivery_id) AS delivery_id FROM v WHERE status = 'kept' GROUP BY sha256(cleaned))
SELECT CASE WHEN status = 'kept' AND delivery_id NOT IN (SELECT delivery_id FROM f) THEN 'duplicate' ELSE status END AS status, count(*) AS cnt FROM v GROUP BY 1""")
def clean_funnel(spark, d):
    verdict = text.verdict(F.col("cleaned"))
    rows = cleaned(spark, d).select(verdict.alias("status"), F.when(verdict == "kept", F.sha2("cleaned", 256)).alias("hash"))
    sizes = rows.groupBy("status", "hash").agg(F.count("*").alias("n")).groupBy("status").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
    # of each text that is kept, the rows after the first are duplicates
    parts = F.when(F.col("status") == "kept", F.array(F.struct(F.lit("kept").alias("status"), F.col("groups").alias("cnt")), F.struct(F.lit("duplicate").alias("status"), (F.col("n") - F.col("groups")).alias("cnt"))))
    return sizes.select(F.explode(parts.otherwise(F.array(F.struct("status", F.col("n").alias("cnt"))))).alias("p")).select("p.*").filter("cnt > 0")


@query(f"{CLEANED} SELECT min(delivery_id) AS delivery_id, left(sha256(cleaned), 16) AS text_hash FROM cleaned WHERE length(cleaned) BETWEEN 50 AND 2000 GROUP BY sha256(cleaned)")
def dedup_first(spark, d):
    # equal texts have equal sizes: the size is tested after the grouping, as a test before it would clean each text twice
    rows = cleaned(spark, d).select("delivery_id", F.length("cleaned").alias("size"), F.sha2("cleaned", 256).alias("hash"))
    firsts = topk.first_by_hash(rows, "hash", "delivery_id").filter(F.col("size").between(50, 2000))
    return firsts.select("delivery_id", F.substring("hash", 1, 16).alias("text_hash"))


WORDS = ["lương", "mất ngủ", "thi", "deadline"]


@query("SELECT delivery_id FROM post_messages WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS))
def keyword_filter(spark, d):
    return table(spark, d, "post_messages", "delivery_id", "text").filter(text.mentions(F.col("text"), WORDS)).select("delivery_id")


@query(r"SELECT delivery_id, regexp_extract(url, '\.(\d+)/?$', 1) AS thread, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://board.example' || url END AS full_url FROM post_messages WHERE url IS NOT NULL")
def post_id_extract(spark, d):
    rows = table(spark, d, "post_messages", "delivery_id", "url").filter(F.col("url").isNotNull())
    full = F.when(F.startswith("url", F.lit("http")), F.col("url")).otherwise(F.concat(F.lit("https://board.example"), F.col("url")))
    return rows.select("delivery_id", F.regexp_extract("url", r"\.(\d+)/?$", 1).alias("thread"), full.alias("full_url"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, greatest(least(coalesce(value / 100, 0.8), 1.0), 0.0) AS clamped FROM events""")
def json_extract(spark, d):
    rows = table(spark, d, "events", "event_id", "props", "value")
    reply = F.concat(F.lit("<think>{a}</think> so {old} "), F.col("props"), F.lit(" end"))
    fields = replies.parsed(replies.last_object(replies.after_thinking(reply)), "k bigint")
    return rows.select("event_id", fields["k"].alias("k"), L.clamp(F.col("value") / 100).alias("clamped"))


@query("""SELECT event_id, '{"kind": "' || event_type || '", "inner": ' || props || '}' AS widest, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'unknown' END AS kind FROM events""")
def json_widest(spark, d):
    """The whole object of a reply, and one of its fields if it is among the allowed values."""
    rows = table(spark, d, "events", "event_id", "event_type", "props")
    reply = F.concat(F.lit('Sure: {"kind": "'), F.col("event_type"), F.lit('", "inner": '), F.col("props"), F.lit("} done"))
    widest = replies.widest_object(reply)
    return rows.select("event_id", widest.alias("widest"), replies.one_of(replies.parsed(widest, "kind string")["kind"], ["click", "view", "error"]).alias("kind"))


@query("""WITH p AS (SELECT row_id, text, CAST('0x' || substring(md5('syn|' || CAST(row_id AS VARCHAR)), 1, 6) AS BIGINT) % 2 + 1 AS pick, string_split(text, ' ') AS words FROM training_rows WHERE text IS NOT NULL)
SELECT row_id, CASE WHEN list_position(words, 'mình') > 0 THEN array_to_string(list_transform(words, lambda w, i: CASE WHEN i = list_position(words, 'mình') THEN ['tôi', 'em'][pick] ELSE w END), ' ') ELSE text END AS changed FROM p""")
def synonym_replace(spark, d):
    rows = table(spark, d, "training_rows", "row_id", "text").filter(F.col("text").isNotNull())
    return rows.select("row_id", text.replace_first(F.col("text"), "mình", ["tôi", "em"], "syn", F.col("row_id").cast("string")).alias("changed"))


@query("""WITH p AS (SELECT row_id, string_split(text, ' ') AS w, text FROM training_rows WHERE text IS NOT NULL)
SELECT row_id, CASE WHEN len(w) > 4 THEN array_to_string([w[1]] || list_transform(list_sort(list_transform(w[2:len(w) - 1], lambda x, i: {'h': md5('mid|' || CAST(row_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR) || '|' || x), 'w': x})), lambda s: s.w) || [w[len(w)]], ' ') ELSE text END AS mixed FROM p""")
def shuffle_words(spark, d):
    rows = table(spark, d, "training_rows", "row_id", "text").filter(F.col("text").isNotNull())
    return rows.select("row_id", text.shuffle_middle(F.col("text"), "mid", F.col("row_id").cast("string")).alias("mixed"))


SYNONYMS = {"mình": ["tôi", "em"], "mệt": ["oải", "đuối"], "nhà": ["tổ ấm"]}


def _sql_synonyms() -> str:
    text, steps = "text", []
    for i, (word, others) in enumerate(SYNONYMS.items()):
        choice = f"[{', '.join(repr(o) for o in others)}][CAST('0x' || substring(md5('syn{word}|' || CAST(row_id AS VARCHAR)), 1, 6) AS BIGINT) % {len(others)} + 1]"
        steps.append(f"s{i} AS (SELECT row_id, CASE WHEN list_position(string_split({text}, ' '), '{word}') > 0 THEN array_to_string(list_transform(string_split({text}, ' '), lambda w, i: CASE WHEN i = list_position(string_split({text}, ' '), '{word}') THEN {choice} ELSE w END), ' ') ELSE {text} END AS t{i} FROM {'training_rows WHERE length(text) > 50' if not i else f's{i - 1}'})")
        text = f"t{i}"
    return f"WITH {', '.join(steps)} SELECT row_id, {text} AS changed FROM s{len(SYNONYMS) - 1}"


@query(_sql_synonyms())
def synonym_passes(spark, d):
    """Several words in turn, in texts of strictly more than 50 characters."""
    rows = table(spark, d, "training_rows", "row_id", "text").filter(text.longer_than(F.col("text")))
    return rows.select("row_id", text.replace_words(F.col("text"), SYNONYMS, "syn", F.col("row_id").cast("string")).alias("changed"))


@query("""WITH pieces AS (SELECT row_id, n, string_split(part, ' ') AS w, part FROM (SELECT row_id, unnest(string_split(text, '. ')) AS part, unnest(range(0, len(string_split(text, '. ')))) AS n FROM training_rows WHERE text IS NOT NULL)),
m AS (SELECT row_id, n, CASE WHEN len(w) > 4 THEN array_to_string([w[1]] || list_transform(list_sort(list_transform(w[2:len(w) - 1], lambda x, i: {'h': md5('mid|' || CAST(row_id AS VARCHAR) || '.' || CAST(n AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR) || '|' || x), 'w': x})), lambda s: s.w) || [w[len(w)]], ' ') ELSE part END AS mixed FROM pieces)
SELECT row_id, string_agg(mixed, '. ' ORDER BY n) AS mixed FROM m GROUP BY row_id""")
def shuffle_sentences(spark, d):
    rows = table(spark, d, "training_rows", "row_id", "text").filter(F.col("text").isNotNull())
    return rows.select("row_id", text.shuffle_sentences(F.col("text"), "mid", F.col("row_id").cast("string")).alias("mixed"))


# ---- sets and joins


@query("""SELECT 'old' AS side, row_id FROM training_rows WHERE split_name = 'train' UNION ALL
SELECT 'new', row_id FROM training_rows WHERE split_name <> 'train' AND (post_id IS NULL OR post_id NOT IN (SELECT post_id FROM training_rows WHERE split_name = 'train' AND post_id IS NOT NULL))""")
def merge_anti(spark, d):
    rows = table(spark, d, "training_rows", "row_id", "post_id", "split_name")
    old, new = rows.filter("split_name = 'train'").withColumn("side", F.lit("old")), rows.filter("split_name <> 'train'").withColumn("side", F.lit("new"))
    return curation.append_new(old, new, "post_id").select("side", "row_id")


@query("SELECT delivery_id FROM post_messages m WHERE NOT EXISTS (SELECT 1 FROM labeled_posts l WHERE l.post_id = m.post_id)")
def resume_anti(spark, d):
    return curation.remaining(table(spark, d, "post_messages", "delivery_id", "post_id"), table(spark, d, "labeled_posts", "post_id"), "post_id").select("delivery_id")


@query("SELECT count(*) AS known FROM post_messages m WHERE post_id IN (SELECT post_id FROM labeled_posts)")
def known_posts(spark, d):
    rows = table(spark, d, "post_messages", "post_id").join(table(spark, d, "labeled_posts", "post_id"), "post_id", "left_semi")
    return rows.agg(F.count("*").alias("known"))


@query("SELECT origin, count(*) AS cnt, count(confidence) AS scored FROM (SELECT 'labeled' AS origin, confidence FROM labeled_posts UNION ALL SELECT 'training', NULL FROM training_rows UNION ALL SELECT 'votes', NULL FROM annotations) GROUP BY origin")
def tagged_union(spark, d):
    parts = {"labeled": table(spark, d, "labeled_posts", "post_id", "confidence"), "training": table(spark, d, "training_rows", "post_id"), "votes": table(spark, d, "annotations", "post_id")}
    return curation.tagged(parts).groupBy("origin").agg(F.count("*").alias("cnt"), F.count("confidence").alias("scored"))


@query("SELECT v.post_id, l.model, v.jaccard FROM validation v JOIN labeled_posts l USING (post_id)")
def sample_join(spark, d):
    return table(spark, d, "validation", "post_id", "jaccard").join(table(spark, d, "labeled_posts", "post_id", "model"), "post_id").select("post_id", "model", "jaccard")


@query("""SELECT post_id, arg_max(model, labeled_at) AS model, max(strftime(labeled_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')) AS labeled FROM labeled_posts GROUP BY post_id""")
def upsert_latest(spark, d):
    rows = table(spark, d, "labeled_posts", "post_id", "model", "labeled_at")
    return topk.upserted(rows, "post_id", F.col("labeled_at")).select("post_id", "model", F.date_format("labeled_at", STAMP).alias("labeled"))


@query("""SELECT delivery_id, to_json({'post_id': post_id, 'url': coalesce(nullif(url, ''), ''), 'source': coalesce(nullif(source, ''), 'board'), 'timestamp': crawled_at}) AS value FROM post_messages WHERE trim(coalesce(text, '')) <> '' AND post_id IS NOT NULL AND crawled_at IS NOT NULL""")
def replay_rows(spark, d):
    rows = table(spark, d, "post_messages").filter((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("post_id").isNotNull() & F.col("crawled_at").isNotNull())
    value = F.to_json(F.struct("post_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("board")).alias("source"), F.col("crawled_at").alias("timestamp")))
    return rows.select("delivery_id", value.alias("value"))


@query("SELECT count(*) AS kept FROM labeled_posts WHERE labeled_at >= (SELECT max(labeled_at) FROM labeled_posts) - INTERVAL 90 DAYS")
def retained(spark, d):
    rows = table(spark, d, "labeled_posts", "labeled_at")
    last = rows.agg(F.max("labeled_at").alias("last"))
    return rows.join(F.broadcast(last)).filter("labeled_at >= last - INTERVAL 90 DAYS").agg(F.count("*").alias("kept"))  # one row


# ---- building data sets

FIRST = "SELECT post_id, min(coalesce(list_filter(aspects, lambda x: x BETWEEN 0 AND 8)[1], -1)) AS stratum FROM labeled_posts GROUP BY post_id"


def strata(spark: SparkSession, d: str) -> DataFrame:
    first = F.coalesce(F.get(L.in_range("aspects", N), F.lit(0)), F.lit(-1))
    return table(spark, d, "labeled_posts", "post_id", "aspects").groupBy("post_id").agg(F.min(first).alias("stratum"))


@query(f"""WITH s AS ({FIRST}), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('split|' || post_id), post_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT post_id, stratum, CASE WHEN rn <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split_part FROM r""")
def stratified_split(spark, d):
    return curation.stratified_split(strata(spark, d), "stratum", "post_id", "split").select("post_id", "stratum", "split_part")


@query(f"""WITH s AS ({FIRST}), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('split|' || post_id), post_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT CASE WHEN rn <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split_part, stratum, count(*) AS cnt FROM r GROUP BY ALL""")
def stratified_split_sizes(spark, d):
    return stratified_split(spark, d).groupBy("split_part", "stratum").agg(F.count("*").alias("cnt"))


@query("SELECT split_name, coalesce(source, 'unknown') AS source, count(*) AS cnt FROM training_rows GROUP BY ALL")
def split_profile(spark, d):
    return table(spark, d, "training_rows", "split_name", "source").groupBy("split_name", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("cnt"))


@query("SELECT split_name, i AS aspect_id, CAST(sum(labels[i + 1]) AS BIGINT) AS cnt, count(*) AS rows FROM training_rows CROSS JOIN (SELECT CAST(unnest(range(0, 9)) AS INT) AS i) WHERE len(labels) = 9 GROUP BY ALL")
def split_profile_aspects(spark, d):
    rows = table(spark, d, "training_rows", "split_name", "labels").filter(F.size("labels") == N)
    return rows.select("split_name", F.posexplode("labels").alias("aspect_id", "one")).groupBy("split_name", "aspect_id").agg(F.sum("one").alias("cnt"), F.count("*").alias("rows"))


@query("SELECT row_id FROM training_rows ORDER BY md5('sample|' || CAST(row_id AS VARCHAR)), row_id LIMIT (SELECT CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) FROM training_rows)")
def exact_sample(spark, d):
    return curation.exact_sample(table(spark, d, "training_rows", "row_id"), "row_id", 0.2, "sample").select("row_id")


@query(f"""WITH s AS ({FIRST}), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('again|' || post_id), post_id) - 1 AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM s),
w AS (SELECT stratum, CAST(floor(count(*) * 0.25::DOUBLE) AS BIGINT) AS take, count(*) AS n FROM s GROUP BY stratum),
t AS (SELECT stratum, n, unnest(range(1, take + 1)) AS slot FROM w)
SELECT t.stratum, t.slot, r.post_id, 'aug_' || CAST(t.stratum AS VARCHAR) || '_' || CAST(t.slot AS VARCHAR) AS new_id FROM t JOIN r ON r.stratum = t.stratum AND r.rk = CAST('0x' || substring(md5('again|' || CAST(t.stratum AS VARCHAR) || '|' || CAST(t.slot AS VARCHAR)), 1, 8) AS BIGINT) % t.n""")
def resampled(spark, d):
    rows = strata(spark, d)
    wanted = rows.groupBy("stratum").agg((F.count("*") * F.lit(0.25)).cast("bigint").alias("n"))
    drawn = curation.resampled(rows, "stratum", "post_id", wanted, "again")
    return drawn.select("stratum", F.col("slot").cast("bigint").alias("slot"), "post_id", F.concat(F.lit("aug_"), F.col("stratum").cast("string"), F.lit("_"), F.col("slot").cast("string")).alias("new_id"))


COUNTS = f"{CLASSIFIED}, c AS (SELECT t.aspect_id, coalesce(x.cnt, 0) AS cnt FROM stress_taxonomy t LEFT JOIN (SELECT aspect_id, count(*) AS cnt FROM (SELECT unnest(valid) AS aspect_id FROM classified) GROUP BY aspect_id) x USING (aspect_id) WHERE taxonomy_version = '1.0' AND aspect_id < 9), n AS (SELECT count(*) AS n FROM classified)"


def counts_and_total(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    rows = classified(spark, d)
    return rollups.zero_filled(rollups.label_counts(rows, "valid"), dim(spark, d).filter(F.col("aspect_id") < N), "aspect_id"), rows.count()


@query(f"{COUNTS} SELECT aspect_id, cnt, CAST(floor(n * 0.1::DOUBLE) AS INT) AS target, CAST(greatest(CAST(floor(n * 0.1::DOUBLE) AS INT) - cnt, 0) AS BIGINT) AS gap, CAST(floor(greatest(CAST(floor(n * 0.1::DOUBLE) AS INT) - cnt, 0) * 0.4::DOUBLE) AS INT) AS augment, CAST(floor(greatest(CAST(floor(n * 0.1::DOUBLE) AS INT) - cnt, 0) * 0.6::DOUBLE) AS INT) AS generate FROM c CROSS JOIN n")
def gap_plan(spark, d):
    return curation.gap_plan(*counts_and_total(spark, d), 0.1)


@query(f"{COUNTS} SELECT aspect_id, cnt, round(least(greatest(CASE WHEN cnt = 0 THEN 1.0 ELSE n::DOUBLE / (9 * cnt) END, 1.0), 20.0), 6) AS weight FROM c CROSS JOIN n")
def class_weights(spark, d):
    return curation.class_weights(*counts_and_total(spark, d), N)


# ---- agreement and quality

RATED = "WITH rated AS (SELECT DISTINCT post_id, list_sort(list_distinct(list_filter(qwen_aspects, lambda x: x BETWEEN 0 AND 8))) AS a, list_sort(list_distinct(list_filter(claude_aspects, lambda x: x BETWEEN 0 AND 8))) AS b, coalesce(needs_review, FALSE) AS flag FROM validation WHERE qwen_aspects IS NOT NULL AND claude_aspects IS NOT NULL)"
SETS = f"{RATED}, s AS (SELECT post_id, flag, len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))) AS diff, len(list_filter(a, lambda x: list_contains(b, x))) AS shared, len(list_distinct(a || b)) AS either FROM rated)"


def rated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "validation", "post_id", "qwen_aspects", "claude_aspects", "needs_review").filter("qwen_aspects IS NOT NULL AND claude_aspects IS NOT NULL")
    ordered = lambda c: F.array_sort(F.array_distinct(L.in_range(c, N)))
    return rows.select("post_id", ordered("qwen_aspects").alias("a"), ordered("claude_aspects").alias("b"), F.coalesce("needs_review", F.lit(False)).alias("flag")).distinct()


@query(f"{SETS} SELECT post_id, diff, CASE WHEN either = 0 THEN 1.0 ELSE round(shared / either, 6) END AS jaccard, diff = 0 AS exact_match, flag OR diff > 2 AS needs_review FROM s")
def agreement_rows(spark, d):
    rows = rated(spark, d).withColumns(metrics.set_columns(F.col("a"), F.col("b")))
    return rows.select("post_id", "diff", "jaccard", F.col("same").alias("exact_match"), (F.col("flag") | (F.col("diff") > 2)).alias("needs_review"))


@query(f"{SETS}, j AS (SELECT *, CASE WHEN either = 0 THEN 1.0 ELSE round(shared / either, 6) END AS jaccard FROM s) SELECT count(*) AS posts, count_if(diff = 0) AS exact, count_if(flag OR diff > 2) AS review, round(coalesce(avg(jaccard), 0), 6) AS avg_jaccard FROM j")
def agreement_summary(spark, d):
    rows = agreement_rows(spark, d)
    return rows.agg(F.count("*").alias("posts"), F.count_if("exact_match").alias("exact"), F.count_if("needs_review").alias("review"), F.round(F.coalesce(F.avg("jaccard"), F.lit(0.0)), 6).alias("avg_jaccard"))


CELLS = f"{RATED}, cells AS (SELECT post_id, i AS aspect_id, CAST(list_contains(b, i) AS INT) AS y, CAST(list_contains(a, i) AS INT) AS p FROM rated CROSS JOIN (SELECT CAST(unnest(range(0, 9)) AS INT) AS i))"
CONFUSION = "count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp, count_if(y = 1 AND p = 0) AS fn, count_if(y = 0 AND p = 0) AS tn"


def rated_cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cells(rated(spark, d), "post_id", "b", "a", N)


@query(f"{CELLS} SELECT aspect_id, {CONFUSION} FROM cells GROUP BY aspect_id")
def confusion_by_label(spark, d):
    return metrics.confusion(rated_cells(spark, d), ["aspect_id"])


@query(f"{CELLS}, c AS (SELECT aspect_id, {CONFUSION} FROM cells GROUP BY aspect_id), k AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c), e AS (SELECT *, (tp + tn) / n AS po, ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n * n) AS pe FROM k) SELECT aspect_id, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e")
def kappa(spark, d):
    return metrics.kappa(confusion_by_label(spark, d)).select("aspect_id", "kappa")


PRF = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@query(f"{CELLS}, c AS (SELECT aspect_id, {CONFUSION} FROM cells GROUP BY aspect_id) SELECT aspect_id, tp + fn AS support, {PRF} FROM c")
def label_metrics(spark, d):
    return metrics.scores(confusion_by_label(spark, d)).select("aspect_id", "support", "precision", "recall", "f1")


@query(f"""{CELLS}, c AS (SELECT aspect_id, {CONFUSION} FROM cells GROUP BY aspect_id), l AS (SELECT *, tp + fn AS support, {PRF} FROM c), t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c),
r AS (SELECT post_id, {CONFUSION} FROM cells GROUP BY post_id), rs AS (SELECT {PRF} FROM r)
SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM l
UNION ALL SELECT 'micro', {PRF} FROM t
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM l
UNION ALL SELECT 'samples', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM rs""")
def avg_metrics(spark, d):
    cells = rated_cells(spark, d)
    by_label, by_row = metrics.scores(metrics.confusion(cells, ["aspect_id"])), metrics.scores(metrics.confusion(cells, ["post_id"]))
    names = ("precision", "recall", "f1")
    macro = by_label.agg(*(F.round(F.avg(c), 6).alias(c) for c in names)).withColumn("average", F.lit("macro"))
    micro = metrics.scores(metrics.confusion(cells, [])).select(*names).withColumn("average", F.lit("micro"))
    weighted = by_label.agg(*(F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c) for c in names)).withColumn("average", F.lit("weighted"))
    samples = by_row.agg(*(F.round(F.avg(c), 6).alias(c) for c in names)).withColumn("average", F.lit("samples"))
    return macro.unionByName(micro).unionByName(weighted).unionByName(samples)


@query(f"""{CELLS}, c AS (SELECT {CONFUSION} FROM cells), e AS (SELECT post_id, bool_and(y = p) AS same FROM cells GROUP BY post_id)
SELECT round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS accuracy, round((2.0 * tp / nullif(2 * tp + fp + fn, 0) + 2.0 * tn / nullif(2 * tn + fp + fn, 0)) / 2, 6) AS cell_macro_f1, (SELECT round(avg(CAST(same AS INT)), 6) FROM e) AS exact_ratio FROM c""")
def cell_metrics(spark, d):
    cells = rated_cells(spark, d)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    two = (F.try_divide(2 * tp, 2 * tp + fp + fn) + F.try_divide(2 * tn, 2 * tn + fp + fn)) / 2
    whole = metrics.confusion(cells, []).select(F.round((tp + tn) / (tp + fp + fn + tn), 6).alias("accuracy"), F.round(two, 6).alias("cell_macro_f1"))
    rows = rated(spark, d).agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("exact_ratio"))
    return whole.join(F.broadcast(rows))  # one row each


@query(f"{RATED} SELECT array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS missed, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS extra, count(*) AS cnt FROM rated GROUP BY ALL")
def error_breakdown(spark, d):
    rows = rated(spark, d)
    return rows.groupBy(L.joined(F.array_except("b", "a")).alias("missed"), L.joined(F.array_except("a", "b")).alias("extra")).agg(F.count("*").alias("cnt"))


SCORED = "WITH probs AS (SELECT vec_id, label, list_transform(embedding[1:9], lambda x: 1 / (1 + exp(-(CAST(x AS DOUBLE) - 0.15) * 20))) AS p FROM embeddings)"


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    logits = F.transform(F.slice("embedding", 1, N), lambda x: (x.cast("double") - 0.15) * 20)
    return rows.select("vec_id", "label", L.sigmoid(logits).alias("p"))


@query(f"{SCORED}, a AS (SELECT *, list_filter(range(0, 9), lambda i: p[i + 1] > 0.5) AS ids FROM probs) SELECT vec_id, array_to_string(ids, ',') AS labels, len(ids) > 0 AS stressed, round(CASE WHEN len(ids) > 0 THEN list_max(p) ELSE 0 END, 6) AS confidence, round(list_max(p), 6) AS max_prob FROM a")
def scored_labels(spark, d):
    rows = probabilities(spark, d).withColumn("ids", L.above(F.col("p"), 0.5))
    return rows.select("vec_id", L.joined(F.col("ids")).alias("labels"), (F.size("ids") > 0).alias("stressed"), F.round(F.when(F.size("ids") > 0, F.array_max("p")).otherwise(0.0), 6).alias("confidence"), F.round(F.array_max("p"), 6).alias("max_prob"))


@query(f"{SCORED}, g AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold), x AS (SELECT CAST(i AS INT) AS aspect_id, threshold, CAST(label = i AS INT) AS y, CAST(p[i + 1] > threshold AS INT) AS p FROM probs CROSS JOIN g CROSS JOIN (SELECT unnest(range(0, 9)) AS i)), c AS (SELECT aspect_id, threshold, {CONFUSION} FROM x GROUP BY ALL) SELECT aspect_id, threshold, {PRF} FROM c")
def threshold_sweep(spark, d):
    grid = F.array(*(F.lit(t) for t in (0.3, 0.4, 0.5, 0.6, 0.7)))  # five thresholds a cell, made inside the row
    cells = probabilities(spark, d).select("label", F.posexplode("p").alias("aspect_id", "prob"))
    cells = cells.select("aspect_id", F.explode(grid).alias("threshold"), (F.col("label") == F.col("aspect_id")).cast("int").alias("y"), "prob")
    cells = cells.select("aspect_id", "threshold", "y", (F.col("prob") > F.col("threshold")).cast("int").alias("p"))
    return metrics.scores(metrics.confusion(cells, ["aspect_id", "threshold"])).select("aspect_id", "threshold", "precision", "recall", "f1")


@query(f"{SCORED}, g AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold), x AS (SELECT CAST(i AS INT) AS aspect_id, threshold, CAST(label = i AS INT) AS y, CAST(p[i + 1] > threshold AS INT) AS p FROM probs CROSS JOIN g CROSS JOIN (SELECT unnest(range(0, 9)) AS i)), c AS (SELECT aspect_id, threshold, {CONFUSION} FROM x GROUP BY ALL), f AS (SELECT aspect_id, threshold, {PRF} FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY aspect_id ORDER BY f1 DESC, threshold) AS rn FROM f) SELECT aspect_id, threshold, f1 FROM r WHERE rn = 1")
def best_threshold(spark, d):
    """The threshold of the best f1 for each label; of equal ones the lowest."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("b")
    return threshold_sweep(spark, d).groupBy("aspect_id").agg(best).select("aspect_id", (-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"))


BEST_EPOCH = f"""{CLASSIFIED}, d AS (SELECT day_bucket, {TOTALS} FROM classified GROUP BY day_bucket)"""
BEST_EPOCH = BEST_EPOCH.replace("WITH boards", "WITH RECURSIVE boards", 1) + """, s AS (SELECT day_bucket AS o, pct_stress AS m, row_number() OVER (ORDER BY day_bucket NULLS FIRST) AS n FROM d),
f AS (SELECT 0::BIGINT AS n, '-infinity'::DOUBLE AS best, NULL::VARCHAR AS at_step, 0 AS missed UNION ALL
  SELECT s.n, CASE WHEN s.m > f.best + 0.5 AND f.missed < 5 THEN s.m ELSE f.best END, CASE WHEN s.m > f.best + 0.5 AND f.missed < 5 THEN s.o ELSE f.at_step END,
    CASE WHEN f.missed >= 5 THEN f.missed WHEN s.m > f.best + 0.5 THEN 0 ELSE f.missed + 1 END FROM f JOIN s ON s.n = f.n + 1)
SELECT at_step AS best_step, best AS best_metric FROM f ORDER BY n DESC LIMIT 1"""


@query(BEST_EPOCH)
def best_epoch(spark, d):
    """Early stopping over the days of labelled posts, with the share of flagged posts as the metric."""
    days = rollups.totals(classified(spark, d), ["day_bucket"])
    return rollups.best_epoch(days, "day_bucket", "pct_stress", 0.5, 5)


LATEST_14B = "SELECT post_id, arg_max(aspects, labeled_at) AS aspects FROM labeled_posts WHERE model = 'sageling-14b' AND aspects IS NOT NULL GROUP BY post_id"


@query(f"""{CLASSIFIED}, low AS (SELECT DISTINCT post_id, aspects FROM classified WHERE confidence < 0.5 AND model <> 'sageling-14b'), new AS ({LATEST_14B})
SELECT post_id, array_to_string(list_sort(list_distinct(coalesce(new.aspects, low.aspects))), ',') AS labels, CASE WHEN new.post_id IS NULL THEN 'fallback' ELSE 'sageling-14b' END AS model FROM low LEFT JOIN new USING (post_id)""")
def relabel_merge(spark, d):
    low = classified(spark, d).filter((F.col("confidence") < 0.5) & (F.col("model") != "sageling-14b")).select("post_id", "aspects").distinct().withColumn("model", F.lit(None).cast("string"))
    better = table(spark, d, "labeled_posts", "post_id", "aspects", "model", "labeled_at").filter("model = 'sageling-14b' AND aspects IS NOT NULL")
    merged = curation.relabelled(low, topk.upserted(better, "post_id", F.col("labeled_at")), "post_id")
    return merged.select("post_id", L.joined(F.col("aspects")).alias("labels"), "model")


@query(f"{CLASSIFIED}, c AS (SELECT board, {TOTALS} FROM classified GROUP BY board) SELECT board, printf('%.1f%%', round(pct_stress, 1)) AS shown FROM c")
def percent_text(spark, d):
    boards = rollups.totals(classified(spark, d), ["board"])
    return boards.select("board", F.format_string("%.1f%%", F.round("pct_stress", 1)).alias("shown"))


PROMPT = "Label the post with ids from 0 to 8.\nPost: {text}\nAnswer with JSON."


@query(f"SELECT row_id, replace('{PROMPT}', '{{text}}', substring(text, 1, 800)) AS prompt FROM training_rows WHERE text IS NOT NULL")
def prompt_rows(spark, d):
    rows = table(spark, d, "training_rows", "row_id", "text").filter("text IS NOT NULL")
    return rows.select("row_id", F.replace(F.lit(PROMPT), F.lit("{text}"), F.substring("text", 1, 800)).alias("prompt"))
