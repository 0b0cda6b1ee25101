"""Named queries that run streams, pages and scorers (no SQL can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import in_range, joined
from ..operators.delivery import instant
from ..operators.labeling import field, labels_of, reply, word_labeler
from ..operators.scoring import hashed_scorer, predict
from ..operators.similar import near_duplicates as _near_duplicates
from ..session import work as _folder
from ..sources import pages
from ..sources.io import decode, encode, usable
from ..streaming import pipeline
from ..tables import table


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """post_messages as a stream of its file or files, with the time of arrival."""
    schema = table(spark, folder, "post_messages").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/post_messages.parquet*")


def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals by hour and board, from a stream run to its end in update mode; the last count of a window stands."""
    work = _folder(spark, "stream-hourly")
    counts = pipeline.windowed(_stream(spark, folder).select("kafka_ts", "source"), "kafka_ts", "source", late="3650 days", dedup=None)
    pipeline.run_once(counts, "", f"{work}/checkpoint", "update", pipeline.batch_writer(f"{work}/out"))
    out = spark.read.parquet(f"{work}/out")
    return out.groupBy("hour_bucket", "source").agg(F.max_by("cnt", "batch_id").alias("cnt"))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One arrival of each post within the watermark, written as a table."""
    work = _folder(spark, "stream-dedup")
    posts = _stream(spark, folder).select("post_id", "kafka_ts", "source").filter(F.col("post_id").isNotNull() & (F.trim("post_id") != ""))
    pipeline.run_once(pipeline.unique(posts, "kafka_ts", late="3650 days"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out").select("post_id")


def stream_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Messages decoded, scored and written in batches that can be repeated; counts by board."""
    work = _folder(spark, "stream-enriched")
    prediction = predict(F.col("text"), hashed_scorer, "hashed-1")
    raw = _stream(spark, folder).select(F.to_json(F.struct("post_id", "text", "url", "source", F.col("original_timestamp").alias("timestamp"), "crawled_at")).alias("value"), F.col("kafka_ts").alias("timestamp"))
    score = lambda batch: pipeline.enriched(pipeline.posts_from(batch), prediction, "hashed-1")
    pipeline.run_once(raw, "", f"{work}/checkpoint", "append", pipeline.batch_writer(f"{work}/out", rejected=f"{work}/rejected", source=score))
    done = spark.read.parquet(f"{work}/out").groupBy("source").agg(F.count("*").alias("rows"), F.count_if("stressed").alias("stressed"))
    return done.unionByName(spark.read.parquet(f"{work}/rejected").select(F.concat(F.lit("rejected: "), "reason").alias("source")).groupBy("source").agg(F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("stressed")))


def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by hour from three batches, a month of posts each, under a watermark of an hour; one post in sixteen comes a batch late."""
    work = _folder(spark, "stream-late")
    posts = table(spark, folder, "labeled_posts", "post_id", "aspects", "labeled_at").filter("labeled_at IS NOT NULL")
    first = posts.agg(F.min("labeled_at").alias("first"))
    part = F.least(F.floor(F.datediff("labeled_at", "first") / 45), F.lit(3)) + F.startswith(F.md5("post_id"), F.lit("0")).cast("int")
    placed = posts.join(F.broadcast(first)).withColumn("part", part.cast("int")).drop("first")  # one row
    for n in range(5):
        placed.filter(F.col("part") == n).drop("part").coalesce(1).write.parquet(f"{work}/in/{n}")
    stream = spark.readStream.schema("post_id string, aspects array<int>, labeled_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{work}/in/*")
    labels = stream.select("labeled_at", F.explode(in_range("aspects", 9)).alias("aspect_id"))
    counts = pipeline.windowed(labels, "labeled_at", "aspect_id", dedup=None)
    pipeline.run_once(counts, "", f"{work}/checkpoint", "update", pipeline.batch_writer(f"{work}/out"), pipeline.Progress())
    return spark.read.parquet(f"{work}/out").groupBy("hour_bucket", "aspect_id").agg(F.max_by("cnt", "batch_id").alias("cnt"))


def scorer_udf(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id", "text").withColumn("p", predict(F.col("text"), hashed_scorer, "hashed-1"))
    return rows.select("doc_id", joined(F.col("p.aspects")).alias("labels"), F.round("p.confidence", 6).alias("confidence"), "p.stressed")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    """First posts read back out of pages that hold the posts' texts, a quote and a spoiler."""
    rows = table(spark, folder, "post_messages", "delivery_id", "url", "text", "crawled_at").filter("url IS NOT NULL AND text IS NOT NULL")
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit('<article><time datetime="'), F.coalesce("crawled_at", F.lit("")), F.lit('"></time><div class="bbWrapper"><blockquote class="bbCodeBlock bbCodeBlock--quote">quoted</blockquote>'), escaped, F.lit('<div class="bbCodeSpoiler">hidden</div></div></article>'))
    return pages.first_posts(rows.select("url", html.alias("html"))).select("post_id", "url", F.length("text").alias("characters"), F.unix_micros("posted").alias("posted"))


def decoded_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Posts through the wire form and back, without those that hold no text, by board."""
    rows = table(spark, folder, "post_messages")
    value = F.to_json(F.struct("post_id", "text", "url", "source", F.col("original_timestamp").alias("timestamp"), "crawled_at"))
    posts = usable(decode(rows.select(value.alias("value"), F.col("kafka_ts").alias("timestamp"))))
    return posts.groupBy("source").agg(F.count("*").alias("posts"), F.count(instant("crawled_at")).alias("timed"))


def encoded_messages(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "validation", "post_id", "jaccard").filter("post_id IS NOT NULL"), "post_id")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return _near_duplicates(table(spark, folder, "training_rows", "row_id", "text"), "row_id", "text")


PERSON = {"student": ["học phí", "thesis", "statistics", "luận văn"], "worker": ["sếp", "công ty", "boss", "manager", "deadline"], "robot": ["máy"]}
ALLOWED = ["student", "worker"]
SIGNS = {0: "sếp", 1: "học", 2: "ngủ", 3: "tiền", 4: "nhà"}


def person_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What a text tells of its writer, among allowed values."""
    rows = table(spark, folder, "training_rows", "row_id", "text")
    return rows.select("row_id", field(F.col("text"), PERSON, ALLOWED).alias("occupation"))


def labeler_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "training_rows", "row_id", "text")
    ids, confidence = labels_of(reply(F.col("text"), lambda: word_labeler(SIGNS), "words-1"))
    return rows.select("row_id", joined(ids).alias("labels"), confidence.alias("confidence"))


QUERIES = {f.__name__: f for f in (stream_hourly, stream_dedup, stream_enriched, stream_late, person_fields, labeler_rows, scorer_udf, page_text, decoded_messages, encoded_messages, near_duplicates)}
def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


# The fixed weights of the stand-in scorer, and the labels of any table of texts (id, text).
SCORES = r"""WITH weights AS (SELECT p, j, CAST('0x' || substring(md5('7|' || p || '|' || j), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 2.4::DOUBLE - 1.2::DOUBLE AS w FROM (SELECT unnest(range(0, 4096)) AS p) CROSS JOIN (SELECT unnest(range(0, 9)) AS j)),
texts AS (SELECT id, text FROM ({texts}) WHERE NOT regexp_full_match(text, '[\t-\r\x1c-\x20\x{85}\p{Z}]*')),
words AS (SELECT id, CAST('0x' || substring(md5(w), 1, 3) AS INT) AS p FROM (SELECT id, unnest(string_split(text, ' ')) AS w FROM texts) WHERE w <> ''),
probs AS (SELECT id, j, 1 / (1 + exp(-(sum(w) / sqrt(count(*)::DOUBLE) - 1.0))) AS prob FROM words JOIN weights USING (p) GROUP BY id, j),
scored AS (SELECT id, coalesce(string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) FILTER (prob > 0.5), '') AS labels, round(CASE WHEN max(prob) > 0.5 THEN max(prob) ELSE 0 END, 6) AS confidence, max(prob) > 0.5 AS stressed FROM probs GROUP BY id)"""
MOMENT = r"epoch_us(TRY_CAST(CASE WHEN regexp_full_match(trim(crawled_at), '\d{4}-\d{2}-\d{2}[T ].*') THEN trim(crawled_at) END AS TIMESTAMPTZ))"
STRIPPED = r"regexp_replace(text, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '', 'g')"
SQL = {
    "scorer_udf": SCORES.replace("{texts}", "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL") + " SELECT d.doc_id, coalesce(s.labels, '') AS labels, coalesce(s.confidence, 0) AS confidence, coalesce(s.stressed, FALSE) AS stressed FROM documents d LEFT JOIN scored s ON s.id = d.doc_id",
    "stream_enriched": SCORES.replace("{texts}", "SELECT delivery_id AS id, text FROM post_messages WHERE text IS NOT NULL") + """ SELECT m.source, count(*) AS rows, count_if(coalesce(s.stressed, FALSE)) AS stressed FROM post_messages m LEFT JOIN scored s ON s.id = m.delivery_id WHERE m.text <> '' GROUP BY m.source
UNION ALL SELECT 'rejected: ' || CASE WHEN post_id IS NULL AND text IS NULL THEN 'malformed' ELSE 'no text' END, count(*), 0 FROM post_messages WHERE coalesce(text, '') = '' GROUP BY 1""",
    "page_text": f"""SELECT regexp_extract(url, '\\.(\\d+)/?$', 1) AS post_id, url, length({STRIPPED}) AS characters, {MOMENT} AS posted FROM post_messages WHERE url IS NOT NULL AND text IS NOT NULL AND length({STRIPPED}) >= 50""",
    "encoded_messages": """SELECT post_id AS key, '{"post_id":' || to_json(post_id) || CASE WHEN jaccard IS NULL THEN '' ELSE ',"jaccard":' || to_json(jaccard) END || '}' AS value FROM validation WHERE post_id IS NOT NULL""",
    "near_duplicates": r"""WITH RECURSIVE texts AS (SELECT DISTINCT text AS node FROM training_rows WHERE text IS NOT NULL),
tokens AS (SELECT node, list_filter(string_split_regex(lower(node), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM texts),
runs AS (SELECT node, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 5 + 1, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS run FROM tokens WHERE len(w) > 0),
sizes AS (SELECT node, count(*) AS n FROM runs GROUP BY node),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS common FROM runs a JOIN runs b ON a.run = b.run AND a.node <> b.node GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE common >= 0.8::DOUBLE * (x.n + y.n - common) - 1e-9),
reach AS (SELECT node AS a, node AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
firsts AS (SELECT text AS node, min(row_id) AS k FROM training_rows WHERE text IS NOT NULL GROUP BY text),
named AS (SELECT r.a AS node, min(f.k) AS class FROM reach r JOIN firsts f ON f.node = r.b GROUP BY r.a),
degree AS (SELECT a AS node, count(*) AS links FROM links GROUP BY a)
SELECT t.row_id, coalesce(n.class, t.row_id) AS class, coalesce(d.links, 0) AS links FROM training_rows t LEFT JOIN named n ON n.node = t.text LEFT JOIN degree d ON d.node = t.text""",
    "person_fields": "SELECT row_id, CASE " + " ".join(f"WHEN {_any(words)} THEN '{value if value in ALLOWED else 'unknown'}'" for value, words in PERSON.items()) + " ELSE 'unknown' END AS occupation FROM training_rows",
    "labeler_rows": f"""WITH f AS (SELECT row_id, text, list_filter([{', '.join(f"CASE WHEN contains(text, '{w}') THEN {i} ELSE -1 END" for i, w in SIGNS.items())}], lambda x: x >= 0) AS ids FROM training_rows)
SELECT row_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string(ids, ',') END AS labels, CASE WHEN text IS NOT NULL THEN least(0.5::DOUBLE + len(ids) / 2, 1.0::DOUBLE) END AS confidence FROM f""",
    # a batch drops windows that ended before the watermark by which the batch before it dropped state: an hour before the last event of all batches before that
    "stream_late": """WITH f AS (SELECT min(labeled_at AT TIME ZONE 'UTC') AS first FROM labeled_posts), p AS (SELECT list_filter(aspects, lambda x: x BETWEEN 0 AND 8) AS ids, labeled_at AT TIME ZONE 'UTC' AS at_time,
  least(floor(datediff('day', CAST(first AS DATE), CAST(labeled_at AT TIME ZONE 'UTC' AS DATE)) / 45), 3) + CAST(starts_with(md5(post_id), '0') AS INT) AS part FROM labeled_posts CROSS JOIN f WHERE labeled_at IS NOT NULL),
w AS (SELECT x.part, max(y.at_time) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM p) x LEFT JOIN p y ON y.part < x.part - 1 AND len(y.ids) > 0 GROUP BY x.part)
SELECT strftime(at_time, '%Y-%m-%d-%H') AS hour_bucket, aspect_id, count(*) AS cnt FROM (SELECT at_time, mark, unnest(ids) AS aspect_id FROM p JOIN w USING (part))
WHERE mark IS NULL OR date_trunc('hour', at_time) + INTERVAL 1 HOUR > mark GROUP BY ALL""",
    "stream_hourly": "SELECT strftime(kafka_ts AT TIME ZONE 'UTC', '%Y-%m-%d-%H') AS hour_bucket, source, count(*) AS cnt FROM post_messages GROUP BY ALL",
    "stream_dedup": "SELECT DISTINCT post_id FROM post_messages WHERE trim(coalesce(post_id, '')) <> ''",
    "decoded_messages": r"SELECT source, count(*) AS posts, count(TRY_CAST(CASE WHEN regexp_full_match(trim(crawled_at), '\d{4}-\d{2}-\d{2}[T ].*') THEN trim(crawled_at) END AS TIMESTAMPTZ)) AS timed FROM post_messages WHERE coalesce(text, '') <> '' GROUP BY source",
}
