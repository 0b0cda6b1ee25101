"""Readers and writers of line JSON, keyed message streams and bucketed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a post on the wire.
WIRE = "post_id string, text string, url string, source string, timestamp string, crawled_at string"


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Line JSON with a fixed schema; malformed lines are dropped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def line_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """lines, malformed: how many lines there are and how many of them read_lines drops."""
    bad = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"]
    return spark.read.text(path).filter(F.trim("value") != "").select(bad.alias("bad")).agg(F.count("*").alias("lines"), F.count("bad").alias("malformed"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 of each file of a path; a file is read as one value."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Line JSON, UTF-8, without escapes of letters."""
    rows.write.mode("overwrite").json(path)


def decode(messages: DataFrame, schema: str = WIRE, value: str = "value", arrived: str = "timestamp") -> DataFrame:
    """Fields of the JSON values of a message stream (value binary or string, timestamp), and kafka_ts.

    A malformed value gives null fields; rows without text are dropped by usable(), not here.
    """
    parsed = messages.select(F.from_json(F.col(value).cast("string"), schema).alias("data"), F.col(arrived).alias("kafka_ts"))
    return parsed.select("data.*", "kafka_ts")


def usable(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("text").isNotNull() & (F.col("text") != ""))


def dead_letters(messages: DataFrame, schema: str = WIRE, value: str = "value") -> DataFrame:
    """Messages whose value is no object of the schema with a text: value, reason."""
    data = F.from_json(F.col(value).cast("string"), schema)
    reason = F.when(data.isNull() | (data["post_id"].isNull() & data["text"].isNull()), "malformed").when(F.coalesce(data["text"], F.lit("")) == "", "no text")
    return messages.select(F.col(value).cast("string").alias("value"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def encode(rows: DataFrame, key: str) -> DataFrame:
    """key, value of a keyed message sink."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def kafka_source(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """The stream of a topic; needs the connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "latest").option("failOnDataLoss", "false")
    return (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()


def kafka_sink(rows: DataFrame, servers: str, topic: str) -> None:
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.compression.type", "snappy").option("kafka.linger.ms", "100").save()


def write_bucketed(rows: DataFrame, path: str, bucket: str, order: list[Column] | None = None, mode: str = "append") -> None:
    """A table with one folder for each time bucket, ordered inside the files so that row groups can be skipped."""
    spread = rows.repartition(bucket) if order is None else rows.repartition(bucket).sortWithinPartitions(bucket, *order)
    spread.write.mode(mode).partitionBy(bucket).parquet(path)


def read_buckets(spark: SparkSession, path: str, bucket: str, first: str, last: str) -> DataFrame:
    """The buckets from first to last; only their folders are read."""
    return spark.read.parquet(path).filter(F.col(bucket).between(first, last))


def drop_before(spark: SparkSession, path: str, bucket: str, first: str) -> list[str]:
    """Retention: removes the folders of buckets before first; gives their names."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{bucket}=") and name.split("=", 1)[1] < first:
            files.delete(status.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)


def write_report(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)
