"""Streams of posts: decoding, scoring, keyed tables, windowed counters, late data and dead letters."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.io import dead_letters, decode, usable

LATENESS = "1 hour"


def enriched(posts: DataFrame, prediction: Column, version: str) -> DataFrame:
    """Posts with their hour bucket, parsed time, prediction and audit columns."""
    rows = usable(posts).withColumns({"hour_bucket": F.date_format(F.current_timestamp(), "yyyy-MM-dd-HH"), "original_timestamp": F.coalesce(F.try_to_timestamp("timestamp"), F.try_to_timestamp("crawled_at"))})
    rows = rows.withColumn("prediction", prediction).select("*", "prediction.*").drop("prediction", "timestamp", "failed")
    return rows.withColumns({"classified_at": F.current_timestamp(), "model_version": F.lit(version)})


def batch_writer(path: str, stats: list | None = None, rejected: str | None = None, source: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch function: the batch is kept while it is written and counted, and a batch that comes again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            rows = source(batch) if source else batch
            rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            if rejected:
                dead_letters(batch).write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
            if stats is not None:
                done = spark.read.parquet(f"{path}/batch_id={batch_id}")
                stats.append(done.agg(F.lit(batch_id).alias("batch_id"), F.count("*").alias("rows"), F.count_if("stressed").alias("stressed") if "stressed" in done.columns else F.lit(0).alias("stressed")).first())
        finally:
            batch.unpersist()

    return write


def windowed(posts: DataFrame, at: str, key: str, every: str = "1 hour", late: str = LATENESS, dedup: str | None = "post_id") -> DataFrame:
    """Counts by event-time window and key; rows later than the watermark and repeated ids inside it are dropped."""
    rows = posts.withWatermark(at, late)
    if dedup:
        rows = rows.dropDuplicatesWithinWatermark([dedup])
    counts = rows.groupBy(F.window(at, every), key).agg(F.count("*").alias("cnt"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd-HH").alias("hour_bucket"), key, "cnt")


def unique(posts: DataFrame, at: str, key: str = "post_id", late: str = LATENESS) -> DataFrame:
    return posts.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", writer=None, progress: Progress | None = None) -> StreamingQuery:
    """Everything there is now, in as many batches as the source's limits make, then stop."""
    return _run(stream, path, checkpoint, mode, writer, progress, {"availableNow": True})


def started(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", writer=None, every: str = "10 seconds") -> StreamingQuery:
    """A stream that runs on, with a batch at each interval."""
    return _start(stream, path, checkpoint, mode, writer, {"processingTime": every})


def stopped(query: StreamingQuery, seconds: float = 60.0) -> None:
    """Ends a stream between two batches: a batch that runs is waited for, up to some seconds, then the query is stopped."""
    end = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.1)
    query.stop()
    query.awaitTermination()


def _start(stream: DataFrame, path: str, checkpoint: str, mode: str, writer, trigger: dict) -> StreamingQuery:
    start = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    return (start.foreachBatch(writer) if writer else start.format("parquet").option("path", path)).start()


def _run(stream: DataFrame, path: str, checkpoint: str, mode: str, writer, progress: Progress | None, trigger: dict) -> StreamingQuery:
    streams = stream.sparkSession.streams
    if progress is not None:
        streams.addListener(progress)
    try:
        query = _start(stream, path, checkpoint, mode, writer, trigger)
        query.awaitTermination()
    finally:
        if progress is not None:
            stream.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            streams.removeListener(progress)
    return query


def messages_from_files(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream with the shape of a topic (value, timestamp) out of text files."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select("value", F.current_timestamp().alias("timestamp"))


def posts_from(messages: DataFrame) -> DataFrame:
    return decode(messages)


class Progress(StreamingQueryListener):
    """Rows, speed and lag of each batch: offsets behind the source's last one (where it tells), and seconds from the watermark to the latest event."""

    def __init__(self):
        self.seen: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        behind = [float(m["maxOffsetsBehindLatest"]) for s in p.sources if "maxOffsetsBehindLatest" in (m := s.metrics or {})]
        times = {k: datetime.datetime.fromisoformat(v) for k, v in (p.eventTime or {}).items() if k in ("max", "watermark")}
        lag = (times["max"] - times["watermark"]).total_seconds() if len(times) == 2 else None
        self.seen.append({"batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond, "milliseconds": p.batchDuration, "offsets_behind": max(behind, default=None), "event_lag_seconds": lag})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
