import json
import uuid

from pyspark.sql import functions as F

from tidewell.session import shared_folder
from tidewell.sources import io, pages
from tidewell.streaming import pipeline


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_lines_skip_what_is_malformed(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "ế"}\nnot json\n{"a": 2}\n', encoding="utf-8")
    assert sorted((r.a, r.b) for r in io.read_lines(spark, str(path), "a int, b string").collect()) == [(1, "ế"), (2, None)]
    io.write_lines(io.read_lines(spark, str(path), "a int, b string"), str(tmp_path / "out"))
    assert "ế" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))


def test_buckets_and_retention(spark):
    path = folder(spark, "buckets")
    io.write_bucketed(spark.createDataFrame([("2026-01-01-00", 1), ("2026-01-01-05", 2), ("2026-01-02-00", 3)], "hour_bucket string, v int"), path, "hour_bucket", [F.asc("v")])
    kept = io.read_buckets(spark, path, "hour_bucket", "2026-01-01-01", "2026-01-02-00")
    assert sorted(r.v for r in kept.collect()) == [2, 3] and "PartitionFilters: [isnotnull(hour_bucket" in kept._jdf.queryExecution().toString()
    assert io.drop_before(spark, path, "hour_bucket", "2026-01-02-00") == ["2026-01-01-00", "2026-01-01-05"]


def test_pages(spark):
    html = '<div class="structItem-title"><a href="/t/a.12/">Tiêu đề</a></div><time datetime="2026-01-01T00:00:00Z"></time><div class="bbWrapper"><blockquote class="bbCodeBlock--quote">old</blockquote>first<br>line ' + "x" * 60 + '<div class="bbCodeSpoiler">no</div></div><div class="bbWrapper">second</div><a class="pageNav-jump pageNav-jump--next">'
    rows = spark.createDataFrame([("https://b/t/a.12/", html), ("https://b/t/c.3", "<p>short"), ("x", None)], "url string, html string")
    got = pages.first_posts(rows).collect()
    assert [(r.post_id, r.text) for r in got] == [("12", "first\nline " + "x" * 60)]
    assert [(r.url, r.title) for r in pages.links(rows, "https://b").collect()] == [("https://b/t/a.12/", "Tiêu đề")]
    assert [r.n for r in rows.select(pages.has_next(F.col("html")).alias("n")).collect()] == [True, False, False]


def test_stream_of_messages(spark, tmp_path):
    source, work = tmp_path / "in", folder(spark, "stream")
    source.mkdir()
    good = [json.dumps({"post_id": f"p{i % 3}", "text": "hello", "source": "s", "timestamp": "2026-01-01T00:00:00Z"}) for i in range(6)]
    (source / "a.txt").write_text("\n".join([*good, "broken", '{"post_id": "q", "text": ""}']))
    stats: list = []
    writer = pipeline.batch_writer(f"{work}/out", stats, f"{work}/bad", lambda b: io.usable(io.decode(b)))
    messages = pipeline.messages_from_files(spark, str(source))
    pipeline.run_once(messages, "", f"{work}/check", writer=writer)
    assert spark.read.parquet(f"{work}/out").count() == 6 and stats[0].rows == 6
    assert sorted(r.reason for r in spark.read.parquet(f"{work}/bad").collect()) == ["malformed", "no text"]
    writer(io.dead_letters(spark.createDataFrame([("x",)], "value string")).withColumn("timestamp", F.current_timestamp()), 0)  # the same batch again replaces its folder
    assert spark.read.parquet(f"{work}/out").count() == 0


def test_late_rows_and_repeats_are_dropped(spark):
    source, work = folder(spark, "events"), folder(spark, "windows")
    batches = [[("a", "2026-01-01 10:05:00"), ("a", "2026-01-01 10:06:00"), ("b", "2026-01-01 13:00:00")], [("c", "2026-01-01 13:10:00")], [("late", "2026-01-01 10:10:00"), ("d", "2026-01-01 18:00:00")], [("e", "2026-01-01 23:00:00")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "post_id string, at string").select("post_id", F.to_timestamp("at").alias("at"), F.lit("s").alias("source")).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    stream = spark.readStream.schema("post_id string, at timestamp, source string").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    pipeline.run_once(pipeline.windowed(stream, "at", "source"), f"{work}/out", f"{work}/check")
    got = {r.hour_bucket: r.cnt for r in spark.read.parquet(f"{work}/out").collect()}
    assert got["2026-01-01-10"] == 1 and got["2026-01-01-13"] == 2


def test_a_running_stream_is_stopped_between_batches(spark, tmp_path):
    source, work = tmp_path / "in", folder(spark, "running")
    source.mkdir()
    (source / "a.txt").write_text("x\ny")
    query = pipeline.started(pipeline.messages_from_files(spark, str(source)), f"{work}/out", f"{work}/check", every="1 second")
    query.processAllAvailable()
    pipeline.stopped(query)
    assert not query.isActive and spark.read.parquet(f"{work}/out").count() == 2
    (source / "b.txt").write_text("z")
    progress = pipeline.Progress()
    pipeline.run_once(pipeline.messages_from_files(spark, str(source)).withWatermark("timestamp", "1 hour"), f"{work}/out", f"{work}/check", progress=progress)
    assert spark.read.parquet(f"{work}/out").count() == 3
    assert sum(b["rows"] for b in progress.seen) == 1 and {"offsets_behind", "event_lag_seconds"} <= set(progress.seen[0])


def test_counts_and_digests_of_files(spark, tmp_path):
    import hashlib

    lines = '{"a": 1}\nbroken\n{"a": 2}\n'
    (tmp_path / "x.json").write_text(lines)
    assert tuple(io.line_counts(spark, str(tmp_path), "a int").first()) == (3, 1)
    assert io.file_digests(spark, str(tmp_path)).first()["md5"] == hashlib.md5(lines.encode()).hexdigest()
