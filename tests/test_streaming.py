"""A stream over files gives what the batch form gives."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill.operators import executions, logs, requests
from leafmill.registry import Inputs
from leafmill.streaming import matching, metrics, sessions


@pytest.fixture(scope="module")
def q(spark, data_dir):
    return Inputs(spark, data_dir)


def _stream(spark, frame, folder, files=3):
    """The rows of ``frame`` as a file stream of several batches in time order."""
    frame.repartitionByRange(files, frame.columns[-1]).write.parquet(str(folder))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(str(folder))


def _run(stream, folder, name, mode="append"):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.table(name), query


def _same(got, want):
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


def test_tool_metrics(spark, q, tmp_path):
    runs = q.view("tool_executions").withColumn("created_at", F.col("created_at").cast("timestamp"))
    runs = runs.select([c for c in runs.columns if c != "created_at"] + ["created_at"])
    got, query = _run(metrics.stream_tool_metrics(_stream(spark, runs, tmp_path / "in")), tmp_path, "tm", "complete")
    _same(got, executions.tool_metrics(runs))
    assert metrics.dropped_late_rows(query) == 0


def test_log_issues(spark, q, tmp_path):
    rows = q.view("console_logs").withColumn("ts", F.col("ts").cast("timestamp"))
    got, _ = _run(metrics.stream_log_issues(_stream(spark, rows, tmp_path / "in")), tmp_path, "li", "complete")
    _same(got, logs.windowed_issues(rows))


def test_low_confidence_queue(spark, q, tmp_path):
    runs = q.view("tool_executions").withColumn("created_at", F.col("created_at").cast("timestamp"))
    twice = runs.unionByName(runs).select([c for c in runs.columns if c != "created_at"] + ["created_at"])
    stream = metrics.stream_low_confidence(_stream(spark, twice, tmp_path / "in", 1), delay="60 days")
    metrics.write_queue(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("tool_name", "execution_id", "confidence")
    _same(got, executions.route_low_confidence(runs).select("tool_name", "execution_id", "confidence"))


def test_gap_sessions(spark, q, tmp_path):
    events = q.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    got, _ = _run(sessions.stream_sessions(_stream(spark, events, tmp_path / "in"), 6 * 3600), tmp_path, "gs", "complete")
    _same(got, sessions.gap_sessions(events, 6 * 3600))


def test_request_matching(spark, q, tmp_path):
    timed = F.col("ts").cast("timestamp")
    opened = q.view("requests_sent").withColumn("ts", timed)
    closed = q.view("completions").withColumn("ts", timed)
    late = spark.createDataFrame([(-1, "/tick")], "seq bigint, url string").withColumn(
        "ts", F.expr("TIMESTAMP'2025-01-01 00:00:00'"))
    ticking = opened.unionByName(late).coalesce(1)
    ticking.write.parquet(str(tmp_path / "req"))
    closed.coalesce(1).write.parquet(str(tmp_path / "done"))
    reader = spark.readStream
    stream = matching.stream_match_requests(
        reader.schema(opened.schema).parquet(str(tmp_path / "req")),
        spark.readStream.schema(closed.schema).parquet(str(tmp_path / "done")), ttl_seconds=90 * 86400)
    got, _ = _run(stream, tmp_path, "mr")
    want = requests.match_requests_fifo(opened, closed)
    columns = ["seq", "url", "completion_seq", "status", "response_status"]
    _same(got.filter("status <> 'pending'").select(columns),
          want.filter("status <> 'pending'").select(columns))
    pending = got.filter("status = 'pending'").select("seq")
    assert pending.exceptAll(want.filter("status = 'pending'").select("seq")).count() == 0


def _in_batches(spark, frame, path, parts):
    """A stream of one batch per part, in the order of the parts."""
    for n, part in enumerate(parts):
        frame.filter(part).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # the source goes by the time of the files
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_request_matching_out_of_order_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"/u{rng.randrange(3)}", 1_700_000_000 + rng.randrange(3000), rng.random() < 0.45, rng.randrange(4)) for i in range(300)]
    frame = spark.createDataFrame(rows, "seq long, url string, at long, done boolean, part int").withColumn("ts", F.timestamp_seconds("at"))
    opened = frame.filter("NOT done").select("seq", "url", "ts", "part")
    closed = frame.filter("done").select("seq", "url", F.when(F.col("seq") % 5 == 0, "failed").otherwise("response").alias("kind"), F.lit(200).alias("status"), "ts", "part")
    last = spark.createDataFrame([(-1, "/tick", 9)], "seq long, url string, part int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000)))
    parts = [F.col("part") == p for p in (2, 0, 3, 1, 9)]
    stream = matching.stream_match_requests(
        _in_batches(spark, opened.unionByName(last), tmp_path / "req", parts), _in_batches(spark, closed, tmp_path / "done", parts[:4]), ttl_seconds=86400, delay="2 hours")
    got, _ = _run(stream, tmp_path, "mo")
    columns = ["seq", "url", "completion_seq", "status", "response_status"]
    want = requests.match_requests_fifo(opened, closed)
    _same(got.filter("status <> 'pending'").select(columns), want.filter("status <> 'pending'").select(columns))
    _same(got.filter("status = 'pending'").select("seq"), want.filter("status = 'pending'").select("seq"))


def test_expired_requests_match_nothing(spark, tmp_path):
    """A busy key expires its old requests although it never times out."""
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(s))
    opened = spark.createDataFrame([(1, "/a", 0, 0), (2, "/a", 500, 0), (9, "/tick", 90_000, 1)], "seq long, url string, s long, part int").withColumn("ts", at("s"))
    closed = spark.createDataFrame([(5, "/a", "response", 200, 400, 0)], "seq long, url string, kind string, status int, s long, part int").withColumn("ts", at("s"))
    parts = [F.col("part") == 0, F.col("part") == 1]
    stream = matching.stream_match_requests(_in_batches(spark, opened, tmp_path / "r", parts), _in_batches(spark, closed, tmp_path / "d", parts[:1]), ttl_seconds=300, delay="1 hour")
    got, _ = _run(stream, tmp_path, "ex")
    assert {(r.seq, r.status) for r in got.filter("url = '/a'").collect()} == {(1, "pending"), (2, "pending")}


def test_marked_sessions_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4), i, 1_700_000_000 + rng.randrange(2000), rng.choice(["start", "stop", None, None, None, None]), rng.randrange(3)) for i in range(250)]
    rows += [(u, 1000 + u, 1_700_050_000, "stop", 8) for u in range(4)] + [(9, 2000, 1_700_900_000, None, 9)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, at long, mark string, part int").withColumn("ts", F.timestamp_seconds("at"))
    stream = sessions.stream_marked_sessions(_in_batches(spark, events, tmp_path / "in", [F.col("part") == p for p in (1, 0, 2, 8, 9)]), delay="1 hour")
    got, _ = _run(stream, tmp_path, "ms")
    _same(got, sessions.marked_sessions(events).select(got.columns))
