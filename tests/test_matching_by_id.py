"""Request matching by request id, over batches."""

import random
import time

from pyspark.sql import functions as F
import pytest

from leafmill.operators import requests
from leafmill.streaming import matching


def test_a_busy_url_is_spread_by_request_id(spark, tmp_path):
    """All requests go to one URL; each completion names its request, and they come in any order."""
    draw = random.Random(7)
    rows = [(i, "/hot", f"r{i}", 1_700_000_000 + draw.randrange(2000), draw.randrange(2)) for i in range(80)]
    opened = spark.createDataFrame(rows, "seq long, url string, request_id string, at long, part int").withColumn("ts", F.timestamp_seconds("at"))
    closed = opened.filter("seq % 4 > 0").select((F.col("seq") + 1000).alias("seq"), "request_id", F.when(F.col("seq") % 5 == 0, "failed").otherwise("response").alias("kind"),
                                                 F.lit(200).alias("status"), (F.col("ts") + F.expr("INTERVAL 30 seconds")).alias("ts"), (1 - F.col("part")).alias("part"))
    last = spark.createDataFrame([(-1, "/tick", "tick", 1_700_200_000, 2)], "seq long, url string, request_id string, at long, part int").withColumn("ts", F.timestamp_seconds("at"))
    for name, frame, parts in (("o", opened.unionByName(last), (0, 1, 2)), ("c", closed, (0, 1))):
        for part in parts:
            frame.filter(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(1.1)
    read = lambda name, frame: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    stream = matching.stream_match_requests(read("o", opened), read("c", closed), ttl_seconds=3600, delay="2 hours")
    query = stream.writeStream.format("memory").queryName("by_id").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["seq", "completion_seq", "status", "response_status"]
    got = {r.seq: tuple(r) for r in spark.table("by_id").select(columns).collect()}
    want = {r.seq: tuple(r) for r in requests.match_requests_fifo(opened, closed, "request_id").select(columns).collect()}
    assert got == want and len(got) == 80
    # State left is the open tick alone: a row for each event that is not settled, none for the others.
    assert sum(op.numRowsTotal for op in query.lastProgress.stateOperators) <= 8


def test_the_store_must_be_named(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS seq", "'u' AS url", "timestamp AS ts", "'x' AS kind", "1 AS status")
    before = spark.conf.get(matching.STORE)
    spark.conf.unset(matching.STORE)
    try:
        if spark.conf.get(matching.STORE, "") != matching.ROCKS:
            with pytest.raises(ValueError):
                matching.stream_match_requests(stream, stream)
    finally:
        spark.conf.set(matching.STORE, before)
