"""Rows that come too late for a stream's windows: kept apart and counted, not dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leafmill.sources.ledger import Folder


def _micros(span: str) -> Column:
    """A span like ``10 minutes`` in microseconds."""
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {span}"))


def gate_late_rows(stream: DataFrame, path: str, checkpoint: str, time: str, delay: str, width: str | None = None,
                   slide: str | None = None, **trigger) -> StreamingQuery:
    """Split a stream into rows in time and rows that a watermark of ``delay`` would drop, and store both.

    A row is late when its time (with ``width`` the end of its last window) is not after the watermark: the
    latest time in earlier batches less ``delay``. Rows without a time count as late. Each batch is one folder that is moved
    into place, with the latest time beside it; a batch that is run again replaces itself, so counts stay right
    over restarts. A stream over ``on_time_rows`` with the same delay drops none of them: its watermark is never ahead.
    """
    spark = stream.sparkSession
    folder = Folder(spark, path)

    def store(batch: DataFrame, number: int) -> None:
        at = F.col(time).cast("timestamp")
        before = folder.read(f"marks/{number - 1}.json")["latest"] if number else None
        micros = F.unix_micros(at)  # not by ``window``, which leaves out rows without a time
        closes = micros - F.pmod(micros, _micros(slide or width)) + _micros(width) if width else micros
        late = at.isNull()
        if before is not None:
            late = late | (closes <= F.lit(before) - _micros(delay))
        seen, draft = Observation(), f"drafts/{uuid.uuid4().hex}"
        split = batch.withColumn("late", F.coalesce(late, F.lit(True))).observe(seen, F.max(F.unix_micros(at)).alias("latest"))
        split.write.partitionBy("late").parquet(f"{path}/{draft}")
        times = [t for t in (before, seen.get["latest"]) if t is not None]
        # The mark first: without the rows it does no harm, and the batch will be run again.
        folder.drop(f"marks/{number}.json")
        folder.put(f"marks/{number}.json", {"latest": max(times) if times else None})
        folder.replace(draft, f"rows/batch={number}")

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def on_time_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the rows that passed ``gate_late_rows``."""
    return spark.readStream.schema(schema).parquet(f"{path}/rows/batch=*/late=false")


def late_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that ``gate_late_rows`` held back, with the number of their ``batch``."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long").add("late", "boolean")).parquet(f"{path}/rows")
    return rows.filter("late").drop("late")
