"""Streaming run metrics, review routing and log issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import executions, logs


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def stream_tool_metrics(runs: DataFrame, width: str = "1 hour", delay: str = "10 minutes",
                        slide: str | None = None) -> DataFrame:
    """Windowed run figures; rows later than the watermark are dropped."""
    return executions.tool_metrics(_timed(runs, "created_at", delay), width, slide)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far, from the recent progress reports."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def stream_low_confidence(runs: DataFrame, threshold: float = executions.LOW_CONFIDENCE,
                          delay: str = "10 minutes") -> DataFrame:
    """Review-queue rows, each run once even when the source repeats it."""
    routed = executions.route_low_confidence(_timed(runs, "created_at", delay), threshold)
    return routed.dropDuplicatesWithinWatermark(["execution_id"])


def write_queue(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append routed rows, one folder per batch: a batch that is run again after
    a failure replaces its own folder, so no row is stored twice."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_log_issues(log_stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return logs.windowed_issues(_timed(log_stream, "ts", delay), width)
