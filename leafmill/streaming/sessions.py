"""Sessions of captured events, by gap or by explicit markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.plans.ordered import Ordered
from leafmill.plans.ranges import blocks
from leafmill.streaming.ordered import in_order


def _session_columns(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def gap_sessions(events: DataFrame, gap_seconds: int = 1800, block: str = "day") -> DataFrame:
    """Sessions per user closed by a quiet gap. The static form cuts a busy user's
    events into blocks, which a session window would keep in one task. ``block`` is the span of
    time of a block, or ``range`` for blocks of equal depth."""
    def breaks(row: Column, prior: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", prior["ts"], row["ts"]) >= gap_seconds * 1_000_000

    rows, at = blocks(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], block)
    cut = Ordered(["user_id"], ["ts", "event_id"], at).segments(rows, ["ts"], breaks)
    return _session_columns(cut.groupBy("user_id", "segment")).select("user_id", "first_ts", "last_ts", "events")


def stream_sessions(events: DataFrame, gap_seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    window = F.session_window("ts", f"{gap_seconds} seconds")
    return _session_columns(timed.groupBy("user_id", window)).select("user_id", "first_ts", "last_ts", "events")


def marked_sessions(events: DataFrame, block: str = "day") -> DataFrame:
    """Events captured between ``start`` and ``stop`` marks, numbered per user.

    A ``start`` opens a new capture even if one is open. Works on a static frame
    with columns user_id, ts, event_id and mark (start, stop or NULL). ``block`` is the
    time span that one task takes of a busy user, or ``range`` for blocks of equal depth.
    """
    events, at = blocks(events, ["user_id"], ["ts", "event_id"], block)
    order = Ordered(["user_id"], ["ts", "event_id"], at)
    last_mark = F.when(F.col("mark").isNotNull(), F.struct("ts", "event_id", "mark"))
    staged = order.carry(
        events,
        {"starts_in": F.sum((F.col("mark") == "start").cast("int")).over(order.upto),
         "mark_in": F.max(last_mark).over(order.upto)},
        {"starts_sum": F.sum((F.col("mark") == "start").cast("int")), "mark_top": F.max(last_mark)},
        {"starts_was": F.sum("starts_sum").over(order.earlier), "mark_was": F.max("mark_top").over(order.earlier)})
    state = F.coalesce("mark_in", "mark_was")["mark"]
    number = F.coalesce("starts_in", F.lit(0)) + F.coalesce("starts_was", F.lit(0))
    captured = staged.withColumn("session_no", number).filter(F.col("mark").isNull() & (state == "start"))
    return captured.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"))


def stream_marked_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Marked sessions of a stream (user_id, session_no, events, first_event, last_event), each
    when a mark closes it; events may arrive out of order within ``delay``. State per
    user is one open session and the events younger than the watermark."""
    def close(memory: dict, out: list) -> None:
        if memory.get("events"):
            out.append({"session_no": memory["no"], "events": memory["events"], "first_event": memory["first"], "last_event": memory["last"]})
        memory["events"] = 0

    def handle(memory: dict, event: dict, out: list) -> None:
        if event["mark"]:
            close(memory, out)
            memory["open"] = event["mark"] == "start"
            memory["no"] = memory.get("no", 0) + memory["open"]
        elif memory.get("open"):
            if not memory["events"]:
                memory["first"] = memory["last"] = event["event_id"]
            memory["events"] += 1
            memory["first"], memory["last"] = min(memory["first"], event["event_id"]), max(memory["last"], event["event_id"])

    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "mark").withWatermark("ts", delay)
    return in_order(timed, "user_id", "event_id", "session_no BIGINT, events BIGINT, first_event BIGINT, last_event BIGINT", handle)
