"""Batch forms of the streaming jobs; tests check that a stream gives the same."""

from pyspark.sql import functions as F

from leafmill.functions.common import stamp
from leafmill.operators import executions as runs
from leafmill.registry import Inputs, query
from leafmill.streaming import sessions

_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@query("tool_metrics", ["X1"], f"""
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, created_at), {_STAMP}) AS window_start, tool_class,
           count(*) AS calls, count(*) FILTER (success) AS successes, round(avg(execution_time_ms), 4) AS avg_ms
    FROM tool_executions GROUP BY 1, tool_class""")
def tool_metrics(q: Inputs):
    rows = runs.tool_metrics(q.view("tool_executions"))
    return rows.withColumn("window_start", stamp("window_start")).drop("window_end")


@query("sliding_tool_metrics", ["X1"], f"""
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, created_at) - k * INTERVAL 1 HOUR, {_STAMP}) AS window_start,
           tool_class, count(*) AS calls, count(*) FILTER (success) AS successes,
           round(avg(execution_time_ms), 4) AS avg_ms
    FROM tool_executions, (SELECT unnest([0, 1]) AS k) GROUP BY 1, tool_class""")
def sliding_tool_metrics(q: Inputs):
    rows = runs.tool_metrics(q.view("tool_executions"), "2 hours", "1 hour")
    return rows.withColumn("window_start", stamp("window_start")).drop("window_end")


@query("route_low_confidence", ["X2"], """
    SELECT tool_name, id AS execution_id, confidence, false AS processed FROM tool_executions
    WHERE success AND confidence < 0.75""")
def route_low_confidence(q: Inputs):
    return runs.route_low_confidence(q.view("tool_executions")).drop("created_at")


_GAPS = f"""
    WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS brk FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
    SELECT user_id, strftime(min(ts), {_STAMP}) AS first_ts, strftime(max(ts), {_STAMP}) AS last_ts, count(*) AS events
    FROM s GROUP BY user_id, no"""


@query("gap_sessions", ["X5"], _GAPS)
def gap_sessions(q: Inputs):
    return sessions.gap_sessions(q.table("events"), 6 * 3600).withColumns(
        {"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")})


@query("gap_sessions_by_range", ["X5"], _GAPS)
def gap_sessions_by_range(q: Inputs):
    return sessions.gap_sessions(q.table("events"), 6 * 3600, "range").withColumns(
        {"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")})


@query("marked_sessions", ["X5"], """
    WITH m AS (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' END AS mark FROM events),
         s AS (SELECT *, sum((mark = 'start')::INT) OVER w AS session_no,
                      last_value(mark IGNORE NULLS) OVER w AS state FROM m
               WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, session_no::BIGINT AS session_no, count(*) AS events, min(event_id) AS first_event,
           max(event_id) AS last_event
    FROM s WHERE mark IS NULL AND state = 'start' GROUP BY user_id, session_no""")
def marked_sessions(q: Inputs):
    mark = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop")
    return sessions.marked_sessions(q.table("events").withColumn("mark", mark))
