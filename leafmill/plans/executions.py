"""Queries over the execution log."""

from pyspark.sql import functions as F

from leafmill.functions.common import stamp
from leafmill.operators import executions as ops
from leafmill.plans.ranges import first_rows
from leafmill.registry import Inputs, query


def as_of():
    return F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")


@query("tool_health", ["S1", "Q1", "A3", "A4"], """
    SELECT tool_name, count(*) AS calls, count(*) FILTER (success) AS successes,
           round(avg(success::INT), 4) AS success_share, round(avg(confidence), 4) AS avg_confidence,
           round(avg(execution_time_ms) FILTER (created_at >= TIMESTAMP '2024-01-24'), 4) AS recent_avg_ms
    FROM tool_executions GROUP BY tool_name""")
def tool_health(q: Inputs):
    return ops.tool_health(q.view("tool_executions"), as_of())


@query("avg_time_by_tool", ["A3"], """
    SELECT tool_name, round(avg(execution_time_ms), 4) AS avg_time_ms FROM tool_executions
    WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY tool_name""")
def avg_time_by_tool(q: Inputs):
    return ops.avg_time_by_tool(q.view("tool_executions"), as_of())


@query("success_by_tool", ["A4"], """
    SELECT tool_name, count(*) AS total, count(*) FILTER (success) AS successful,
           round(avg(confidence), 4) AS avg_confidence FROM tool_executions GROUP BY tool_name""")
def success_by_tool(q: Inputs):
    return ops.success_by_tool(q.view("tool_executions"))


@query("dashboard_stats", ["A1"], """
    SELECT (SELECT count(*) FROM tool_executions) AS total_executions,
           (SELECT round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 1) FROM tool_executions) AS success_rate,
           (SELECT round(avg(confidence), 2) FROM tool_executions WHERE success) AS avg_confidence,
           (SELECT round(avg(execution_time_ms), 1) FROM tool_executions WHERE success) AS avg_execution_time,
           (SELECT count(*) FROM tool_templates WHERE is_active) AS total_templates,
           (SELECT count(*) FROM training_queue WHERE NOT processed) AS pending_queue""")
def dashboard_stats(q: Inputs):
    return ops.dashboard_stats(q.view("tool_executions"), q.view("tool_templates"), q.view("training_queue"))


@query("global_stats", ["A2"], """
    SELECT (SELECT count(*) FROM tool_catalog) AS total_tools, count(*) AS total_executions,
           count(*) FILTER (success) / count(*)::DOUBLE * 100 AS success_rate,
           (SELECT count(*) FROM tool_templates WHERE is_active) AS total_templates,
           round(avg(confidence) FILTER (success), 2) AS avg_confidence
    FROM tool_executions""")
def global_stats(q: Inputs):
    return ops.global_stats(q.view("tool_executions"), q.view("tool_templates"), q.view("tool_catalog"))


@query("recent_tool_stats", ["A5", "W12"], """
    SELECT tool_name, count(*) AS total_executions,
           count(*) FILTER (success) / count(*)::DOUBLE * 100 AS success_rate,
           round(coalesce(sum(confidence), 0) / count(*), 2) AS avg_confidence,
           round(coalesce(sum(execution_time_ms), 0)::DOUBLE / count(*), 1) AS avg_execution_time_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY tool_name ORDER BY created_at DESC, id DESC) AS rn
          FROM tool_executions) WHERE rn <= 25 GROUP BY tool_name""")
def recent_tool_stats(q: Inputs):
    return ops.recent_tool_stats(q.view("tool_executions"), 25)


@query("latest_runs_by_outcome", ["A5", "W12"], """
    SELECT success, id, (row_number() OVER (PARTITION BY success ORDER BY created_at DESC, id DESC))::INT AS rank
    FROM tool_executions QUALIFY rank <= 5000""")
def latest_runs_by_outcome(q: Inputs):
    """More rows per key than are trimmed before the shuffle, and two keys for all rows."""
    return first_rows(q.view("tool_executions"), ["success"], [F.desc("created_at"), F.desc("id")], 5000).select("success", "id", "rank")


@query("low_confidence", ["F3", "T1"], """
    SELECT id, tool_name, confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created
    FROM tool_executions WHERE success AND confidence < 0.75
    ORDER BY created_at DESC, id DESC LIMIT 10""")
def low_confidence(q: Inputs):
    rows = ops.low_confidence(q.view("tool_executions"))
    return rows.select("id", "tool_name", "confidence", stamp("created_at").alias("created"))


@query("active_templates", ["F1", "T1"], """
    SELECT id, tool_name, document_type, logo_name, precision_rate FROM tool_templates
    WHERE is_active AND document_type = 'id_card'
    ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50""")
def active_templates(q: Inputs):
    rows = ops.active_templates(q.view("tool_templates"), document_type="id_card")
    return rows.select("id", "tool_name", "document_type", "logo_name", "precision_rate")


@query("template_by_id", ["F2"], """
    SELECT id, tool_name, document_type, logo_name, is_active, precision_rate
    FROM tool_templates WHERE id = 17""")
def template_by_id(q: Inputs):
    return ops.template_by_id(q.view("tool_templates"), 17).select(
        "id", "tool_name", "document_type", "logo_name", "is_active", "precision_rate")


@query("queue_with_execution", ["J5"], """
    SELECT q.execution_id, q.id, q.tool_name, q.confidence, q.processed, e.success,
           e.execution_time_ms, e.tool_class
    FROM training_queue q JOIN tool_executions e ON q.execution_id = e.id""")
def queue_with_execution(q: Inputs):
    return ops.queue_with_execution(q.view("training_queue"), q.view("tool_executions")).drop("created_at")
