"""Jobs over the tool execution log, templates and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import col, count_true
from leafmill.plans.ranges import first_rows

LOW_CONFIDENCE = 0.75


def tool_health(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Per tool: calls, successes, mean confidence, mean ms in the trailing days."""
    recent = F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))
    return runs.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("calls"),
        count_true(F.col("success")).alias("successes"),
        F.round(F.avg(F.col("success").cast("int")), 4).alias("success_share"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg(F.when(recent, F.col("execution_time_ms"))), 4).alias("recent_avg_ms"),
    )


def avg_time_by_tool(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = runs.filter(F.col("created_at") > as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("tool_name").agg(
        F.round(F.avg("execution_time_ms"), 4).alias("avg_time_ms"))


def success_by_tool(runs: DataFrame) -> DataFrame:
    return runs.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("total"),
        count_true(F.col("success")).alias("successful"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def dashboard_stats(runs: DataFrame, templates: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of headline figures; one scan of each table and one final aggregate."""
    facts = (
        runs.select(F.lit("run").alias("kind"), F.col("success").alias("flag"),
                    "confidence", "execution_time_ms")
        .unionByName(templates.select(F.lit("template").alias("kind"), F.col("is_active").alias("flag")),
                     allowMissingColumns=True)
        .unionByName(queue.select(F.lit("queued").alias("kind"), (~F.col("processed")).alias("flag")),
                     allowMissingColumns=True)
    )

    def hit(kind: str) -> Column:
        return (F.col("kind") == kind) & F.col("flag")

    total = count_true(F.col("kind") == "run")
    rate = F.try_divide(count_true(hit("run")) * 100.0, total)
    return facts.agg(
        total.alias("total_executions"),
        F.round(F.coalesce(rate, F.lit(0.0)), 1).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(hit("run"), F.col("confidence"))), F.lit(0.0)), 2)
        .alias("avg_confidence"),
        F.round(F.coalesce(F.avg(F.when(hit("run"), F.col("execution_time_ms"))), F.lit(0.0)), 1)
        .alias("avg_execution_time"),
        count_true(hit("template")).alias("total_templates"),
        count_true(hit("queued")).alias("pending_queue"),
    )


def global_stats(runs: DataFrame, templates: DataFrame, catalog: DataFrame) -> DataFrame:
    """As the dashboard, with the success share unrounded and the tool count."""
    facts = (
        runs.select(F.lit("run").alias("kind"), F.col("success").alias("flag"), "confidence")
        .unionByName(templates.select(F.lit("template").alias("kind"), F.col("is_active").alias("flag")),
                     allowMissingColumns=True)
        .unionByName(catalog.select(F.lit("tool").alias("kind"), F.lit(True).alias("flag")),
                     allowMissingColumns=True)
    )
    runs_total = count_true(F.col("kind") == "run")
    wins = count_true((F.col("kind") == "run") & F.col("flag"))
    confidence = F.avg(F.when((F.col("kind") == "run") & F.col("flag"), F.col("confidence")))
    return facts.agg(
        count_true(F.col("kind") == "tool").alias("total_tools"),
        runs_total.alias("total_executions"),
        F.coalesce(F.try_divide(wins, runs_total) * 100, F.lit(0.0)).alias("success_rate"),
        count_true((F.col("kind") == "template") & F.col("flag")).alias("total_templates"),
        F.round(F.coalesce(confidence, F.lit(0.0)), 2).alias("avg_confidence"),
    )


def recent_tool_stats(runs: DataFrame, n: int = 100) -> DataFrame:
    """Figures over the latest ``n`` runs per tool. Sums skip missing values but
    divide by all rows kept, unlike an average."""
    latest = first_rows(runs, ["tool_name"], [F.desc("created_at"), F.desc("id")], n)
    rows = F.count(F.lit(1))
    return latest.groupBy("tool_name").agg(
        rows.alias("total_executions"),
        (count_true(F.col("success")) / rows * 100).alias("success_rate"),
        F.round(F.coalesce(F.sum("confidence"), F.lit(0.0)) / rows, 2).alias("avg_confidence"),
        F.round(F.coalesce(F.sum("execution_time_ms"), F.lit(0)) / rows, 1).alias("avg_execution_time_ms"),
    )


def low_confidence(runs: DataFrame, threshold: float = LOW_CONFIDENCE, limit: int = 10) -> DataFrame:
    return newest(runs.filter(F.col("success") & (F.col("confidence") < threshold)), limit)


def newest(df: DataFrame, limit: int) -> DataFrame:
    """Latest rows by created_at, ties by id; a top-k, not a full sort."""
    return df.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)


def active_templates(templates: DataFrame, tool_name: str | None = None,
                     document_type: str | None = None, limit: int = 50) -> DataFrame:
    kept = templates.filter("is_active")
    if tool_name is not None:
        kept = kept.filter(F.col("tool_name") == tool_name)
    if document_type is not None:
        kept = kept.filter(F.col("document_type") == document_type)
    return newest(kept, limit)


def template_by_id(templates: DataFrame, template_id: int) -> DataFrame:
    return templates.filter(F.col("id") == template_id)


def queue_with_execution(queue: DataFrame, runs: DataFrame) -> DataFrame:
    run = runs.select(F.col("id").alias("execution_id"), "success", "execution_time_ms", "tool_class")
    return queue.join(run, "execution_id")


def route_low_confidence(runs: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Review-queue rows for successful runs below the threshold; stateless, so the
    same function serves a stream."""
    return runs.filter(F.col("success") & (F.col("confidence") < threshold)).select(
        "tool_name", F.col("id").alias("execution_id"), "confidence",
        F.lit(False).alias("processed"), "created_at")


def tool_metrics(runs: DataFrame, width: str = "1 hour", slide: str | None = None,
                 time: str = "created_at") -> DataFrame:
    """Windowed run figures; a stream passes the same frame with a watermark."""
    window = F.window(col(time), width, slide or width)
    return (runs.groupBy(window.alias("window"), "tool_class").agg(
        F.count(F.lit(1)).alias("calls"),
        count_true(F.col("success")).alias("successes"),
        F.round(F.avg("execution_time_ms"), 4).alias("avg_ms"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "tool_class", "calls", "successes", "avg_ms"))
