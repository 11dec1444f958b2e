"""Shape of the physical plans: what must not appear at scale."""

import re
import time

import pytest
from pyspark.sql import functions as F

from leafmill import registry
from leafmill.functions.imaging import bar_pattern
from leafmill.plans.ordered import Ordered, number_rows
from leafmill.registry import Inputs
from leafmill.sources.tables import read_table
from leafmill.sources.views import RAW

QUERIES = registry.load_all()
# One-row results: their last step is one row per task by design.
ONE_ROW = {"dashboard_stats", "global_stats", "api_call_totals"}
#: Queries with pixel kernels in numpy, and those that write a table for their own later steps while they are built.
KERNELS = {"tiled_image_metrics"}
WRITES_FIRST = {"tiled_image_metrics", "near_addresses", "address_families", "latest_runs_by_outcome", "gap_sessions_by_range"}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_joins_and_no_single_partition(name, spark, data_dir):
    plan = _plan(QUERIES[name].build(Inputs(spark, data_dir)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in ONE_ROW:
        assert "Exchange SinglePartition" not in plan


def test_no_query_leaves_the_jvm(spark, data_dir):
    assert {name for name, item in QUERIES.items() if re.search("Python|InPandas|Arrow", _plan(item.build(Inputs(spark, data_dir))))} == KERNELS


def test_building_a_query_runs_no_job(spark, data_dir):
    tracker = spark.sparkContext.statusTracker()
    # Schemas of the tables are read by jobs of their own; they are read here once.
    for table in RAW:
        read_table(spark, data_dir, table).schema
    for name, item in QUERIES.items():
        inputs = Inputs(spark, data_dir)
        inputs._opened.update({table: read_table(spark, data_dir, table) for table in RAW})
        inputs.table = inputs._opened.__getitem__
        spark.sparkContext.setJobGroup(f"building {name}", name)
        item.build(inputs)
        assert bool(tracker.getJobIdsForGroup(f"building {name}")) == (name in WRITES_FIRST), name
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_request_matching_scans_each_input_twice(spark, data_dir):
    plan = _plan(QUERIES["match_requests_fifo"].build(Inputs(spark, data_dir)))
    assert plan.count("FileScan parquet") <= 4 and plan.count("Join") == 1


def test_loan_arithmetic_is_generated_code(spark, data_dir):
    plan = _plan(QUERIES["loan_book"].build(Inputs(spark, data_dir)))
    assert "lambda" not in plan


def test_pixel_rules_are_linear(spark):
    """Sixteen times the pixels may take about sixteen times as long, not 256 times."""
    def seconds(side):
        image = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(side * side)), lambda i: ((i * 37) % 256).cast("int")).alias("gray"))
        started = time.perf_counter()
        image.select(bar_pattern(F.col("gray"), F.lit(side), F.lit(side)).alias("b")).collect()
        return time.perf_counter() - started
    seconds(16)
    assert seconds(256) < 40 * max(0.2, seconds(64))


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    plan = _plan(QUERIES["template_by_id"].build(Inputs(spark, data_dir)))
    assert "EqualTo(p_partkey,17)" in plan
    plan = _plan(QUERIES["log_issues"].build(Inputs(spark, data_dir)))
    assert "ReadSchema: struct<value:double>" in plan


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_key_is_spread_over_tasks(spark, uncoalesced):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    numbered = number_rows(rows, "no", Ordered(["k"], ["n"], F.floor(F.col("n") / 1000)))
    hot = numbered.filter("k = -1")
    assert hot.select(F.spark_partition_id()).distinct().count() > 4
    assert hot.agg(F.max("no"), F.count("no")).first()[:] == (10000, 10000)


def test_carry_join_does_not_shuffle_the_rows_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), F.lit("wide").alias("text"))
        numbered = number_rows(rows, "no", Ordered(["k"], ["n"], F.floor(F.col("n") / 10)))
        shuffles = [line for line in _plan(numbered).splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows once; block totals, their order by key, and their way to the rows.
    assert len(shuffles) == 4
