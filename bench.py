"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Each query is
written to the no-op sink, so that every column is computed in full.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from leafmill import registry
from leafmill.session import build_session
from leafmill.sources.tables import read_table
from leafmill.sources.views import RAW

HEADLINE = [
    "tool_health", "dashboard_stats", "recent_tool_stats", "calls_by_category", "text_stats",
    "search_text", "page_numbers", "split_pages", "doc_urls", "table_blocks", "log_issues", "api_calls",
    "match_requests_fifo", "bug_hypotheses", "normalize_address", "parse_currency", "parse_date", "validate_sin",
    "loan_book", "income_history", "authority_documents", "tax_forms", "fiscal_year_vote", "image_metrics",
    "document_boundaries", "pair_card_sides", "page_quality", "parse_detections", "address_edit_similarity",
    "gap_sessions",
]


def _dealt(spark, path: str, cpus: int) -> str:
    """Copies of the tables with one file per core. A generated table is one row group, which
    no setting splits; a large one has many. The copying is not timed."""
    to = tempfile.mkdtemp(prefix="spark-")
    for name in RAW:
        read_table(spark, path, name).repartition(cpus).write.parquet(f"{to}/{name}.parquet")
    return to


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.callables()
    path = _dealt(spark, path, int(cpus))
    queries["tool_health"](spark, path).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
