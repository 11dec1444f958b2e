"""Jobs over captured console messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import any_of, contains_ignoring_case, count_true, first_match
from leafmill.plans.ranges import first_rows

ERROR_TYPES = ["error", "pageerror"]

# Problem categories and their patterns over lower-cased text, in order.
ISSUE_PATTERNS = {
    "network": [
        r"failed to load",
        r"net::err_",
        r"fetch.*failed",
        r"xmlhttprequest.*error",
        r"cors.*blocked",
        r"404.*not found",
        r"500.*internal server",
    ],
    "javascript": [
        r"uncaught.*error",
        r"syntaxerror",
        r"typeerror",
        r"referenceerror",
        r"rangeerror",
        r"cannot read property",
        r"undefined is not",
        r"null is not",
    ],
    "react": [
        r"react.*error",
        r"component.*unmounted",
        r"invalid hook call",
        r"maximum update depth",
        r"cannot update.*unmounted",
    ],
    "vue": [r"vue.*warn", r"vue.*error", r"unknown custom element"],
    "security": [r"content security policy", r"blocked.*mixed content", r"insecure.*request"],
    "deprecation": [r"deprecated", r"will be removed", r"legacy.*feature"],
}
CRITICAL_CATEGORIES = ["javascript", "security"]


def is_error(include_warnings: bool = False) -> Column:
    return F.col("type").isin(ERROR_TYPES + (["warning"] if include_warnings else []))


def log_errors(logs: DataFrame, include_warnings: bool = False) -> DataFrame:
    return logs.filter(is_error(include_warnings))


def error_counts(logs: DataFrame, *by: str, include_warnings: bool = False) -> DataFrame:
    count = count_true(is_error(include_warnings))
    return logs.groupBy(*by).agg(count.alias("error_count"), (count > 0).alias("has_errors"))


def logs_by_type(logs: DataFrame, log_type: str | None = None) -> DataFrame:
    return logs if log_type is None else logs.filter(F.col("type") == log_type)


def type_counts(logs: DataFrame, log_type: str | None = None) -> DataFrame:
    """Counts per type over all rows, marked where the filter keeps the type."""
    kept = F.lit(True) if log_type is None else F.col("type") == log_type
    return logs.groupBy("type").agg(F.count(F.lit(1)).alias("by_type")).withColumn("selected", kept)


def search_logs(logs: DataFrame, text: str) -> DataFrame:
    return logs.filter(contains_ignoring_case("text", text))


def issue_hits(logs: DataFrame) -> DataFrame:
    """One row per log and category it falls in, with the first pattern that matched.

    A log is tested once per category by the joined patterns; it is never
    multiplied by a rule table. Which pattern it was is only asked of the hits,
    and not at all when the caller drops that column.
    """
    staged = logs.withColumn("__low", F.lower("text"))
    hits = [F.when(F.regexp_like("__low", F.lit("|".join(patterns))), F.lit(category))
            for category, patterns in ISSUE_PATTERNS.items()]
    found = staged.withColumn("category", F.explode(F.array_compact(F.array(*hits))))
    pattern = first_match([
        (F.col("category") == category, first_match(
            [(F.regexp_like("__low", F.lit(p)), F.lit(p)) for p in patterns]))
        for category, patterns in ISSUE_PATTERNS.items()])
    return found.withColumn("pattern", pattern).drop("__low")


def severity() -> Column:
    return F.when(F.col("category").isin(CRITICAL_CATEGORIES), "high").otherwise("medium")


def log_issues(logs: DataFrame, *by: str) -> DataFrame:
    return (issue_hits(logs).groupBy(*by, "category").agg(F.count(F.lit(1)).alias("issue_count"))
            .withColumn("severity", severity()))


def issue_examples(logs: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` messages per category."""
    picked = first_rows(issue_hits(logs), ["category"], ["seq"], n)
    return picked.select("category", "rank", "seq", "pattern", "type",
                         F.substring("text", 1, 200).alias("message"))


def windowed_issues(logs: DataFrame, width: str = "1 hour", time: str = "ts") -> DataFrame:
    """Issue counts per time window and category, for batch or stream."""
    return (issue_hits(logs).groupBy(F.window(time, width).alias("window"), "category")
            .agg(F.count(F.lit(1)).alias("issue_count"))
            .select(F.col("window.start").alias("window_start"), "category", "issue_count",
                    severity().alias("severity")))


def is_critical() -> Column:
    """Row test: the message falls in a critical category."""
    low = F.lower("text")
    return any_of([F.regexp_like(low, F.lit(p)) for c in CRITICAL_CATEGORIES for p in ISSUE_PATTERNS[c]])
