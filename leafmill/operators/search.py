"""Search, URL and text-table jobs."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.functions import text as rules
from leafmill.functions.common import count_true, strip
from leafmill.plans.ordered import Ordered


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Message for a pattern that the engine of the jobs does not accept."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return f"Invalid pattern: {pattern}"
    return None


def search_text(pages: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """One row per match: doc_id, page_num, matched_text, position, context, error.
    Patterns are of Java's dialect; one that does not compile gives one error row.
    Matches of the empty string are matches too."""
    error = pattern_error(pages.sparkSession, pattern)
    if error:
        return pages.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("page_num"),
            F.lit(None).cast("string").alias("matched_text"), F.lit(None).cast("int").alias("position"),
            F.lit(None).cast("string").alias("context"), F.lit(error).alias("error"))
    mode = "(?U)" if case_sensitive else "(?iU)"
    found = pages.select("doc_id", "page_num", "text", F.inline(rules.match_positions("text", mode + pattern)))
    context = rules.match_context(F.col("text"), F.col("position"), F.col("matched_text"))  # of the matches that are asked for
    return found.select("doc_id", "page_num", "matched_text", "position", context.alias("context"),
                        F.lit(None).cast("string").alias("error"))


def search_summary(pages: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """Matches, pages with matches and pages per document, counted in one pass
    over the pages without listing the matches. A pattern that does not compile gives one
    row without counts and an ``error`` column, which other results do not have."""
    error = pattern_error(pages.sparkSession, pattern)
    if error:
        return pages.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("total_matches"),
            F.lit(None).cast("bigint").alias("pages_with_matches"), F.lit(None).cast("bigint").alias("total_pages"), F.lit(error).alias("error"))
    mode = "(?U)" if case_sensitive else "(?iU)"
    hits = F.regexp_count("text", F.lit(mode + pattern))
    return pages.groupBy("doc_id").agg(
        F.sum(hits).alias("total_matches"), count_true(hits > 0).alias("pages_with_matches"),
        F.count(F.lit(1)).alias("total_pages"))


def extract_urls(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(rules.urls("text")).alias("url")).distinct()


def extract_links(html_pages: DataFrame) -> DataFrame:
    """Link targets of web pages; a path is completed with the page's own site."""
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    links = html_pages.select(F.col("page_id").alias("doc_id"), site.alias("site"),
                              F.explode(rules.hrefs("html")).alias("href"))
    full = F.when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.col("href"))
    return links.select("doc_id", full.alias("url")).distinct()


def doc_urls(text_urls: DataFrame, link_urls: DataFrame) -> DataFrame:
    """Distinct URLs per document and the sources each came from."""
    both = (text_urls.select("doc_id", "url", F.lit(True).alias("in_text"), F.lit(False).alias("in_links"))
            .unionByName(link_urls.select("doc_id", "url", F.lit(False).alias("in_text"),
                                          F.lit(True).alias("in_links"))))
    return both.groupBy("doc_id", "url").agg(
        F.bool_or("in_text").alias("in_text"), F.bool_or("in_links").alias("in_links"))


def doc_url_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("url_count"), count_true(F.col("in_text")).alias("from_text"),
        count_true(F.col("in_links")).alias("from_links"),
        F.min("url").alias("first_url"), F.max("url").alias("last_url"))


_PAGE = ["doc_id", "page_num"]


def _numbered(lines: DataFrame, block: Column) -> DataFrame:
    """Table-like lines that belong to a table, with the number of their table.

    A table ends where the column count moves by more than one; a run of one line
    is none. Both come from one pass: inside a block of lines a run's end is seen
    in place, and at its edges from the first and last line of the blocks beside it.
    """
    order = Ordered(_PAGE, ["line_no"], block)

    def cut(columns: Column, before: Column) -> Column:
        return F.coalesce((F.abs(columns - before) > 1).cast("int"), F.lit(1))

    row, one = F.struct("line_no", "columns"), F.lit(1)
    kept = (lines.select(*_PAGE, "line_no", strip("text").alias("row"))
            .filter(rules.looks_like_table(F.col("row")))
            .withColumn("columns", rules.column_count("row")))
    at = F.col("__no")
    joined = order.carry(
        kept,
        {"__no": F.row_number().over(order.local),
         "__cut": F.when(at == 1, 0).otherwise(cut(F.col("columns"), F.lag("columns").over(order.local))),
         "__next": F.lead("__cut").over(order.local),
         "__opens": ((at > 1) & (F.col("__cut") == 1) & (F.col("__next") == 0)).cast("int"),
         "__opened": F.sum(F.coalesce("__opens", F.lit(0))).over(order.upto)},
        {"__first": F.min(row), "__last": F.max(row), "__rows": F.count(one), "__sum": F.sum("__opens"),
         "__second": F.max(F.when(at == 2, F.col("__cut"))), "__end": F.max_by("__cut", "line_no")},
        {"__head": cut(F.col("__first.columns"), F.lag("__last.columns").over(order.blocks)),
         "__follow": cut(F.lead("__first.columns").over(order.blocks), F.col("__last.columns")),
         "__head_opens": ((F.col("__head") == 1) & (F.coalesce("__second", "__follow") == 0)).cast("int"),
         "__tail_opens": ((F.col("__rows") > 1) & (F.col("__end") == 1) & (F.col("__follow") == 0)).cast("int"),
         "__seen": F.coalesce(F.sum(F.coalesce("__sum", F.lit(0)) + F.col("__head_opens") + F.col("__tail_opens")).over(order.earlier), F.lit(0)),
         "__size": F.col("__rows")})
    starts = F.when(at == 1, F.col("__head")).otherwise(F.col("__cut")) == 1
    ends = F.coalesce("__next", "__follow") == 1
    tail = F.when((at == F.col("__size")) & (at > 1), F.col("__tail_opens")).otherwise(0)
    return (joined.filter(~(starts & ends))
            .select(*_PAGE, "line_no", "row", "columns",
                    (F.col("__seen") + F.col("__head_opens") + F.col("__opened") + tail).alias("table_number")))


def _spans(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy(*_PAGE, "table_number").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"), F.max("columns").alias("widest"))


def _line_block() -> Column:
    return F.floor(F.col("line_no") / 10000)


def table_rows(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """Lines of the tables of each page with number and size of their table.
    ``block`` gives the span of lines that one task takes of a busy page."""
    numbered = _numbered(lines, _line_block() if block is None else block)
    return numbered.join(_spans(numbered).select(*_PAGE, "table_number", "row_count"), [*_PAGE, "table_number"])


def table_blocks(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """One row per table: number, rows, first and last line, widest row."""
    return _spans(_numbered(lines, _line_block() if block is None else block))
