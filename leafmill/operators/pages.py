"""Jobs over document pages, uploads and merge requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import count_true, first_match, strip
from leafmill.functions.text import word_count
from leafmill.plans.ordered import Ordered, number_rows
from leafmill.sources.tables import object_name

# Upload modes and quarter turns that are accepted.
UPLOAD_MODES = ["logo_detection", "zone_extraction"]
ROTATIONS = [90, 180, 270, -90, -180, -270]


def text_stats(pages: DataFrame) -> DataFrame:
    """Characters and words per document. Pages are joined by blank lines, so no
    word spans two pages and the counts add up without building the joined text."""
    chars = F.sum(F.length("text"))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), chars.alias("character_count"),
        F.sum(word_count("text")).alias("word_count"), (chars > 0).alias("has_text"))


def pages_with_text(pages: DataFrame) -> DataFrame:
    return pages.filter(F.length("text") > 0)


def page_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.sum(F.length("text")).alias("total_characters"),
        count_true(F.length("text") > 0).alias("pages_with_text"),
        F.max(F.length("text")).alias("longest_page"))


def count_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    return files.select("doc_id", object_name("path").alias("file_name"), F.col("length").alias("file_size")).join(
        counts, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def page_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_num").alias("total_pages"))


def _range_error(page: Column, total: Column) -> Column:
    return F.when(total.isNull(), "Unknown document").when(
        (page < 1) | (page > total), F.format_string("Page %d out of range (1-%d)", page, total))


def extract_page(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested page per request, or an error row; unknown documents give one too."""
    wanted = requests.select("request_id", "doc_id", "page_number").join(page_totals(pages), "doc_id", "left")
    text = pages.select("doc_id", F.col("page_num").alias("page_number"), "text")
    error = _range_error(F.col("page_number"), F.col("total_pages"))
    return (wanted.join(text, ["doc_id", "page_number"], "left")
            .select("request_id", "doc_id", "page_number", "total_pages", "text",
                    error.isNull().alias("ok"), error.alias("error")))


def drop_blank_pages(pages: DataFrame, blank: DataFrame) -> DataFrame:
    return pages.join(blank.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_anti")


def rotate_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per page with its rotation after all valid requests for it. A request
    with a bad angle or page turns nothing; its document's pages carry the error (the
    first by name). Requests for an unknown document give a row without a page."""
    checked = requests.select("doc_id", "page_number", "degrees").join(page_totals(pages), "doc_id", "left")
    angle = F.when(~F.col("degrees").isin(ROTATIONS), F.format_string("Invalid rotation %d", "degrees"))
    error = _range_error(F.col("page_number"), F.col("total_pages"))
    checked = checked.withColumn("error", F.when(F.col("total_pages").isNull(), error).otherwise(F.coalesce(angle, error)))
    errors = checked.groupBy("doc_id").agg(F.min("error").alias("error"), F.first("total_pages").isNull().alias("unknown"))
    turns = (checked.filter(F.col("error").isNull()).groupBy("doc_id", F.col("page_number").alias("page_num"))
             .agg(F.pmod(F.sum("degrees"), F.lit(360)).cast("int").alias("rotation")))
    turned = (pages.select("doc_id", "page_num").join(turns, ["doc_id", "page_num"], "left")
              .join(errors.select("doc_id", "error"), "doc_id", "left")
              .select("doc_id", "page_num", F.coalesce("rotation", F.lit(0)).alias("rotation"), "error"))
    missing = errors.filter("unknown").select("doc_id", F.lit(None).cast("int").alias("page_num"), F.lit(0).alias("rotation"), "error")
    return turned.unionByName(missing)


def parse_ranges(text: Column, total: Column) -> Column:
    """Array of struct(part, label, first, last, valid) from ``1-3,5,7-9``."""
    def parse(part, index):
        first = F.regexp_extract(strip(part), r"(?U)^([0-9]+)\s*(?:-\s*([0-9]+))?\z", 1).try_cast("int")
        last = F.regexp_extract(strip(part), r"(?U)^(?:[0-9]+\s*-\s*)?([0-9]+)\z", 1).try_cast("int")
        fits = (first >= 1) & (last <= total) & (first <= last)
        return F.struct((index + 1).alias("part"), strip(part).alias("label"), first.alias("first"),
                        last.alias("last"), F.coalesce(fits, F.lit(False)).alias("valid"))

    return F.transform(F.split(text, ","), parse)


def plan_splits(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per part of a split request. One bad part, or an unknown document,
    fails the whole request, which then gives a single error row."""
    parsed = (requests.select("request_id", "doc_id", "ranges").join(page_totals(pages), "doc_id", "left")
              .withColumn("parts", parse_ranges(F.col("ranges"), F.col("total_pages")))
              .withColumn("bad", F.try_element_at(F.filter("parts", lambda p: ~p["valid"]), F.lit(1))))
    error = F.when(F.col("total_pages").isNull(), "Unknown document").when(F.col("bad").isNotNull(),
                   F.format_string("Invalid range %s (total pages: %d)", F.col("bad.label"), F.col("total_pages")))
    parts = F.when(error.isNull(), F.col("parts"))
    return (parsed.select("request_id", "doc_id", "total_pages", error.alias("error"), F.explode_outer(parts).alias("p"))
            .select("request_id", "doc_id", "total_pages", "p.part", F.col("p.first").alias("first_page"),
                    F.col("p.last").alias("last_page"),
                    (F.col("p.last") - F.col("p.first") + 1).alias("page_count"), "error"))


def split_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each part. Ranges are unrolled to page numbers, so the join is on
    (document, page) rather than on bounds."""
    wanted = (plan_splits(requests, pages).filter(F.col("error").isNull())
              .select("request_id", "doc_id", "part", F.explode(F.sequence("first_page", "last_page")).alias("page_num"),
                      "first_page"))
    return (wanted.join(pages.select("doc_id", "page_num", "text"), ["doc_id", "page_num"])
            .select("request_id", "doc_id", "part", "page_num", (F.col("page_num") - F.col("first_page") + 1).alias("position"),
                    "text"))


def _merge_order() -> Ordered:
    return Ordered(["merge_id"], ["file_no"], F.floor(F.col("file_no") / 10000))


def merge_files(parts: DataFrame) -> DataFrame:
    """Source files of each merge, numbered in order."""
    return number_rows(parts, "file_number", _merge_order())


def merge_summary(parts: DataFrame) -> DataFrame:
    """Totals per merge; fewer than two inputs is an error."""
    files = F.count(F.lit(1))
    return parts.groupBy("merge_id").agg(
        files.alias("files_merged"), F.sum("page_count").alias("total_pages"),
        F.sum("file_size").alias("total_size"), (files >= 2).alias("ok"),
        F.when(files < 2, "Only one file (nothing to merge)").alias("error"))


def merge_pages(parts: DataFrame) -> DataFrame:
    """Every page of each merge with its number in the merged document."""
    placed = _merge_order().running(parts, "sum", through=F.col("page_count"))
    return placed.select(
        "merge_id", "file_no", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_num"),
        (F.col("through") - F.col("page_count")).alias("offset")).select(
        "merge_id", "file_no", "page_num", (F.col("offset") + F.col("page_num")).alias("merged_page"))


def expired_objects(files: DataFrame, as_of: Column, older_than_hours: int = 24) -> DataFrame:
    """Files last changed before the cutoff; deleting them is left to the caller."""
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(older_than_hours))
    return files.filter(F.col("modificationTime") < cutoff)


def admit_uploads(files: DataFrame, max_files: int = 50) -> DataFrame:
    """Accept or refuse each uploaded file. Sessions are counted before names are
    tested; only the sessions over the limit are joined back."""
    crowded = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("session_files")).filter(
        F.col("session_files") > max_files)
    reason = first_match([
        (F.col("session_files").isNotNull(), F.lit(f"Maximum {max_files} files allowed")),
        (~F.col("mode").isin(UPLOAD_MODES), F.lit("Invalid mode")),
        (~F.col("file_name").endswith(".pdf"), F.lit("Not a .pdf name")),
    ])
    return (files.withColumn("file_name", object_name("path")).join(crowded, "session_id", "left")
            .withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()))
