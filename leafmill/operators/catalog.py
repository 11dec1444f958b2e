"""Jobs over the tool catalog, settings and code lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import any_of, contains_ignoring_case, count_true

# Setting keys, their defaults and types.
SETTING_DEFAULTS = {
    "blank_page_variance_threshold": (100.0, "double"),
    "blank_page_density_threshold": (0.02, "double"),
    "default_pdf_dpi": (150, "int"),
    "max_file_size_mb": (50, "int"),
    "temp_file_cleanup_hours": (24, "int"),
}

# Logo codes with display name and category.
LOGOS = [
    ("TD_CANADA_TRUST", "TD Canada Trust", "bank"),
    ("RBC_ROYAL_BANK", "RBC Royal Bank", "bank"),
    ("SCOTIABANK", "Scotiabank", "bank"),
    ("BMO", "BMO Bank of Montreal", "bank"),
    ("CIBC", "CIBC", "bank"),
    ("NATIONAL_BANK", "National Bank of Canada", "bank"),
    ("DESJARDINS", "Desjardins", "bank"),
    ("TANGERINE", "Tangerine", "bank"),
    ("SIMPLII", "Simplii Financial", "bank"),
    ("CRA", "Canada Revenue Agency", "government"),
    ("REVENU_QUEBEC", "Revenu Québec", "government"),
    ("SERVICE_CANADA", "Service Canada", "government"),
    ("MANULIFE", "Manulife", "insurance"),
    ("SUNLIFE", "Sun Life", "insurance"),
    ("DESJARDINS_INSURANCE", "Desjardins Insurance", "insurance"),
    ("INTACT", "Intact Insurance", "insurance"),
    ("EQUIFAX", "Equifax Canada", "credit"),
    ("TRANSUNION", "TransUnion Canada", "credit"),
]

# Document type codes with label and category.
DOCUMENT_TYPES = [
    ("bank_statement", "Bank Statement", "financial"),
    ("tax_form", "Tax Form (T4, T1, etc.)", "tax"),
    ("paystub", "Pay Stub", "financial"),
    ("insurance_doc", "Insurance Document", "insurance"),
    ("mortgage_document", "Mortgage Document", "financial"),
    ("id_card", "ID Card / Permit", "identity"),
    ("credit_report", "Credit Report", "financial"),
    ("investment_statement", "Investment Statement", "financial"),
    ("other", "Other", "other"),
]


def with_category(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left join to the catalog; tools it does not map become ``unknown``.

    No broadcast hint: the catalog is broadcast only below Spark's size
    threshold, beyond it AQE splits hot tools of the sort-merge join.
    """
    dim = catalog.select("tool_name", "subcategory", "category")
    joined = df.join(dim, "tool_name", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("subcategory", "category")})


def calls_by_category(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls and successes per category. Runs are counted per tool before they
    meet the catalog, so a busy tool is one row in the join."""
    per_tool = runs.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("calls"), count_true(F.col("success")).alias("successes"))
    return with_category(per_tool, catalog).groupBy("category", "subcategory").agg(
        F.sum("calls").alias("calls"), F.sum("successes").alias("successes"))


def category_rollup(catalog: DataFrame) -> DataFrame:
    """Mapped tools per subcategory, per category and in all."""
    mapped = catalog.filter(F.col("category").isNotNull())
    level = F.when(F.grouping_id() == 0, "subcategory").when(F.grouping_id() == 1, "category").otherwise("total")
    return mapped.rollup("category", "subcategory").agg(
        level.alias("level"), F.count(F.lit(1)).alias("tools"))


def catalog_search(catalog: DataFrame, category: str | None = None, subcategory: str | None = None,
                   text: str | None = None) -> DataFrame:
    """Equality filters drop unmapped tools; ``text`` is sought in name and descriptions."""
    found = catalog
    if category is not None:
        found = found.filter(F.col("category") == category)
    if subcategory is not None:
        found = found.filter(F.col("subcategory") == subcategory)
    if text:
        found = found.filter(any_of([
            F.coalesce(contains_ignoring_case(c, text), F.lit(False))
            for c in ("tool_name", "short_description", "description")]))
    return found.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("subcategory", "category")})


def load_settings(rows: DataFrame, *tenant: str) -> DataFrame:
    """Key/value rows to one typed row per tenant; bad or missing values take the default."""
    picks = []
    for key, (default, kind) in SETTING_DEFAULTS.items():
        value = F.max(F.when(F.col("skey") == key, F.col("svalue"))).try_cast(kind)
        picks.append(F.coalesce(value, F.lit(default)).alias(key))
    return rows.groupBy(*tenant).agg(*picks)


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Names on one side only: ``missing`` from actual, or ``extra`` in it."""
    sides = (expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("a"))
             .unionByName(actual.select(key, F.lit(0).alias("e"), F.lit(1).alias("a"))))
    return (sides.groupBy(key).agg(F.max("e").alias("e"), F.max("a").alias("a"))
            .filter("e <> a")
            .select(key, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side")))


def normalized_code(code: Column, upper: bool) -> Column:
    spaced = F.replace(code, F.lit(" "), F.lit("_"))
    return F.upper(spaced) if upper else F.lower(spaced)


def catalog_add(dim: DataFrame, rows: DataFrame, upper: bool = True) -> DataFrame:
    """Code list plus the new rows whose normalised code it lacks; of several
    new rows with one code the least label is kept."""
    fresh = rows.withColumn("code", normalized_code(F.col("code"), upper))
    others = [c for c in dim.columns if c != "code"]
    fresh = (fresh.groupBy("code").agg(F.min(F.struct(*others)).alias("row"))
             .select("code", "row.*").join(dim.select("code"), "code", "left_anti"))
    return dim.unionByName(fresh)


def catalog_delete(dim: DataFrame, codes: DataFrame) -> DataFrame:
    return dim.join(codes.select("code").distinct(), "code", "left_anti")


def with_code_labels(df: DataFrame, code: str, table: list[tuple[str, str, str]]) -> DataFrame:
    """Display label and category of a code; the table is one of the fixed lists above."""
    columns = [pa.array(values) for values in zip(*table)]
    dim = df.sparkSession.createDataFrame(pa.table(columns, [code, "label", "label_category"]))
    return df.join(F.broadcast(dim), code, "left")


def tools_by_label(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label_category").agg(
        F.count(F.lit(1)).alias("rows_in_category"),
        count_true(F.col("label").isNotNull()).alias("labelled"))
