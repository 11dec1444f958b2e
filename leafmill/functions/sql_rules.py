"""Scalar rules as temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leafmill.functions.common import WHITE_SPACE

_BLANKS = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)

SQL_FUNCTIONS = {
    "ltv_percent": "(loan DOUBLE, value DOUBLE) RETURNS DOUBLE "
                   "RETURN CASE WHEN value > 0 THEN round(loan / value * 100, 2) END",
    "pay_periods": f"(period STRING) RETURNS INT RETURN CASE lower(btrim(period, '{_BLANKS}')) WHEN 'weekly' THEN 52 "
                   "WHEN 'biweekly' THEN 26 WHEN 'semi-monthly' THEN 24 WHEN 'monthly' THEN 12 "
                   "WHEN 'quarterly' THEN 4 WHEN 'annual' THEN 1 END",
    "phone_digits": "(phone STRING) RETURNS STRING RETURN regexp_replace(phone, '[^0-9]', '')",
    "word_total": r"(text STRING) RETURNS INT RETURN regexp_count(text, '\\S+')",
}


def register_sql_rules(spark: SparkSession) -> list[str]:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
