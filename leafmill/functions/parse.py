"""Parsing of amounts and dates printed in many ways."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leafmill.functions.common import col, first_match, let, strip
from leafmill.functions.normalize import map_words

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

# French month names and the English ones.
FRENCH_TO_ENGLISH = {
    "janvier": "January",
    "février": "February",
    "fevrier": "February",
    "mars": "March",
    "avril": "April",
    "mai": "May",
    "juin": "June",
    "juillet": "July",
    "août": "August",
    "aout": "August",
    "septembre": "September",
    "octobre": "October",
    "novembre": "November",
    "décembre": "December",
    "decembre": "December",
}

_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
_SHORT = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# Date shapes and their formats, tried in order. The shape is tested first, so
# that a format is only tried on text it can fit.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d"),
    (rf"(?i)^\d{{1,2}} {_MONTH} \d{{4}}\z", "d MMMM yyyy"),
    (rf"(?i)^{_MONTH} \d{{1,2}}, \d{{4}}\z", "MMMM d, yyyy"),
    (rf"(?i)^{_MONTH} \d{{1,2}} \d{{4}}\z", "MMMM d yyyy"),
    (rf"(?i)^\d{{1,2}} {_SHORT} \d{{4}}\z", "d MMM yyyy"),
    (rf"(?i)^{_SHORT} \d{{1,2}}, \d{{4}}\z", "MMM d, yyyy"),
    (r"^(?:0?[1-9]|1[0-2])/\d{1,2}/\d{4}\z", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"),
    (r"^(?:0?[1-9]|1[0-2])-\d{1,2}-\d{4}\z", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}\z", "d-M-yyyy"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\z", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\z", "yyyy-MM-dd'T'HH:mm:ss"),
]

# The shapes accepted for date ranges: ISO first, then day-first.
RANGE_FORMATS = [
    (r"^\d{4}-\d\d-\d\d\z", "yyyy-MM-dd"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\z", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\z", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}\z", "d-M-yyyy"),
]


def to_number(text: Column) -> Column:
    """Double of plain number text, else NULL; words such as ``nan`` are not numbers."""
    return F.when(F.regexp_like(text, F.lit(_NUMBER)), text.try_cast("double"))


def parse_currency(raw: str | Column) -> Column:
    """Amount as a double, NULL when it cannot be read.

    The letters C, A and D are dropped one by one with the currency signs, so
    ``CAD`` goes but ``USD`` does not. Two thousands separators without a
    decimal mark are refused.
    """
    text = strip(F.regexp_replace(strip(raw), "(?i)[$€£¥CAD]", ""))
    negative = text.startswith("(") & text.endswith(")")
    inner = F.when(negative, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    text = F.replace(inner, F.lit(" "), F.lit(""))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    no_commas = F.replace(text, F.lit(","), F.lit(""))
    comma_to_dot = F.replace(text, F.lit(","), F.lit("."))
    swapped = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dot_is_last = F.instr(F.reverse(text), ".") < F.instr(F.reverse(text), ",")
    plain = first_match([
        ((commas == 0) & (dots <= 1), text),
        ((commas == 1) & (dots == 0) & F.regexp_like(text, F.lit(r",[0-9]{2}\z")), comma_to_dot),
        ((commas == 1) & (dots == 0), no_commas),
        ((dots > 0) & ((commas == 0) | dot_is_last), no_commas),
    ], swapped)
    value = to_number(plain)
    return F.when(negative, -value).otherwise(value)


def _by_formats(text: Column, formats: list[tuple[str, str]]) -> Column:
    return let(text, lambda t: F.coalesce(*[
        F.when(F.regexp_like(t, F.lit(shape)), F.try_to_timestamp(t, F.lit(fmt)))
        for shape, fmt in formats]).cast("timestamp_ntz"))


def parse_timestamp(raw: str | Column) -> Column:
    """Timestamp from ISO, long, slashed or French text; month first where both fit."""
    text = strip(raw)
    months = {**FRENCH_TO_ENGLISH, **{k.capitalize(): v for k, v in FRENCH_TO_ENGLISH.items()}}
    return _by_formats(map_words(text, months), DATE_FORMATS)


def parse_date(raw: str | Column) -> Column:
    """Struct(iso_format, human_format, year, month, day, epoch, error)."""
    def fields(at: Column) -> Column:
        epoch = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), at)
        return F.struct(
            F.date_format(at, "yyyy-MM-dd").alias("iso_format"),
            F.date_format(at, "MMMM dd, yyyy").alias("human_format"),
            F.year(at).alias("year"), F.month(at).alias("month"), F.day(at).alias("day"),
            epoch.alias("epoch"), F.when(at.isNull(), "Cannot parse date").alias("error"))

    return let(parse_timestamp(raw), fields)


def range_timestamp(raw: str | Column) -> Column:
    return _by_formats(col(raw), RANGE_FORMATS)
