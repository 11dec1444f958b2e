"""Validation of identity and contact columns. Each rule returns a struct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from leafmill.functions.common import col, first_match, let, strip
from leafmill.functions.parse import range_timestamp

# Postal code shapes per country, in the order they are tried.
POSTAL_PATTERNS = {
    "CA": r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d\z",
    "US": r"^\d{5}(-\d{4})?\z",
}

# Fixed value: the accepted e-mail shape.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"


def _digit(text: Column, at: int) -> Column:
    return F.substring(text, at, 1).try_cast("int")


def validate_sin(raw: str | Column) -> Column:
    """Nine digits, not led by 0 or 8, with a Luhn sum divisible by ten."""
    clean = F.regexp_replace(col(raw), r"[\s\-]", "")
    doubled = [_digit(clean, i) * 2 for i in (2, 4, 6, 8)]
    single = [_digit(clean, i) for i in (1, 3, 5, 7, 9)]
    total = reduce(lambda a, b: a + b, single + [F.when(d > 9, d - 9).otherwise(d) for d in doubled])
    ok = F.coalesce(F.regexp_like(clean, F.lit("^[1-79][0-9]{8}\\z")) & (total % 10 == 0), F.lit(False))
    formatted = F.concat_ws("-", *[F.substring(clean, i, 3) for i in (1, 4, 7)])
    return F.struct(clean.alias("cleaned"), F.when(ok, formatted).alias("formatted"), ok.alias("is_valid"),
                    F.when(~ok, "Invalid SIN format or checksum").alias("error"))


def validate_postal_code(raw: str | Column, country: str | None = None) -> Column:
    clean = F.upper(strip(raw))
    fits = {c: F.coalesce(F.regexp_like(clean, F.lit(p)), F.lit(False)) for c, p in POSTAL_PATTERNS.items()}
    if country is None:
        where = first_match([(fits[c], F.lit(c)) for c in fits], F.lit("UNKNOWN"))
        ok = fits["CA"] | fits["US"]
    else:
        where, ok = F.lit(country.upper()), fits.get(country.upper(), F.lit(False))
    packed = F.regexp_replace(clean, r"\s", "")
    canadian = F.concat_ws(" ", F.substring(packed, 1, 3), F.substring(packed, 4, 3))
    formatted = F.when(where == "CA", canadian).otherwise(clean)
    return F.struct(clean.alias("cleaned"), F.when(ok, formatted).alias("formatted"), where.alias("country"),
                    ok.alias("is_valid"), F.when(where == "UNKNOWN", 0.5).otherwise(1.0).alias("confidence"))


def validate_phone(raw: str | Column, country: str = "CA") -> Column:
    """Ten digits, area code and exchange starting 2 to 9; a leading 1 of eleven is the country."""
    digits = F.regexp_replace(col(raw), r"[^0-9]", "")
    led = (F.length(digits) == 11) & digits.startswith("1")
    local = F.when(led, F.substring(digits, 2, 10)).otherwise(digits)
    shape = F.regexp_like(local, F.lit("^[2-9][0-9]{2}[2-9][0-9]{6}\\z"))
    ok = F.coalesce(shape, F.lit(False)) if country.upper() in ("CA", "US") else F.lit(False)
    printed = F.concat(F.when(led, "+1 (").otherwise("("), F.substring(local, 1, 3), F.lit(") "),
                       F.substring(local, 4, 3), F.lit("-"), F.substring(local, 7, 4))
    return F.struct(digits.alias("cleaned"), F.when(ok, printed).alias("formatted"), ok.alias("is_valid"),
                    F.when(~ok, "Invalid phone number format").alias("error"))


def validate_email(raw: str | Column) -> Column:
    clean = F.lower(strip(raw))
    ok = F.coalesce(F.regexp_like(clean, F.lit(EMAIL_PATTERN)), F.lit(False))
    local, domain = F.split_part(clean, F.lit("@"), F.lit(1)), F.split_part(clean, F.lit("@"), F.lit(2))
    return F.struct(clean.alias("normalized"), F.when(ok, local).alias("local_part"),
                    F.when(ok, domain).alias("domain"),
                    F.when(ok, F.split_part(domain, F.lit("."), F.lit(-1))).alias("tld"), ok.alias("is_valid"))


def validate_date_range(start: str | Column, end: str | Column, as_of: Column,
                        max_days: str | Column | None = None) -> Column:
    """Order, length and future flags of a date range; unreadable dates give an error."""
    limit = F.lit(None).cast("int") if max_days is None else col(max_days)

    def judge(span: Column) -> Column:
        first, last, days = span["first"], span["last"], span["days"]
        ordered, readable = last >= first, first.isNotNull() & last.isNotNull()
        within = F.coalesce(~(days > limit), F.lit(True))
        error = first_match([
            (first.isNull(), F.concat(F.lit("Cannot parse date: "), F.coalesce(col(start), F.lit("")))),
            (last.isNull(), F.concat(F.lit("Cannot parse date: "), F.coalesce(col(end), F.lit("")))),
            (~ordered, F.lit("End date before start date")),
            (~within, F.format_string("Range exceeds %d days", limit)),
        ])
        return F.struct(
            days.alias("days_difference"), F.when(readable, ordered).alias("is_chronological"),
            F.when(readable, within).alias("within_max_days"),
            (readable & F.coalesce(ordered, F.lit(False)) & within).alias("is_valid"),
            F.when(readable, first > as_of).alias("start_in_future"),
            F.when(readable, last > as_of).alias("end_in_future"), error.alias("error"))

    def span(pair: Column) -> Column:
        days = F.floor(F.timestamp_diff("SECOND", pair["first"], pair["last"]) / 86400)
        return pair.withField("days", days)

    pair = F.struct(range_timestamp(start).alias("first"), range_timestamp(end).alias("last"))
    return let(let(pair, span), judge)
