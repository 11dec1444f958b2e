"""Small column helpers shared by the rule modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: White space of Unicode, and the separators 28 to 31 that text tools count as such.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: str | Column) -> Column:
    """Text without white space of any kind at its edges."""
    return F.btrim(col(text), F.lit(WHITE_SPACE))


def first_match(arms: list[tuple[Column, object]], default=None) -> Column:
    """CASE WHEN over ``arms`` in order."""
    chain = reduce(lambda acc, arm: acc.when(arm[0], arm[1]) if acc is not None
                   else F.when(arm[0], arm[1]), arms, None)
    return chain.otherwise(default)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used.
    Lambdas are interpreted, so a repeated sub-expression is repeated work."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns through a one-row generator. Catalyst does not inline these
    into later filters and projections, so a costly value is computed once."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def count_true(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def stamp(value: str | Column) -> Column:
    """Timestamp printed with microseconds."""
    return F.date_format(col(value), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def contains_ignoring_case(text: str | Column, needle: str) -> Column:
    """Literal substring test, so ``%`` and ``_`` have no meaning."""
    return F.lower(col(text)).contains(needle.lower())


def rule_summary(df: DataFrame, flag: str | Column, *group: str) -> DataFrame:
    """Rows, valid, invalid and valid share, per group or overall."""
    ok = F.coalesce(col(flag), F.lit(False))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"),
        count_true(ok).alias("valid"),
        count_true(~ok).alias("invalid"),
        F.round(F.avg(ok.cast("int")), 4).alias("valid_share"),
    )
