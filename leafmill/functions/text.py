"""Text rules: words, matches with positions, page numbers, URLs, table lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leafmill.functions.common import col, let, strip

# Page-number patterns of lower-cased footer text, in order.
PAGE_NUMBER_PATTERNS = [
    r"page\s+(\d+)\s+of\s+(\d+)",
    r"page\s+(\d+)\s*/\s*(\d+)",
    r"(\d+)\s+of\s+(\d+)",
    r"(\d+)\s*/\s*(\d+)",
]

# Fixed value: a web address in running text. One character class and not an
# alternation, because Java matches a repeated alternation by recursion and a
# long address would overflow the stack.
URL_PATTERN = r"https?://[!$-_a-z]+"

# Fixed value: where columns of a text table are cut.
COLUMN_GAP = r"\s{2,}|\t"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(r"\S+"))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def page_number(text: str | Column) -> Column:
    """Struct(current, total, is_page_one) from the first pattern that matches."""
    low = F.lower(col(text))

    def group(n: int) -> Column:
        found = [F.when(F.regexp_like(low, F.lit(p)), F.regexp_extract(low, p, n)) for p in PAGE_NUMBER_PATTERNS]
        return F.coalesce(*found).try_cast("int")

    current = group(1)
    return F.struct(current.alias("current"), group(2).alias("total"),
                    F.coalesce(current == 1, F.lit(False)).alias("is_page_one"))


def last_line(text: str | Column) -> Column:
    return F.element_at(F.split(col(text), "\n"), -1)


def match_context(text: Column, position: Column, matched: Column, width: int = 50) -> Column:
    """Text around a match, ``width`` characters each way, newlines as spaces."""
    first = F.greatest(position - width, F.lit(0))
    size = position + F.length(matched) + width - first
    return F.translate(F.substr(text, first + 1, size), "\n", " ")


#: Noncharacters that mark a match's start and end, and what stands for them where a text has them.
_START, _END, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def match_positions(text: str | Column, pattern: str) -> Column:
    """Array of struct(matched_text, position) for any pattern of Java's dialect, matches of the empty string included.
    Each match is marked in place and the marked text is cut at its starts; lengths of the parts add up to
    the 0-based positions. Matches are gathered in runs of about the cube root of their number, so appending stays cheap."""
    value = F.translate(col(text), _START + _END, _OTHER * 2)
    marked = F.regexp_replace(value, F.lit(pattern), F.lit(f"{_START}$0{_END}"))

    def place(parts: Column) -> Column:
        count = F.size(parts)
        start = F.struct(F.length(F.get(parts, 0)).alias("at"), F.array().cast("array<int>").alias("run"),
                         F.array().cast("array<array<int>>").alias("full"), F.ceil(F.cbrt(2 * count)).cast("int").alias("most"))

        def step(acc, part):
            found = F.array_append(acc["run"], acc["at"])
            whole = F.size(acc["run"]) >= acc["most"]
            return F.struct((acc["at"] + F.length(part) - 1).alias("at"),
                            F.when(whole, F.array().cast("array<int>")).otherwise(found).alias("run"),
                            F.when(whole, F.array_append(acc["full"], found)).otherwise(acc["full"]).alias("full"), acc["most"].alias("most"))

        hits = F.slice(parts, F.lit(2), F.greatest(count - 1, F.lit(0)))
        places = F.aggregate(hits, start, step, lambda acc: F.flatten(F.array_append(acc["full"], acc["run"])))
        return F.zip_with(hits, places, lambda part, at: F.struct(F.substring_index(part, _END, 1).alias("matched_text"), at.alias("position")))

    return let(F.split(marked, _START, -1), place)


def urls(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(URL_PATTERN), F.lit(0))


def hrefs(html: str | Column) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r'href="([^"]*)"'), F.lit(1))


def column_count(line: str | Column) -> Column:
    return F.size(F.split(col(line), COLUMN_GAP))


def looks_like_table(line: Column) -> Column:
    """A trimmed line with a wide gap or tab, or two numbers and a separator."""
    gap = F.regexp_like(line, F.lit(r"\s{2,}|\t"))
    numbers = F.regexp_count(line, F.lit(r"\d+")) >= 2
    return gap | (numbers & F.regexp_like(line, F.lit(r"[|,;]")))
