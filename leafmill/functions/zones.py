"""Words of a page with their place, and the text inside page zones.

A page is one row, so cutting zones never shuffles or multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import col, let

Zone = tuple[float, float, float, float]

# Zones as page fractions (left, top, right, bottom).
AUTHORITY_ZONES = {
    "header": (0.0, 0.0, 1.0, 0.15),
    "top_left": (0.0, 0.0, 0.4, 0.25),
    "top_right": (0.6, 0.0, 1.0, 0.25),
    "center": (0.25, 0.3, 0.75, 0.7),
}
CORNER_ZONE = (0.7, 0.0, 1.0, 0.15)
CONTENT_ZONE = (0.0, 0.0, 1.0, 0.4)
YEAR_STRIP_ZONE = (0.0, 0.0, 1.0, 0.1)
FISCAL_ZONES = {
    "header": (0.0, 0.0, 1.0, 0.12),
    "top_right": (0.65, 0.0, 1.0, 0.15),
    "top_left": (0.0, 0.0, 0.35, 0.15),
    "center_top": (0.25, 0.1, 0.75, 0.25),
}
# 200 of the 1650 pixels of a letter page at 150 dots per inch.
BANK_ZONE = (0.0, 0.0, 1.0, 200 / 1650)


def page_words(text: str | Column) -> Column:
    """Array of struct(x, y, text): x by place in the line, y by line on the page."""
    def line_words(line: Column, row: Column, rows: Column) -> Column:
        return let(F.split(line, " "), lambda parts: let(F.size(parts), lambda n: F.transform(
            parts, lambda word, at: F.struct(
                (at / n).alias("x"), (row / rows).alias("y"), word.alias("text")))))

    return let(F.split(col(text), "\n"), lambda lines: let(F.size(lines), lambda rows: F.flatten(
        F.transform(lines, lambda line, row: line_words(line, row, rows)))))


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda part: part != ""), " ")


def zone_text(words: Column, zone: Zone) -> Column:
    """Text of the words whose corner lies in the zone, in reading order."""
    left, top, right, bottom = zone
    inside = F.filter(words, lambda w: (w["x"] >= left) & (w["x"] < right) & (w["y"] >= top) & (w["y"] < bottom))
    return _joined(F.transform(inside, lambda w: w["text"]))


def line_zone_text(lines: Column, rows: Column, zone: Zone) -> Column:
    """The same for a page kept as lines: lines outside the zone are never split,
    and a zone as wide as the page takes whole lines."""
    left, top, right, bottom = zone
    kept = F.filter(lines, lambda line, row: (row / rows >= top) & (row / rows < bottom))
    if (left, right) == (0.0, 1.0):
        return _joined(kept)

    def cut(line: Column) -> Column:
        return let(F.split(line, " "), lambda parts: let(F.size(parts), lambda n: _joined(
            F.filter(parts, lambda word, at: (at / n >= left) & (at / n < right)))))

    return _joined(F.transform(kept, cut))


def with_zones(pages: DataFrame, table: dict[str, Zone], case=lambda text: text) -> DataFrame:
    """(doc_id, page_num) with one text column per zone, in the given ``case``."""
    cells = let(F.split("text", "\n"), lambda lines: let(F.size(lines), lambda rows: F.struct(
        *[case(line_zone_text(lines, rows, zone)).alias(name) for name, zone in table.items()])))
    return pages.select("doc_id", "page_num", F.inline(F.array(cells)))
