"""Text in the zones of document templates: a spatial join of words with boxes.

Zones are rows, as many per document type as wanted. Words and boxes meet by a grid: a word lies in one cell, a
box is entered in every cell it touches, and both are keyed by (document type, cell). So the join is by
equality, and the exact bounds are tested on what meets in a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import let

#: Cells along each side of a page.
GRID = 10
#: Zones of a type that a page meets at a time.
ZONES = 256
_BOUNDS = ["left", "top", "right", "bottom"]


def template_zones(templates: DataFrame, key: str = "document_type", zones: str = "zones") -> DataFrame:
    """(document_type, zone, left, top, right, bottom) of templates whose ``zones`` column is JSON of the kind
    ``{"name": {"x": .., "y": .., "width": .., "height": ..}}``, in page fractions.

    JSON that cannot be read, zones without all four numbers, and empty boxes give no rows."""
    box = "map<string, struct<x: double, y: double, width: double, height: double>>"
    rows = templates.select(F.col(key).alias("document_type"), F.explode(F.from_json(zones, box)).alias("zone", "z"))
    bounds = rows.select("document_type", "zone", F.col("z.x").alias("left"), F.col("z.y").alias("top"),
                         (F.col("z.x") + F.col("z.width")).alias("right"), (F.col("z.y") + F.col("z.height")).alias("bottom"))
    return bounds.filter("left < right AND top < bottom")


def page_word_rows(pages: DataFrame, words: str = "words") -> DataFrame:
    """(doc_id, page_num, document_type, word_no, x, y, text), one row per word of an array of struct(x, y, text),
    and one with a NULL ``word_no`` for a page without words."""
    return pages.select("doc_id", "page_num", "document_type", F.posexplode_outer(words).alias("word_no", "w")).select(
        "doc_id", "page_num", "document_type", "word_no", "w.x", "w.y", "w.text")


def _cell(place: str | Column, grid: int) -> Column:
    """The cell of a place along one side; what is off the page counts to a cell beyond its edge."""
    at = F.floor((F.col(place) if isinstance(place, str) else place) * grid)
    return F.least(F.greatest(at, F.lit(-1)), F.lit(grid)).cast("int")


def _parts_of_types(boxes: DataFrame, part: int) -> DataFrame:
    """(type, named): the zones of each type as arrays of struct(zone, boxes) with about ``part`` zones each."""
    named = boxes.groupBy("type", "zone").agg(F.collect_set(F.struct(*_BOUNDS)).alias("boxes"))
    counts = named.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    dealt = named.join(counts, "type").withColumn("part", F.pmod(F.xxhash64("zone"), F.col("parts")))
    return dealt.groupBy("type", "part").agg(F.collect_list(F.struct("zone", "boxes")).alias("named")).drop("part")


def page_zone_text(pages: DataFrame, zones: DataFrame, words: Column, part: int = ZONES) -> DataFrame:
    """What ``words_in_zones`` gives, for pages (doc_id, page_num, document_type, and what ``words`` is made of) with one row each.

    ``words``, an array of struct(x, y, text) in reading order, is made where a page has met its zones, so no word is shuffled. Pages
    and zones meet by type; a type with many zones meets in parts. Pages that are there twice count once.
    The join is a merge join: the zones are far more than Spark takes them for before their JSON is read, too many to broadcast.
    """
    boxes = zones.select(F.col("document_type").alias("type"), "zone", *_BOUNDS).filter("left < right AND top < bottom")
    parts = _parts_of_types(boxes, part).hint("merge")
    met = pages.filter("document_type IS NOT NULL").distinct().join(parts, F.col("document_type") == F.col("type"))

    def lies_in(named: Column):
        def inside(w: Column) -> Column:  # most words are above or below a box
            return F.exists(named["boxes"], lambda b: (w["y"] >= b["top"]) & (w["y"] < b["bottom"]) & (w["x"] >= b["left"]) & (w["x"] < b["right"]))
        return inside

    def texts(all_words: Column) -> Column:
        def one(named: Column) -> Column:
            found = F.transform(F.filter(all_words, lies_in(named)), lambda w: w["text"])
            return F.struct(named["zone"].alias("zone"), F.array_join(found, " ").alias("text"), F.size(found).alias("words"))
        return F.transform("named", one)

    placed = F.filter(words, lambda w: (w["text"] != "") & w["x"].isNotNull() & w["y"].isNotNull())
    return met.select("doc_id", "page_num", F.inline(let(F.coalesce(placed, F.array().cast("array<struct<x:double,y:double,text:string>>")), texts)))


def words_in_zones(words: DataFrame, zones: DataFrame, grid: int = GRID) -> DataFrame:
    """(doc_id, page_num, zone, text, words) of every page and every zone of its document type.

    ``words`` are rows as of ``page_word_rows``, ``zones`` as of ``template_zones``. A word is in a zone if left <= x < right
    and top <= y < bottom; its text is that of its words in the order of ``word_no``. Zones may overlap and one name may
    stand for several boxes; a word counts once per name. Pages of types without zones, and pages without a type,
    give no rows; zones without words give empty text. Words without a place, and empty words, count for nothing.

    The only grouping is by (page, zone). A type or cell that holds much of the corpus is split by
    adaptive execution: both sides of the join are plain exchanges. The cells are never broadcast, as Spark takes them for as few as
    the boxes. Words that are kept by page are placed by ``page_zone_text`` without shuffling them.
    """
    boxes = zones.select(F.col("document_type").alias("type"), "zone", *_BOUNDS).filter("left < right AND top < bottom")
    across = boxes.withColumn("cx", F.explode(F.sequence(_cell("left", grid), _cell("right", grid))))
    cells = across.withColumn("cy", F.explode(F.sequence(_cell("top", grid), _cell("bottom", grid))))
    placed = words.filter("text <> '' AND x IS NOT NULL AND y IS NOT NULL").withColumns({"wx": _cell("x", grid), "wy": _cell("y", grid)})
    meets = (placed["document_type"] == cells["type"]) & (placed["wx"] == cells["cx"]) & (placed["wy"] == cells["cy"])
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    word = F.struct("word_no", "text")
    found = placed.join(cells.hint("merge"), meets & inside).select("doc_id", "page_num", "zone", word.alias("word"))
    every = words.select("doc_id", "page_num", F.col("document_type").alias("type")).distinct().join(boxes.select("type", "zone").distinct(), "type")
    rows = found.unionByName(every.select("doc_id", "page_num", "zone", F.lit(None).cast(found.schema["word"].dataType).alias("word")))
    text = rows.groupBy("doc_id", "page_num", "zone").agg(F.array_sort(F.collect_set("word")).alias("w"))
    return text.select("doc_id", "page_num", "zone", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), F.size("w").alias("words"))
