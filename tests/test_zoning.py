"""Spatial join of words and zones, and near addresses, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import zones
from leafmill.operators import address_links, classification, edit_blocks, zoning
from leafmill.plans.graph import components
from leafmill.registry import Inputs, load_all

BOXES = "document_type string, zone string, left double, top double, right double, bottom double"
WORDS = "doc_id long, page_num int, document_type string, word_no int, x double, y double, text string"


def test_zones_as_rows_equal_zones_as_constants(spark, data_dir):
    pages = Inputs(spark, data_dir).view("triage_pages").select("doc_id", "page_num", F.lit("letter").alias("document_type"), zones.page_words("text").alias("words"))
    table = spark.createDataFrame([("letter", n, *b) for n, b in zones.AUTHORITY_ZONES.items()], BOXES)
    got = zoning.words_in_zones(zoning.page_word_rows(pages), table).drop("words")
    want = classification.words_in_zones(pages, zones.AUTHORITY_ZONES)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


@pytest.mark.parametrize("grid", [1, 3, 10])
def test_words_in_zones_equals_a_plain_loop(spark, grid):
    draw = random.Random(grid)
    words = [(d, 1, draw.choice(["a", "b", None]), n, draw.choice([-0.5, 0.0, 0.1, 0.25, 0.5, 0.999, 1.0, 3.0]), draw.random(), draw.choice(["x", "y", "", "zz"]))
             for d in range(30) for n in range(12)]
    words = [(d, p, "ab"[d % 2] if t else t, n, x, y, w) for d, p, t, n, x, y, w in words]
    types = {d: "ab"[d % 2] for d in range(30)}
    words = [(d, p, types[d], n, x, y, w) for d, p, _, n, x, y, w in words] + [(50, 1, "a", None, None, None, None), (51, 1, "c", 0, 0.1, 0.1, "w"), (52, 1, None, 0, 0.1, 0.1, "w")]
    boxes = [("a", "z1", 0.0, 0.0, 0.3, 0.5), ("a", "z1", 0.2, 0.2, 0.6, 0.9), ("a", "off", -2.0, -1.0, 5.0, 2.0), ("b", "z2", 0.25, 0.0, 0.5, 1.0), ("b", "none", 0.5, 0.5, 0.5, 0.9), ("a", "null", None, 0.0, 1.0, 1.0)]
    want = {}
    for d, p, t, n, x, y, w in words:
        for bt, zone, l, top, r, b in boxes:
            if bt == t and l is not None and l < r and top < b:
                found = want.setdefault((d, p, zone), set())
                if w and x is not None and l <= x < r and top <= y < b:
                    found.add((n, w))
    got = zoning.words_in_zones(spark.createDataFrame(words, WORDS), spark.createDataFrame(boxes, BOXES), grid).collect()
    assert {(r.doc_id, r.page_num, r.zone): (r.text, r.words) for r in got} == {k: (" ".join(w for _, w in sorted(v)), len(v)) for k, v in want.items()}
    assert len(got) == len(want)


def test_no_nested_loop_and_no_rows(spark):
    words, boxes = spark.createDataFrame([], WORDS), spark.createDataFrame([], BOXES)
    found = zoning.words_in_zones(words, boxes)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert found.count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("percent,gram,part", [(80, 3, 2048), (80, 3, 4), (80, 2, 7), (90, 3, 5)])
def test_key_links_lose_none(spark, percent, gram, part):
    draw = random.Random(percent * gram + part)
    keys = {"".join(draw.choice("AB 1") for _ in range(draw.randrange(1, 14))).strip() or "A" for _ in range(120)}
    for _ in range(60):  # families of near keys around long ones that share most grams
        base = list(draw.choice(["MAIN STREET OTTAWA", "AAAAAAAAAAAAAAAA", "12 RUE DE L EGLISE OUEST"]))
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(base))
            base[at:at + draw.randrange(2)] = draw.choice(["", "X", "7", "AB"])
        keys.add("".join(base).strip())
    keys = sorted(keys)
    found = address_links.key_links(spark.createDataFrame(list(enumerate(keys)), "class_id long, match_key string"), percent, gram, part).collect()
    want = {(i, j) for j in range(len(keys)) for i in range(j) if round((1 - _edits(keys[i], keys[j]) / max(len(keys[i]), len(keys[j]))) * 100 + 1e-9, 1) >= percent}
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == want and want


def test_near_addresses_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " - "), (4, "12 Main Street"), (5, "12  main street"), (6, "12 Main Streets"), (7, "99 Elm Road West")]
    got = {r.id: (r.class_id, r.records, r.links, r.component_id) for r in address_links.near_addresses(spark.createDataFrame(rows, "id long, address string")).collect()}
    assert got == {1: (1, 1, 0, 1), 2: (2, 1, 0, 2), 3: (3, 1, 0, 3), 4: (4, 2, 1, 4), 5: (4, 2, 1, 4), 6: (6, 1, 1, 4), 7: (7, 1, 0, 7)}
    assert address_links.near_addresses(spark.createDataFrame([], "id long, address string")).count() == 0
    with pytest.raises(ValueError):
        address_links.key_links(spark.createDataFrame([], "class_id long, match_key string"), 60)


def test_components_equal_union_find(spark):
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_cells_and_zones_are_never_broadcast(spark, data_dir):
    """Spark takes the cells of the boxes, and zones in JSON, for as few bytes as the table behind them has."""
    pages = spark.createDataFrame([(1, 1, "a", 0, 0.1, 0.1, "w")], WORDS)
    rows = zoning.words_in_zones(pages, zoning.template_zones(Inputs(spark, data_dir).view("zone_templates")))
    of_pages = load_all()["template_zone_words"].build(Inputs(spark, data_dir))
    for plan in (f._jdf.queryExecution().executedPlan().toString() for f in (rows, of_pages)):
        meeting = [line for line in plan.splitlines() if "Join [document_type#" in line]
        assert meeting and "SortMergeJoin" in meeting[-1]


@pytest.mark.parametrize("part", [1, 2, 256])
def test_zone_text_by_page_equals_that_by_word(spark, data_dir, part):
    draw = random.Random(part)
    pages = Inputs(spark, data_dir).view("triage_pages").filter("doc_id % 5 = 0").select("doc_id", "page_num", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("doc_id") / 5 % 3).cast("int") + 1).alias("document_type"), "text")
    pages = pages.unionByName(pages.limit(20)).unionByName(pages.limit(5).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("text", F.lit(None).cast("string")))
    boxes = [(draw.choice("ab"), draw.choice(["z1", "z2", "z3", "z4", "z5"]), draw.random(), draw.random() / 2, 0.3 + draw.random(), 0.4 + draw.random() / 2) for _ in range(20)]
    table = spark.createDataFrame(boxes, BOXES)
    got = zoning.page_zone_text(pages, table, zones.page_words("text"), part)
    words = pages.distinct().withColumn("words", zones.page_words("text"))
    want = zoning.words_in_zones(zoning.page_word_rows(words), table)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.filter("words > 3").count() > 0


@pytest.mark.parametrize("percent,part", [(80, 1000), (80, 13), (90, 40)])
def test_blocks_lose_no_link(spark, percent, part):
    """Degrees and components by blocks equal those of all pairs, also of long keys and letters beyond 16 bits."""
    draw = random.Random(part)
    keys = {f"{draw.randrange(300)} {draw.choice(['AVENUE NORTH', 'RUE DE L EGLISE', 'STREET # 4'])} {draw.choice(['AUTO', 'BUILDING', 'QC H0X', 'QC H1X', '😀Ö'])}" for _ in range(150)}
    keys |= {"".join(draw.choice("AB 1") for _ in range(draw.randrange(1, 9))).strip() or "A" for _ in range(60)} | {"X" * 299 + c for c in "ABC"}
    keys = sorted(keys)
    near = [(i, j) for j in range(len(keys)) for i in range(j) if round((1 - _edits(keys[i], keys[j]) / max(len(keys[i]), len(keys[j]))) * 100 + 1e-9, 1) >= percent]
    found = address_links.block_links(spark.createDataFrame(list(enumerate(keys)), "class_id long, match_key string"), percent, part).collect()
    degrees, want, forest = {}, {}, [(r.a, r.b) for r in found if r.b is not None]
    for r in found:
        degrees[r.a] = degrees.get(r.a, 0) + r.n
    for pair in near:
        for x in pair:
            want[x] = want.get(x, 0) + 1
    assert {k: v for k, v in degrees.items() if v} == want and all(r.n == 0 or r.b is None for r in found)
    roots = [{r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()} for links in (forest, near)]
    assert roots[0] == roots[1] and {tuple(sorted(e)) for e in forest} <= set(near)


def test_both_ways_to_near_addresses_agree(spark, monkeypatch, data_dir):
    book = Inputs(spark, data_dir).view("address_book")
    results = []
    for pairs in (0, 10 ** 9):
        monkeypatch.setattr(address_links, "PAIRS", pairs)
        results.append({tuple(r) for r in address_links.near_addresses(book).collect()})
    assert results[0] == results[1] and len(results[0]) == book.count()


def test_families_by_blocks_equal_those_by_gram(spark, monkeypatch, data_dir):
    book = Inputs(spark, data_dir).view("address_book")
    results = []
    for pairs in (0, 10 ** 9):
        monkeypatch.setattr(address_links, "PAIRS", pairs)
        results.append({tuple(r) for r in address_links.address_families(address_links.near_addresses(book)).collect()})
    assert results[0] == results[1] and results[0]


def test_families_come_from_classes_alone(spark, monkeypatch, data_dir):
    """One row per match key gives the families of the records; blocks of any size fill the same columns."""
    book = Inputs(spark, data_dir).view("address_book")
    want = {tuple(r) for r in address_links.address_families(address_links.near_addresses(book)).collect()}
    monkeypatch.setattr(address_links, "PAIRS", 10 ** 9)
    monkeypatch.setattr(edit_blocks, "PAIRS", 50)
    assert {tuple(r) for r in address_links.families(book).collect()} == want and want


def test_columns_of_a_block_are_filled_side_by_side():
    """A thousand keys with a common end take one step of numpy calls a character, not one a key."""
    keys = [f"{n} RUE DE L EGLISE OUEST" for n in range(1, 1001)]
    found = list(edit_blocks.near_in_block(keys, keys, 80, 0.2005))
    assert sum(len(places) for places, _ in found) == 1_000_000 and len(found) < 100
