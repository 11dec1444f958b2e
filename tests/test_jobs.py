"""Golden cases of the page, search, imaging, log and record jobs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import classify, imaging as pixels, zones
from leafmill.operators import (addresses, catalog, classification, executions, imaging, logs, pages, records,
                                reports, requests, search)
from leafmill.sources import tables


@pytest.fixture(scope="module")
def stack(spark):
    return spark.createDataFrame(
        [(1, 1, "Page one text"), (1, 2, ""), (1, 3, "more\ntext here"), (2, 1, "only")],
        "doc_id bigint, page_num int, text string")


def _rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_text_and_page_stats(stack):
    assert _rows(pages.text_stats(stack), "doc_id", "total_pages", "character_count", "word_count", "has_text") == [
        (1, 3, 27, 6, True), (2, 1, 4, 1, True)]
    assert pages.pages_with_text(stack).count() == 3


def test_split_then_merge_is_identity(spark, stack):
    whole = spark.createDataFrame([(5, 1, "1-3")], "request_id bigint, doc_id bigint, ranges string")
    parts = pages.split_pages(whole, stack)
    assert _rows(parts, "position", "text") == [(1, "Page one text"), (2, ""), (3, "more\ntext here")]
    merged = pages.merge_pages(spark.createDataFrame([(9, 1, 3, 10), (9, 2, 1, 4)],
                                                     "merge_id bigint, file_no int, page_count int, file_size bigint"))
    assert _rows(merged, "file_no", "page_num", "merged_page") == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 4)]


def test_bad_range_fails_the_whole_request(spark, stack):
    for text in ("1,4", "2-1", "0-1", "1,x", "1-2-3", "-1", ""):
        plan = pages.plan_splits(spark.createDataFrame([(5, 1, text)], "request_id bigint, doc_id bigint, ranges string"), stack).collect()
        assert len(plan) == 1 and plan[0].error and plan[0].part is None, text


def test_page_requests(spark, stack):
    wanted = spark.createDataFrame([(1, 1, 3, 90), (2, 2, 2, 45), (3, 1, 3, 180), (4, 7, 1, 90)], "request_id bigint, doc_id bigint, page_number int, degrees int")
    assert _rows(pages.extract_page(stack, wanted), "request_id", "doc_id", "text", "error") == [
        (1, 1, "more\ntext here", None), (2, 2, None, "Page 2 out of range (1-1)"), (3, 1, "more\ntext here", None),
        (4, 7, None, "Unknown document")]
    turned = pages.rotate_pages(stack, wanted)
    assert {(r.doc_id, r.page_num, r.rotation, r.error) for r in turned.collect()} == {
        (1, 1, 0, None), (1, 2, 0, None), (1, 3, 270, None), (2, 1, 0, "Invalid rotation 45"), (7, None, 0, "Unknown document")}
    plan = pages.plan_splits(wanted.withColumn("ranges", F.lit("1")), stack)
    assert _rows(plan.filter("error IS NOT NULL"), "request_id", "error") == [(4, "Unknown document")]


def test_search_positions_match_re(spark, stack):
    for pattern in ("text", "T[ei]", r"\b[a-z]+\b", "x*"):
        got = {}
        for row in search.search_text(stack, pattern).collect():
            got.setdefault((row.doc_id, row.page_num), []).append((row.position, row.matched_text))
        want = {}
        for row in stack.collect():
            hits = [(m.start(), m.group()) for m in re.finditer(pattern, row.text, re.IGNORECASE)]
            if hits:
                want[row.doc_id, row.page_num] = hits
        assert {k: sorted(v) for k, v in got.items()} == want, pattern
    assert search.search_text(stack, "(").first().error.startswith("Invalid pattern")
    assert search.search_text(stack, "(?<x>e)").count() == 7 and search.search_text(stack, "(?P<x>e)").first().error


def test_prose_with_odd_white_space_is_no_table(spark):
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["a line \r", "\tanother one", "third line\u00a0 "])], "doc_id bigint, page_num int, line_no int, text string")
    assert search.table_rows(lines).count() == 0


def test_table_numbers_do_not_depend_on_blocks(spark):
    rng = random.Random(8)
    lines = [(rng.choice([1, None]), 1, i, "  ".join("x" for _ in range(rng.choice([2, 2, 3, 5, 9])))) for i in range(300)]
    frame = spark.createDataFrame(lines, "doc_id bigint, page_num int, line_no int, text string")
    plain = {}
    for doc in (1, None):
        runs, before = [], None
        for d, _, no, text in lines:
            if d == doc:
                columns = len(text.split("  "))
                if before is None or abs(columns - before) > 1:
                    runs.append([])
                runs[-1].append(no)
                before = columns
        for number, run in enumerate((r for r in runs if len(r) > 1), 1):
            plain |= {(doc, no): (number, len(run)) for no in run}
    for size in (1, 2, 3, 50, 1000):
        got = search.table_blocks(frame, F.floor(F.col("line_no") / size)).collect()
        want = {(d, n, c) for (d, _), (n, c) in plain.items()}
        assert {(r.doc_id, r.table_number, r.row_count) for r in got} == want
    assert {(r.doc_id, r.line_no): (r.table_number, r.row_count) for r in search.table_rows(frame, F.floor(F.col("line_no") / 7)).collect() if r.doc_id} == {k: v for k, v in plain.items() if k[0]}


def test_many_matches_cost_in_proportion(spark):
    text = "ab" * 20_000
    rows = search.search_text(spark.createDataFrame([(1, 1, text)], "doc_id bigint, page_num int, text string"), "a").select("position").collect()
    assert [r.position for r in rows] == list(range(0, 40_000, 2))


def test_document_boundaries(spark):
    schema = "doc_id bigint, page_num int, is_blank boolean, is_page_one boolean, header_changed boolean, q1 int, q2 int, q3 int, q4 int"
    frame = spark.createDataFrame([
        (1, 1, False, False, False, 5, 5, 5, 5), (1, 2, True, True, False, 5, 5, 5, 5), (1, 3, False, False, False, 5, 5, 5, 5),
        (1, 4, False, True, True, 200, 5, 5, 5), (1, 5, True, False, True, 200, 5, 5, 5)], schema)
    got = imaging.document_boundaries(frame)
    assert _rows(got, "page_num", "is_split", "reason", "document_no") == [
        (1, True, "first_page", 1), (2, False, None, 1), (3, True, "blank_page_2", 2),
        (4, True, "page_one_detected,header_change,layout_change", 3), (5, True, "header_change", 4)]
    assert [r.confidence for r in got.orderBy("page_num").collect()] == [1.0, None, 0.85, 0.7, 0.7]
    ranges = imaging.document_ranges(got)
    assert _rows(ranges, "document_no", "first_page", "last_page") == [(1, 1, 2), (2, 3, 3), (3, 4, 4), (4, 5, 5)]


def test_boundaries_cover_pages_whatever_the_order(spark, data_dir):
    from leafmill.registry import Inputs
    features = Inputs(spark, data_dir).view("page_features")
    plain = imaging.document_boundaries(features)
    mixed = imaging.document_boundaries(features.orderBy(F.rand(3)))
    assert plain.exceptAll(mixed).count() == 0 == mixed.exceptAll(plain).count()
    assert plain.filter("confidence < 0 OR confidence > 1").count() == 0
    spans = imaging.document_ranges(plain).groupBy("doc_id").agg(F.sum(F.expr("last_page - first_page + 1")).alias("n"))
    assert spans.join(features.groupBy("doc_id").count(), "doc_id").filter("n <> count").count() == 0


def test_pixel_rules_against_numpy(one):
    import numpy as np
    rng = random.Random(6)
    width, height = 24, 12
    gray = [rng.choice([0, 30, 255]) if (i % width) % 2 else rng.randint(0, 255) for i in range(width * height)]
    image = np.array(gray, dtype=float).reshape(height, width)
    g, w, h = F.col("g"), F.lit(width), F.lit(height)
    padded = np.pad(image, 1, mode="reflect")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * image
    assert one(pixels.sharpness(g, w, h), g=gray) == pytest.approx(lap.var())
    assert one(pixels.variance(g), g=gray) == pytest.approx(image.var())
    cells = [(image[r * 4:r * 4 + 4, c * 8:c * 8 + 8] < 240).mean() for r in range(3) for c in range(3)]
    assert one(pixels.ink_density(g, w, h), g=gray) == pytest.approx(np.mean(cells))
    low = np.pad(image[int(height * 0.66):], 1, mode="reflect")
    edge = np.abs((low[:-2, 2:] + 2 * low[1:-1, 2:] + low[2:, 2:]) - (low[:-2, :-2] + 2 * low[1:-1, :-2] + low[2:, :-2]))
    strong = (edge > edge.mean() + edge.std()).sum(axis=0)
    bars = int((strong > height * 0.1).sum())
    row = one(pixels.bar_pattern(g, w, h), g=gray)
    assert (row["bars"], row["has_barcode"]) == (bars, bars > width * 0.2)
    means = image.mean(axis=1)
    run = best = 0
    for dark in means < means.mean() - means.std():
        run = run + 1 if dark else 0
        best = max(best, run)
    assert one(pixels.dark_band(g, w, h), g=gray)["longest_run"] == best


def test_blank_rule(one):
    row = one(pixels.classify_blank("v", "d"), v=0.0, d=0.0)
    assert row == {"is_blank": True, "confidence": 1.0}
    row = one(pixels.classify_blank("v", "d"), v=500.0, d=0.0)
    assert row == {"is_blank": False, "confidence": 0.5}


def test_zones_agree(one):
    text = "a b c d\ne f g h\ni j k l\nm n o p"
    for zone in [*zones.AUTHORITY_ZONES.values(), zones.CORNER_ZONE, zones.CONTENT_ZONE]:
        words = one(zones.zone_text(zones.page_words("t"), zone), t=text)
        lines = F.split("t", "\n")
        assert one(zones.line_zone_text(lines, F.size(lines), zone), t=text) == words
    assert one(zones.zone_text(zones.page_words("t"), (0.5, 0.0, 1.0, 0.3)), t=text) == "c d g h"


def test_required_text_is_in_every_match():
    samples = {r"income\s+tax\s+(?:and\s+benefit\s+)?return": "income tax return", r"\bT2202A?\b": "t2202",
               r"cr[ée]dit\s+(?:pour\s+la\s+)?TPS/TVH": "credit tps/tvh", r"Relev[ée]\s+1": "relevé 1",
               r"solde\s+(?:[àa]\s+payer|d[ûu])": "solde du", r"\bRL-?1\b": "rl1"}
    for pattern, text in samples.items():
        assert re.search(pattern, text, re.IGNORECASE) and classify.required_text(pattern) in text


def test_authority_and_forms(spark):
    letter = "Canada Revenue Agency Notice of Assessment for you tax year 2024 T1\nDear reader"
    frame = spark.createDataFrame([(1, 1, letter), (2, 1, "Statement of Remuneration Paid 2024 T4\nbody"),
                                   (3, 1, "nothing to see")], "doc_id bigint, page_num int, text string")
    found = classification.authority_documents(frame).collect()
    assert [(r.doc_id, r.type, r.form_number, r.confidence) for r in found] == [(1, "notice_of_assessment", "T1", 0.59)]
    forms = {r.doc_id: (r.form_type, r.year, r.confidence, r.issuer) for r in classification.tax_forms(frame).collect()}
    assert forms[2] == ("T4", 2024, 0.95, "employer") and 3 not in forms
    strict = {r.doc_id for r in classification.tax_forms(frame.withColumn("text", F.lit("their being")), True).collect()}
    assert strict == set()


def test_first_declared_type_wins_ties(one):
    text = "proof of income and balance owing"
    assert one(classify.authority_type(F.col("t")), t=text)["name"] == "statement_of_account"


def test_console_issues(spark):
    frame = spark.createDataFrame([(1, 1, "error", "Uncaught TypeError: x is undefined, failed to load"),
                                   (2, 1, "log", "fine")], "seq bigint, session_id bigint, type string, text string")
    hits = _rows(logs.issue_hits(frame), "category", "pattern")
    assert hits == [("javascript", "uncaught.*error"), ("network", "failed to load")]
    assert _rows(logs.log_issues(frame), "category", "severity") == [("javascript", "high"), ("network", "medium")]
    assert logs.search_logs(frame, "100%").count() == 0


def test_report_json_parses(spark, data_dir):
    from leafmill.registry import Inputs
    q = Inputs(spark, data_dir)
    calls = q.view("request_log").withColumnRenamed("user_id", "session_id")
    for row in reports.export_report(q.view("console_logs"), calls, 'A "title"', "json").collect():
        body = json.loads(row.report)
        assert body["title"] == 'A "title"' and len(body["console_errors"]) <= 20
    entries = requests.har_entries(q.view("request_log").withColumn("headers", F.create_map(F.lit("a"), F.lit("b"))),
                                   q.view("responses"))
    entry = json.loads(entries.first().entry)
    assert entry["request"]["headers"] == [{"name": "a", "value": "b"}] and entry["cache"] == {}


def test_codes_are_compared_as_stored(spark):
    dim = spark.createDataFrame([("ABC", "old")], "code string, label string")
    rows = spark.createDataFrame([("abc", "new"), ("my code", "x")], "code string, label string")
    assert _rows(catalog.catalog_add(dim, rows), "code", "label") == [("ABC", "old"), ("MY_CODE", "x")]


def test_empty_log_dashboard(spark, data_dir):
    from leafmill.registry import Inputs
    q = Inputs(spark, data_dir)
    row = executions.dashboard_stats(*[q.view(v).filter("false") for v in (
        "tool_executions", "tool_templates", "training_queue")]).first()
    assert (row.total_executions, row.success_rate, row.avg_confidence, row.pending_queue) == (0, 0.0, 0.0, 0)


def test_detection_payloads(spark):
    frame = spark.createDataFrame([
        (1, False, '```json\n{"logos_detected":[{"name":"X","confidence":0.7}]}\n```'), (2, False, "oops"), (3, False, "{}")],
        "doc_id bigint, skip boolean, payload string")
    parsed = records.parse_detections(frame)
    assert _rows(parsed, "doc_id", "ok", "confidence") == [(1, True, 0.0), (2, False, 0.0), (3, True, 0.0)]
    assert _rows(records.review_filter(parsed), "outcome", "tag") == [("logo", "low"), ("manual", None), ("manual", None)]


def test_duplicates_are_counted_not_paired(spark):
    frame = spark.range(1000).select("id", F.lit("1 rue de l'Église").alias("address"))
    assert _rows(addresses.address_duplicates(frame), "records", "first_id", "last_id") == [(1000, 0, 999)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"12345")
    (tmp_path / "in" / "b.txt").write_bytes(b"1")
    found = tables.scan_objects(spark, str(tmp_path / "in"), "*.pdf")
    assert _rows(found, "name", "length") == [("a.pdf", 5)]
    sessions = spark.createDataFrame([(f"s{i % 40}", i) for i in range(200)], "session_id string, file_id long")
    tables.write_session_results(sessions, str(tmp_path / "out"))
    assert _rows(spark.read.json(str(tmp_path / "out")), "file_id", "session_id") == _rows(sessions, "file_id", "session_id")
    assert _rows(tables.read_session(spark, str(tmp_path / "out"), "s7"), "file_id") == [(i,) for i in range(7, 200, 40)]
    runs = spark.createDataFrame([(i,) for i in range(20)], "id int").withColumn(
        "created_at", F.expr("TIMESTAMP'2024-01-02 03:04:05' + make_interval(0, 0, 0, id % 3)"))
    for _ in range(2):
        tables.append_executions(runs, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert _rows(back, "id", "created_at") == sorted(_rows(runs, "id", "created_at") * 2)
    assert _rows(back.filter("day = DATE'2024-01-03'").distinct(), "id") == [(i,) for i in range(1, 20, 3)]
    tables.write_lines(sessions, "session_id", str(tmp_path / "lines"))
    assert _rows(spark.read.text(str(tmp_path / "lines")), "value") == _rows(sessions, "session_id")


def test_jdbc_reads_every_row_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("name"))
    rows.write.jdbc(url, "things", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    back = tables.read_jdbc(spark, url, "things", "id", 0, 50, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and _rows(back, "id", "name") == _rows(rows, "id", "name")


def test_neighbours_are_the_pages_that_are_there(spark):
    """After pages are dropped, all jobs compare with the same page before."""
    rows = [(1, n, False, False, False, q, 5, 5, 5) for n, q in ((1, 0), (2, 0), (5, 250), (6, 250))]
    frame = spark.createDataFrame(rows, "doc_id bigint, page_num int, is_blank boolean, is_page_one boolean, header_changed boolean, q1 int, q2 int, q3 int, q4 int")
    assert _rows(imaging.layout_changes(frame).filter("layout_changed"), "page_num") == [(5,)]
    assert _rows(imaging.document_boundaries(frame).filter("is_split"), "page_num") == [(1,), (5,)]
    pictures = spark.createDataFrame([(1, n, 4, 4, [v] * 16) for n, v in ((1, 9), (4, 9), (7, 250))], "doc_id bigint, page_num int, width int, height int, gray array<int>")
    assert _rows(imaging.page_similarity(pictures), "page_num", "header_changed") == [(4, False), (7, True)]


def test_matches_of_a_long_page_at_every_place(spark):
    """Empty matches at all places of pages of many lengths, against Python; context is made for the matches asked for only."""
    texts = ["", "tion", "a tionTION b", "x" * 257, "".join("tion é\n"[i * 7919 % 7] for i in range(5000)) + "tiontion"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_num int, text string")
    found = search.search_text(pages, "(?:tion)*")
    got = {(r.doc_id, r.position): (r.matched_text, r.context) for r in found.collect()}
    want = {(i, m.start()): (m.group(), t[max(m.start() - 50, 0):m.end() + 50].replace("\n", " ")) for i, t in enumerate(texts) for m in re.finditer("(?i)(?:tion)*", t)}
    # Java and Python differ in the empty match right behind a match.
    assert {k: v for k, v in got.items() if k in want} == want
    plan = found.filter("position = 0").drop("context", "error")._jdf.queryExecution().optimizedPlan().toString()
    assert "withfield" not in plan.lower() and "AS context" not in plan
