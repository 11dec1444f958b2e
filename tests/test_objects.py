"""Files listed once, expiry reported once, and jobs that answer bad input."""

import os

from pyspark.sql import functions as F

from leafmill.operators import imaging, search
from leafmill.sources import objects
from leafmill.sources.tables import scan_objects


def _put(folder, name, at, size=3):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)
    os.utime(path, (at, at))


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    store, seen = tmp_path / "store", objects.listing(spark, str(tmp_path / "seen"))
    _put(store, "a.pdf", 1_700_000_000)
    _put(store, "deep/b.pdf", 1_700_100_000, 7)
    _put(store, "c.txt", 1_700_000_000)
    run = lambda: objects.list_new(spark, str(store), seen, str(tmp_path / "cp"), glob="*.pdf").awaitTermination()
    run()
    assert sorted((r.name, r.length) for r in seen.read().collect()) == [("a.pdf", 3), ("b.pdf", 7)]
    batches = len(seen.folder.names("log"))
    run()
    assert len(seen.folder.names("log")) == batches
    _put(store, "d.pdf", 1_700_200_000)
    run()
    assert sorted(r.name for r in seen.read().collect()) == ["a.pdf", "b.pdf", "d.pdf"] and len(seen.folder.names("log")) == batches + 1
    assert sorted(r.name for r in seen.read(("2023-11-16", "2023-11-17")).collect()) == ["b.pdf", "d.pdf"]


def test_expired_files_are_reported_once(spark, tmp_path):
    store, reported = tmp_path / "store", objects.listing(spark, str(tmp_path / "reported"))
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    for name, hours in (("old", 30), ("older", 50), ("young", 2)):
        _put(store, name, 1_700_000_000 - hours * 3600)
    first = objects.report_expired(scan_objects(spark, str(store)), reported, now, "r1")
    assert sorted(r.name for r in first.collect()) == ["old", "older"]
    again = objects.report_expired(scan_objects(spark, str(store)), reported, now, "r1")  # the batch is run again
    assert sorted(r.name for r in again.collect()) == ["old", "older"]
    assert objects.report_expired(scan_objects(spark, str(store)), reported, now, "r2").count() == 0
    _put(store, "old", 1_700_000_000 - 40 * 3600)  # written anew: another file
    later = objects.report_expired(scan_objects(spark, str(store)), reported, F.timestamp_seconds(F.lit(1_700_090_000)), "r3")
    assert sorted(r.name for r in later.collect()) == ["old", "young"]


def test_difference_of_listings(spark, tmp_path):
    _put(tmp_path / "s", "a", 1_700_000_000)
    _put(tmp_path / "s", "b", 1_700_000_000)
    before = spark.createDataFrame(scan_objects(spark, str(tmp_path / "s")).collect(), objects.LISTING)
    os.remove(tmp_path / "s" / "a")
    _put(tmp_path / "s", "b", 1_700_000_777)
    _put(tmp_path / "s", "c", 1_700_000_000)
    spark.catalog.refreshByPath(str(tmp_path / "s"))
    got = objects.changes(before, scan_objects(spark, str(tmp_path / "s")))
    assert sorted((r.name, r.change) for r in got.collect()) == [("a", "removed"), ("b", "added"), ("b", "removed"), ("c", "added")]


def test_bad_patterns_and_absent_pages(spark):
    pages = spark.createDataFrame([(1, 1, "a (b")], "doc_id long, page_num int, text string")
    row = search.search_summary(pages, "(").first()
    assert row.error == "Invalid pattern: (" and row.total_matches is None
    assert search.search_summary(pages, r"\(").first().total_matches == 1
    features = spark.createDataFrame([(1, 1, False, True, False, 0, 0, 0, 0), (1, 4, True, False, False, 0, 0, 0, 0), (1, 9, False, False, False, 0, 0, 0, 0)],
                                     "doc_id long, page_num int, is_blank boolean, is_page_one boolean, header_changed boolean, q1 int, q2 int, q3 int, q4 int")
    reasons = {r.page_num: r.reason for r in imaging.document_boundaries(features).collect()}
    assert reasons[9] == "blank_page_4"
