"""Batches that count once, and late rows that are counted."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import executions
from leafmill.sources import ledger
from leafmill.streaming import late, metrics

SCHEMA = "id long, tool_name string, created_at timestamp"


def _runs(spark, ids, days=3):
    start = dt.datetime(2024, 5, 1, 12)
    return spark.createDataFrame([(i, f"t{i % 2}", start + dt.timedelta(days=i % days, minutes=i) if i % 7 else None) for i in ids], SCHEMA)


@pytest.fixture
def book(spark, tmp_path):
    return ledger.Ledger(spark, str(tmp_path / "book"), SCHEMA)


def _ids(book, *days):
    return sorted(r.id for r in book.read(*days).collect())


def test_a_batch_counts_once(spark, book):
    assert _ids(book) == []
    assert book.append(_runs(spark, range(10)), "b1") and book.append(_runs(spark, range(10, 20)), "b2")
    assert not book.append(_runs(spark, range(10)), "b1") and not book.append(_runs(spark, range(50, 60)), "b2")
    assert _ids(book) == list(range(20))
    assert book.append(_runs(spark, []), "b3") and book.has("b3") and _ids(book) == list(range(20))
    assert _ids(book, ("2024-05-02", "2024-05-02")) == [i for i in range(20) if i % 3 == 1 and i % 7]


def test_a_killed_write_is_invisible(spark, book, monkeypatch):
    book.append(_runs(spark, range(5)), "b1")
    monkeypatch.setattr(ledger.Folder, "put", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        book.append(_runs(spark, range(5, 9)), "b2")
    bad = _runs(spark, range(5, 9)).withColumn("id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        book.append(bad, "b3")
    monkeypatch.undo()
    assert _ids(book) == list(range(5)) and not book.has("b2")
    assert len([n for n in book.unused() if n.startswith("batch=b2")]) == 1
    assert book.append(_runs(spark, range(5, 9)), "b2") and _ids(book) == list(range(9))


def test_two_writers_of_a_batch(spark, book, monkeypatch):
    """Both find the batch missing; the second one's manifest is refused."""
    first = ledger.Ledger(spark, book.path, SCHEMA)
    first.append(_runs(spark, range(4)), "b1")
    monkeypatch.setattr(ledger.Ledger, "has", lambda *_: False)
    assert not book.append(_runs(spark, range(4)), "b1")
    assert _ids(book) == list(range(4))


def test_merged_days(spark, book):
    for n in range(4):
        book.append(_runs(spark, range(n * 10, n * 10 + 10)), f"b{n}")
    before = book.read()
    files = lambda: sum(len([f for f in os.listdir(f"{book.path}/data/{p}") if f.endswith(".parquet")]) for p in book.parts())
    many = files()
    assert len(book.compact()) == 4 and files() == 4 < many
    assert _ids(book) == list(range(40)) and before.count() == 40  # earlier readers keep what they had
    assert book.compact() == [] and not book.append(_runs(spark, range(10)), "b0")
    book.append(_runs(spark, range(40, 44)), "b4")
    book.compact()
    assert _ids(book) == list(range(44))


def test_a_stream_appends_once(spark, book, tmp_path):
    for n in range(3):
        _runs(spark, range(n * 5, n * 5 + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("cp", "cp", "lost"):  # with a lost checkpoint the batches are run again
        ledger.append_stream(stream, book, "runs", str(tmp_path / checkpoint)).awaitTermination()
        assert _ids(book) == list(range(15))


@pytest.mark.parametrize("width", [None, "10 minutes"])
def test_late_rows_are_counted_over_many_batches_and_a_restart(spark, tmp_path, width):
    draw, base = random.Random(4), dt.datetime(2024, 1, 1)
    batches = []
    for n in range(102 if width else 12):
        batches.append([(n * 10 + k, base + dt.timedelta(seconds=30 * n + draw.choice([0, 5, -60, -900, -4000])) if k else (None if n % 9 == 0 else base)) for k in range(3)])
    path, cp = str(tmp_path / "gate"), str(tmp_path / "cp")
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, created_at timestamp").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        name = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
        os.rename(tmp_path / "one" / name, tmp_path / "in" / f"{n:04d}.parquet")
        os.utime(tmp_path / "in" / f"{n:04d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    half = len(batches) // 2
    for n in range(half, len(batches)):  # the second half comes after a restart
        os.rename(tmp_path / "in" / f"{n:04d}.parquet", tmp_path / f"{n:04d}.parquet")
    for turn in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        late.gate_late_rows(stream, path, cp, "created_at", "5 minutes", width).awaitTermination()
        if not turn:
            for n in range(half, len(batches)):
                os.rename(tmp_path / f"{n:04d}.parquet", tmp_path / "in" / f"{n:04d}.parquet")
    want, latest = set(), None
    span = dt.timedelta(minutes=10)
    for rows in batches:
        for i, at in rows:
            closes = at if at is None or not width else base + ((at - base) // span + 1) * span
            if at is None or (latest is not None and closes <= latest - dt.timedelta(minutes=5)):
                want.add(i)
        times = [at for _, at in rows if at] + ([latest] if latest else [])
        latest = max(times) if times else None
    held = late.late_rows(spark, path, schema)
    assert {r.id for r in held.collect()} == want and held.count() == len(want) > 5
    assert sorted(r.id for r in spark.read.schema(schema).parquet(f"{path}/rows/batch=*/late=false").collect()) == sorted({i for rows in batches for i, _ in rows} - want)


def test_what_passed_the_gate_is_never_dropped(spark, tmp_path):
    runs = [(i, "t", "c", True, 1, 0.5, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=random.Random(i).randrange(600))) for i in range(60)]
    frame = spark.createDataFrame(runs, "id long, tool_name string, tool_class string, success boolean, execution_time_ms int, confidence double, created_at timestamp")
    for n in range(6):
        frame.filter(F.col("id") % 6 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "gate")
    late.gate_late_rows(stream, path, str(tmp_path / "cp"), "created_at", "10 minutes", "1 hour").awaitTermination()
    passed = late.on_time_rows(spark, path, frame.schema)
    query = (metrics.stream_tool_metrics(passed).writeStream.format("memory").queryName("gated").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    query.awaitTermination()
    kept = frame.join(late.late_rows(spark, path, frame.schema), "id", "left_anti")
    assert late.late_rows(spark, path, frame.schema).count() + kept.count() == 60
    want = executions.tool_metrics(kept)
    got = spark.table("gated")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
