"""Blocked running values against plain Python, on keys far longer than a block."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators.requests import match_requests_fifo
from leafmill.operators.imaging import pair_card_sides
from leafmill.plans.ordered import TOP_LIMIT, Ordered, number_rows, top_rows


def _rows(seed, keys=3, longest=60):
    rng = random.Random(seed)
    rows = []
    for key in range(keys):
        numbers = sorted(rng.sample(range(200), rng.randint(1, longest)))
        rows += [(key, n, rng.randint(-5, 5)) for n in numbers]
    rng.shuffle(rows)
    return rows


def test_running_and_numbering(spark):
    rows = _rows(1)
    frame = spark.createDataFrame(rows, "k int, n int, v int")
    order = Ordered(["k"], ["n"], F.floor(F.col("n") / 7))
    got = number_rows(order.running(order.running(frame, "sum", s=F.col("v")), "max", m=F.col("v")), "no", order)
    want = {}
    for k in {r[0] for r in rows}:
        total, best = 0, None
        for no, (_, n, v) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            total, best = total + v, v if best is None else max(best, v)
            want[k, n] = (total, best, no)
    assert {(r.k, r.n): (r.s, r.m, r.no) for r in got.collect()} == want


def test_segments(spark):
    rows = _rows(2)
    frame = spark.createDataFrame(rows, "k int, n int, v int")
    order = Ordered(["k"], ["n"], F.floor(F.col("n") / 5))
    got = order.segments(frame, ["v"], lambda row, prior: F.abs(row["v"] - prior["v"]) > 3)
    want = {}
    for k in {r[0] for r in rows}:
        before, segment, position = None, 0, 0
        for _, n, v in sorted(r for r in rows if r[0] == k):
            starts = before is None or abs(v - before) > 3
            segment, position = (segment + 1, 1) if starts else (segment, position + 1)
            want[k, n] = (starts, segment, position, before)
            before = v
    assert {(r.k, r.n): (r.starts, r.segment, r.position, r.prior.v if r.prior else None)
            for r in got.collect()} == want


def test_top_rows_are_bounded(spark):
    with pytest.raises(ValueError):
        top_rows(spark.range(1).selectExpr("id AS k", "id AS n"), ["k"], ["n"], TOP_LIMIT + 1)


def test_null_is_a_key_of_its_own(spark):
    rows = [(k, n) for k in (None, "", "a") for n in range(23)]
    numbered = number_rows(spark.createDataFrame(rows, "k string, n int"), "no", Ordered(["k"], ["n"], F.floor(F.col("n") / 5)))
    assert {(r.k, r.n): r.no for r in numbered.collect()} == {(k, n): n + 1 for k, n in rows}


def test_top_rows_limits_before_the_shuffle(spark):
    frame = spark.createDataFrame(_rows(3), "k int, n int, v int")
    top = top_rows(frame, ["k"], [F.desc("n")], 2)
    assert top.groupBy("k").count().filter("count > 2").count() == 0
    assert "WindowGroupLimit" in top._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_fifo_against_a_queue(spark):
    rng = random.Random(4)
    events = []
    for seq in range(400):
        url = "/hot" if rng.random() < 0.7 else f"/u{rng.randint(0, 3)}"
        events.append((seq, url, rng.random() < 0.5, rng.randint(0, 60 * 12)))
    base = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    frame = spark.createDataFrame(events, "seq bigint, url string, done boolean, minute int").withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("minute"), base))
    completions = frame.filter("done").select("seq", "url", "ts", F.lit("response").alias("kind"),
                                              F.lit(200).alias("status"))
    got = {r.seq: r.completion_seq for r in match_requests_fifo(frame.filter("NOT done"), completions).collect()}
    want, queues = {}, {}
    for seq, url, done, minute in sorted(events, key=lambda e: (e[3], e[0])):
        queue = queues.setdefault(url, [])
        if not done:
            queue.append(seq)
            want[seq] = None
        elif queue:
            want[queue.pop(0)] = seq
    assert got == want


def _greedy(cards):
    groups, i = [], 0
    while i < len(cards):
        pair = {cards[i][1], cards[i + 1][1]} if i + 1 < len(cards) else set()
        step = 2 if pair == {"recto", "verso"} else 1
        groups.append([p for p, _ in cards[i:i + step]])
        i += step
    return groups


def test_card_pairs(spark):
    rng = random.Random(5)
    stacks = {1: [(1, "recto"), (2, "recto"), (3, "verso"), (4, "unknown"), (5, "recto")], 2: [(1, "recto"), (2, "verso")],
              3: [(p, rng.choice(["recto", "verso", "unknown"])) for p in range(1, 3000, 7)]}
    frame = spark.createDataFrame([(d, p, s) for d, cards in stacks.items() for p, s in cards],
                                  "doc_id bigint, page_num int, side string")
    got = {}
    for row in pair_card_sides(frame).orderBy("doc_id", "first_page").collect():
        group = [row.first_page] if row.sides == 1 else [row.first_page, row.last_page]
        got.setdefault(row.doc_id, []).append(group)
    assert got == {d: _greedy(cards) for d, cards in stacks.items()}
    assert got[1] == [[1], [2, 3], [4], [5]] and got[2] == [[1, 2]]
