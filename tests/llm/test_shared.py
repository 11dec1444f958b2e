"""Rows meet the few keys that concern them without a shuffle of the others."""

import random
import time

import pytest

from leafmill.llm import exact, near, shared, substring


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    time.sleep(0.3)
    spark.range(1).count()
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def no_broadcast(spark):
    """As on large tables, Spark sends no side of a join to all executors by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("stage", ["exact", "near", "substring"])
def test_texts_that_stay_are_not_shuffled(spark, docs, no_broadcast, stage):
    draw = random.Random(4)
    rows = [(i, " ".join(f"{draw.getrandbits(240):x}" for _ in range(300))) for i in range(60)]
    passage = " ".join(rows[0][1].split()[:30])
    rows += [(100, rows[1][1]), (101, rows[2][1].upper()), (102, "tail " + passage), (None, rows[3][1]), (None, rows[3][1]), (103, None)]
    found = docs(rows).cache()
    assert found.count() == len(rows)
    before = shuffled(spark)
    left = {"exact": lambda: exact.drop_copies(found, exact.DigestIndex(spark, buckets=4)), "near": lambda: near.keep_one(found),
            "substring": lambda: substring.remove_repeats(found)}[stage]()
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    size = sum(len(t or "") for _, t in rows)
    # Of 66 texts 8 at most concern each other.
    assert shuffled(spark) - before < size / 2
    texts = dict(rows)
    # Exact copies keep the largest key, near ones the smallest (NULL first), repeated passages the first place.
    gone = {"exact": {1, 2, None}, "near": {100, 101, 3}, "substring": {100, 3}}[stage]
    want = {k: t for k, t in texts.items() if k not in gone} | ({102: "tail "} if stage == "substring" else {})
    if stage == "near":
        want.pop(3, None)
    assert {k: t for k, t in got if k is not None} == {k: t for k, t in want.items() if k is not None}
    assert [k for k, _ in got].count(None) == {"exact": 0, "near": 2, "substring": 2}[stage]
    found.unpersist()


@pytest.mark.parametrize("most", [1 << 15, 1 << 27])
def test_key_map_loses_no_key(spark, monkeypatch, most):
    """Inside and outside are all rows, every key is inside; a map that is too small for its keys leaves more inside."""
    monkeypatch.setattr(shared, "MOST_BITS", most)
    rows = spark.range(40_000).selectExpr("if(id = 0, null, id) AS id", "id % 7 AS k")
    found = shared.KeyMap(rows.filter("id IS NULL OR id % 4 = 0"), "id", "k")
    inside, outside = ([r.id for r in part.collect()] for part in (found.inside(rows, "id", "k"), found.outside(rows, "id", "k")))
    assert sorted(map(str, inside + outside)) == sorted(map(str, [None, *range(1, 40_000)]))
    assert {None, *range(4, 40_000, 4)} <= set(inside)
    assert len(outside) > (27_000 if most > 1 << 15 else 20_000)
    none = shared.KeyMap(rows.filter("false"), "id", "k")
    assert none.inside(rows, "id", "k").count() == 0 and none.outside(rows, "id", "k").count() == 40_000
