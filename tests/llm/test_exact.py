import hashlib
from collections import defaultdict

import pytest

from leafmill.llm import exact

from .conftest import HARD

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    return {(i, hashlib.sha256(text.encode()).hexdigest()): (max((x for x in ids if x is not None), default=None), len(ids)) for text, ids in groups.items() for i in ids}


def test_hard_rows(spark, hard):
    got = exact.DigestIndex(spark, buckets=4).add(hard).collect()
    want = brute(HARD)
    assert len(got) == len(HARD)
    for r in got:
        assert want[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size)
    # One row stays per text, repeated rows included.
    assert sum(r.kept for r in got) == len({k[1] for k in want})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_later_batches_meet_the_index_on_disk(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact.DigestIndex(spark, path, buckets=4)
    first.add(docs([(1, "Same"), (2, "other")]))
    again = exact.DigestIndex(spark, path, buckets=4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(docs([(5, "sAME"), (6, "new"), (7, "NEW")])).collect()}
    assert got == {5: (1, False), 6: (7, False), 7: (7, True)}
    assert again.table().count() == 3


def test_index_side_is_not_shuffled(spark, docs):
    index = exact.DigestIndex(spark, buckets=4)
    plan = docs([(1, "a")]).selectExpr("unhex(text) AS digest").join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_drop_copies_keeps_all_columns(spark, hard, docs):
    left = exact.drop_copies(hard, exact.DigestIndex(spark, buckets=4))
    assert left.columns == hard.columns and left.schema == hard.schema
    texts = [(r.text or "").translate(UP) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(UP) for _, t in HARD})


def test_empty_table(spark, docs):
    index = exact.DigestIndex(spark, buckets=4)
    assert index.add(docs([])).count() == 0 and index.table().count() == 0


def test_a_batch_that_is_run_again_keeps_its_texts(spark, docs):
    index = exact.DigestIndex(spark, buckets=4)
    index.add(docs([(1, "old")]), batch="b0")
    rows = docs([(5, "OLD"), (6, "new"), (7, "NEW"), (7, "NEW"), (8, None)])
    verdicts = lambda: sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(rows, batch="b1").collect())
    first = verdicts()
    assert first == [(5, 1, False), (6, 7, False), (7, 7, False), (7, 7, True), (8, 8, True)]
    assert verdicts() == first and index.table().count() == 3


def test_a_killed_append_is_completed(spark, docs):
    """Some of a batch's digests reached the index before the job died."""
    rows = [(i, f"text {i}") for i in range(20)]
    whole = exact.DigestIndex(spark, buckets=4)
    want = sorted(map(tuple, whole.add(docs(rows), batch="b").collect()))
    half = exact.DigestIndex(spark, buckets=4)
    half.add(docs(rows[:9]), batch="b")
    assert sorted(map(tuple, half.add(docs(rows), batch="b").collect())) == want and half.table().count() == 20


def test_another_number_of_buckets_is_refused(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact.DigestIndex(spark, path, buckets=4)
    first.add(docs([(1, "a")]))
    with pytest.raises(ValueError, match="4 buckets"):
        exact.DigestIndex(spark, path, buckets=8)
    first.close()
    assert not spark.catalog.tableExists(first.name)
    assert [r.kept for r in exact.DigestIndex(spark, path, buckets=4).add(docs([(2, "A")])).collect()] == [False]
