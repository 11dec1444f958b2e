"""The queries against DuckDB, and the pipeline's stages against plain Python."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from leafmill.llm import quality, queries  # noqa: E402

from .test_exact import UP  # noqa: E402
from .test_near import brute as near_brute  # noqa: E402
from .test_substring import brute as cut_brute  # noqa: E402


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(name, spark, duck, data_dir):
    frame = queries.QUERIES[name](spark, data_dir)
    columns = sorted(frame.columns)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want and want


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, states[-1], data_dir)
        assert after.columns == docs.columns
        states.append(after.cache())
    texts = [{r.doc_id: r.text for r in s.collect()} for s in states]
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert set(texts[1]) == good
    last = {}
    for i in sorted(texts[1]):
        last[texts[1][i].translate(UP)] = i
    assert set(texts[2]) == set(last.values())
    assert set(texts[3]) == {i for i, _, root in near_brute(sorted(texts[2].items()), 5, 80) if i == root}
    cut = cut_brute(texts[3].items(), 20)
    assert set(texts[4]) == {i for i, (n, gone, _) in cut.items() if gone < n or not n}
    import hashlib
    assert all(hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == cut[i][2] for i, t in texts[4].items())
    assert all(r.n_chars == len(r.text) for r in states[4].collect())
    for s in states[1:]:
        s.unpersist()


def test_run_packs_what_the_stages_leave(spark, data_dir):
    rows = corpus_pipeline.run(spark, data_dir).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sorted(sizes) == list(range(len(sizes))) and [s for s in sorted(sizes.values())][1:] == [1024] * (len(sizes) - 1)
