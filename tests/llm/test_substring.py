import hashlib
import random

import pytest

from leafmill.llm import substring

from .conftest import HARD


def brute(rows, size):
    """doc_id -> (words, removed, digest); the windows of all rows, in order of key."""
    cut = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(cut, key=lambda x: (x is not None, x)):
        for p in range(len(cut[i]) - size + 1):
            first.setdefault(tuple(cut[i][p:p + size]), (i, p))
    out = {}
    for i, words in cut.items():
        gone = set()
        for p in range(len(words) - size + 1):
            if first[tuple(words[p:p + size])] != (i, p):
                gone.update(range(p, p + size))
        out[i] = len(words), len(gone), hashlib.sha256(b" ".join(w for p, w in enumerate(words) if p not in gone)).hexdigest()
    return out


def result(docs, size):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.repeats(docs, size=size)).collect()}


@pytest.mark.parametrize("size", [1, 2, 5, 20])
def test_random_texts(docs, size):
    draw = random.Random(size)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [draw.choice("abcdefgh") + str(draw.randrange(40 if size > 2 else 400)) for _ in range(draw.randrange(70))]
        if i % 4 == 0:
            at, n = draw.randrange(len(passage)), draw.randrange(size, 60)
            words[len(words) // 2:len(words) // 2] = passage[at:at + n] * (1 + (i % 8 == 0))
        rows.append((i, draw.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[8][1] + " tail")]
    assert result(docs(rows), size) == brute(rows, size)


def test_hard_rows(hard):
    # Rows of one key differ in text here for NULL keys only, so those are left to the next test.
    rows = [(i, t) for i, t in HARD if i is not None]
    assert result(hard.filter("doc_id IS NOT NULL"), 3) == brute(dict(rows).items(), 3)
    assert substring.digests(substring.repeats(hard, size=3)).count() == len(HARD)


def test_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert result(docs, 20) == brute([(r.doc_id, r.text) for r in docs.collect()], 20)


def test_removal_keeps_what_stands_around(docs):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"first\n{passage}  end"), (2, f"second\n\n{passage}\nkept line"), (3, passage), (4, ""), (5, None), (6, "short\ttext")]
    found = docs(rows)
    left = substring.remove_repeats(found)
    assert left.columns == found.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: rows[0][1], 2: "second\n\nkept line", 4: "", 5: None, 6: "short\ttext"}


def test_empty_table(docs):
    assert result(docs([]), 20) == {} and substring.remove_repeats(docs([])).count() == 0
