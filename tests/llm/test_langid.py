import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid

from .conftest import HARD


@pytest.mark.parametrize("sizes", [[5], [1, 3, 0, 4], [6, 2], [0, 0, 1]])
@pytest.mark.parametrize("block", [1, 2, 3, 0])
def test_marginals_equal_the_sum_over_all_paths(sizes, block):
    draw, labels = np.random.default_rng(3), 3
    scores, start, change = draw.normal(size=(sum(sizes), labels)), draw.normal(size=labels), draw.normal(size=(labels, labels))
    want, at = [], 0
    for n in sizes:
        total = np.zeros((n, labels))
        for path in itertools.product(range(labels), repeat=n):
            weight = np.exp(sum(scores[at + t, y] for t, y in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])) + (start[path[0]] if n else 0))
            for t, y in enumerate(path):
                total[t, y] += weight
        want.append(total / total.sum(axis=1, keepdims=True))
        at += n
    assert np.allclose(langid.marginals(scores, np.array(sizes), start, change, block), np.concatenate(want))


def test_long_texts_in_blocks_equal_one_block():
    draw = np.random.default_rng(4)
    sizes = np.array([3000, 1, 64, 65, 0, 129])
    scores = draw.normal(scale=8, size=(sizes.sum(), 4))
    start, change = draw.normal(size=4), draw.normal(scale=3, size=(4, 4))
    whole = langid.marginals(scores, sizes, start, change, 4000)
    for block in (7, 64):
        assert np.allclose(langid.marginals(scores, sizes, start, change, block), whole, atol=1e-9)


def test_transitions_have_the_slope_of_the_likelihood():
    draw = np.random.default_rng(5)
    psi, start, change = np.exp(draw.normal(size=(2, 4, 3))), draw.normal(size=3), draw.normal(size=(3, 3))

    def log_sum(change):
        return sum(np.log(sum(np.exp(start[p[0]] + sum(change[a, b] for a, b in zip(p, p[1:]))) * np.prod([one[t, y] for t, y in enumerate(p)])
                              for p in itertools.product(range(3), repeat=4))) for one in psi)

    _, moves = langid._pairs(psi, start, change)
    for i, j in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        assert moves[i, j] == pytest.approx((log_sum(change + step) - log_sum(change - step)) / 2e-5, abs=1e-5)


def test_features_do_not_depend_on_the_other_words():
    words = ["Haus", "HAUS", "h", "", "12", "x" * 5000, "été"]
    spelt = langid.spell(words)
    assert list(spelt.sizes) == [4, 4, 1, 0, 0, 5000, 3]
    own, hashes = langid.features(spelt)
    for k, word in enumerate(words):
        _, alone = langid.features(langid.spell([word])) if langid.spell([word]).sizes[0] else (None, np.zeros(0))
        assert sorted(hashes[own == k]) == sorted(alone)
    assert sorted(hashes[own == 0]) == sorted(hashes[own == 1])


def _words(draw, pool, n):
    return " ".join(draw.choice(pool) for _ in range(n))


def test_code_switched_text_is_told_apart(docs):
    """Words made of the syllables of two invented languages; a text that changes over has two runs."""
    draw = random.Random(1)
    pools = [["".join(draw.choice(s) for _ in range(3)) for _ in range(200)] for s in (["ka", "to", "mi", "ru"], ["sch", "ung", "pfe", "gel"])]
    rows = [(i, _words(draw, pools[i % 2], 60)) for i in range(200)]
    mixed = _words(draw, pools[0], 15) + " 77 " + _words(draw, pools[1], 20)
    frame = docs(rows + [(1001, mixed)]).withColumn("lang", F.when(F.col("doc_id") == 1001, F.lit(None).cast("string")).when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    found = {r.doc_id: r for r in langid.identify(frame, F.col("doc_id") < 1000, runs=True).collect()}
    assert all(found[i].lang_pred == ("bb" if i % 2 else "aa") for i in range(200))
    first, second = found[1001].runs
    assert (first.lang, second.lang) == ("aa", "bb") and first.first_word == 0 and first.last_word in (14, 15) and second.last_word == 35


def test_held_out_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = langid.of_documents(docs).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [r.lang_pred == true[r.doc_id] for r in rows if r.held_out and true[r.doc_id]]
    assert np.mean(held) > 0.97


def test_only_what_may_be_learned_is_learned(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert sorted(langid.of_documents(docs).collect()) == sorted(langid.of_documents(other).collect())


def test_hard_rows(hard, docs):
    rows = langid.of_documents(hard).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        text = max((t or "" for i, t in HARD if i == r.doc_id), key=len)
        assert r.lang_pred == ("en" if any(c.isalpha() for c in text) else "und") or r.doc_id is None
        assert r.score == pytest.approx(1.0 if r.lang_pred == "en" else 0.0)
    nothing = hard.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.of_documents(nothing).collect()} == {("und", 0.0)}
    assert langid.of_documents(docs([])).count() == 0
