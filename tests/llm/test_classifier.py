import zlib

import numpy as np
import pytest

from leafmill.llm import classifier

from .conftest import HARD


def test_held_out_labels_are_told_apart(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in classifier.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    known = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [r.score for r, q in known if q], [r.score for r, q in known if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted == q for r, q in known]) > 0.85


def test_hard_rows_without_labels(spark, hard, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = classifier.score(hard, none).collect()
    assert len(rows) == len(HARD) and all(r.score == pytest.approx(0.5) for r in rows)
    odd = spark.createDataFrame([(4, None), (None, 1), (5, 1), (6, 0), (77, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in classifier.score(hard, odd).collect())
    assert classifier.score(docs([]), none).count() == 0


def test_vectors_equal_a_plain_loop(docs):
    texts = ["a b c a", "b c d", "x", "", "c d e f g"]
    sums, places_signs = {}, classifier._index_vectors(np.arange(classifier.SLOTS))
    index = np.zeros((classifier.SLOTS, classifier.WIDTH))
    for slot in range(classifier.SLOTS):
        np.add.at(index[slot], places_signs[0][slot], places_signs[1][slot])
    import pyarrow as pa
    for text in texts:
        slots, _ = classifier._slots(pa.array([text]))
        for p, here in enumerate(slots):
            for q in range(max(0, p - classifier.REACH), min(len(slots), p + classifier.REACH + 1)):
                if p != q:
                    sums[here] = sums.get(here, 0) + index[slots[q]]
    got = classifier.word_vectors(docs(list(enumerate(texts))))
    for slot, total in sums.items():
        if np.linalg.norm(total):
            assert got[slot] @ total / np.linalg.norm(got[slot]) / np.linalg.norm(total) == pytest.approx(1, abs=1e-5)


def test_temperature_lowers_the_loss():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, 6))
    y = (draw.random(4000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    model = classifier.Network(x[:3000], y[:3000])
    loss = lambda t: np.mean(np.logaddexp(0, model.logit(x[3000:]) / t) - y[3000:] * model.logit(x[3000:]) / t)
    assert loss(model.temperature) <= loss(1.0) + 1e-3
