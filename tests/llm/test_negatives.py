import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import negatives


def _brute(rows, is_anchor, positives=5, count=10, scale=256):
    sound = [(k, i, [math.floor(scale * x) for x in v], c) for k, (i, v, c) in enumerate(rows)
             if c is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    out, first = [], lambda r: (-r[0], r[1] is None, r[1] or 0)
    for k, i, v, c in sound:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, d) for m, j, w, d in sound if m != k]
        for p in sorted((s for s in scored if s[2] == c), key=first)[:positives]:
            fits = [s for s in scored if s[2] != c and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            out += [(i, p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(sorted(fits, key=first)[:count])]
    return sorted(out, key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "x", True) for i, v, c in rows], "vec_id long, embedding array<float>, label int, row int, id string, anchor boolean")


def _got(frame, step, **options):
    return sorted((tuple(r) for r in negatives.mine(frame, F.col("vec_id") % step == 0, **options).collect()), key=repr)


def _random_rows(seed, n, width, labels):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [float(np.float32(draw.gauss(x, 0.7))) for x in centres[i % 6]]
        rows.append((i, v, draw.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed,width,labels", [(1, 8, 3), (2, 17, 2), (3, 64, 5)])
def test_equals_brute_force(spark, seed, width, labels):
    rows = _random_rows(seed, 700, width, labels)
    assert _got(_frame(spark, rows), 20) == _brute(rows, lambda i: i % 20 == 0)


def test_ties_copies_and_odd_rows(spark):
    """A third of all rows is one vector; scores tie; anchors are repeated; some rows take no part."""
    rows = _random_rows(5, 300, 8, 3)
    rows += [(1000 + i, [1.0] * 8, i % 2) for i in range(200)] + [(40, rows[40][1], rows[40][2])] * 2
    rows += [(None, [1.0] * 8, 1), (None, [0.5] * 8, 0), (2000, [0.0] * 8, 1), (2020, None, 1), (2040, [1.0] * 7 + [None], 1), (2060, [float("nan")] * 8, 1), (2080, [1.0] * 8, None), (2100, [], 1)]
    assert _got(_frame(spark, rows), 20) == _brute(rows, lambda i: i % 20 == 0)


def test_small_groups_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "TRIED", 3)
    rows = _random_rows(9, 500, 8, 3)
    assert _got(_frame(spark, rows), 10, positives=2, negatives=4) == _brute(rows, lambda i: i % 10 == 0, 2, 4)


def test_no_rows(spark):
    assert _got(_frame(spark, []), 10) == []
    assert _got(_frame(spark, [(10, [1.0, 2.0], 1)]), 10) == []
    assert _got(_frame(spark, [(10, [1.0, 2.0], 1), (11, [1.0, 2.0], 1), (12, None, 2)]), 10) == []


def test_intervals_hold_every_score():
    draw = np.random.default_rng(8)
    for width, size in ((3, 100), (64, 30), (64, 20000)):
        numbers = draw.integers(-size, size, (400, width)).astype(np.int32)
        numbers[0] = 0
        turn = negatives.rotation(width)
        group = negatives.Codes(*negatives.encode(numbers, turn))
        for anchor in np.concatenate([numbers[:20], draw.integers(-size, size, (20, width))]):
            low, high = group.interval(anchor.astype(float), turn)
            score = numbers.astype(np.int64) @ anchor.astype(np.int64)
            assert (low <= score).all() and (score <= high).all()
        if width == 64:  # and are narrow enough to drop rows
            assert np.median(high - low) < 0.7 * np.linalg.norm(anchor) * np.median(np.linalg.norm(numbers, axis=1))
