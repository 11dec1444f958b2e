import hashlib
import math
import random

import numpy as np
import pytest

from leafmill.llm import codes


def _brute(rows, parts, entries, rounds, scale):
    """A plain loop over (id, vector, label): id -> (code, error, label_error), and the digest of the codebooks."""
    sound = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = []
    for i, v, c in sound:
        numbers = [math.floor(scale * x) for x in v]
        w = len(numbers) // parts
        cut.append((i, [tuple(numbers[p * w:(p + 1) * w]) for p in range(parts)], c))
    order = sorted((r for r in cut if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[r[1][p] for r in order] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((away(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for r in cut:
                groups.setdefault(near(r[1][p], book)[1], []).append(r[1][p])
            for k, found in groups.items():
                book[k] = tuple(sum(x) // len(found) for x in zip(*found))
    out = []
    for i, vector, c in cut:
        found = [near(vector[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), c))
    totals = {}
    for _, _, e, c in out:
        totals[c] = totals.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, k, e, totals[c], digest) for i, k, e, c in out), key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "x", 2.5) for i, v, c in rows], "vec_id long, embedding array<float>, label int, row int, code string, x double")


@pytest.mark.parametrize("entries,rounds", [(256, 4), (7, 3), (2, 0)])
def test_codes_equal_a_plain_loop(spark, entries, rounds):
    draw = random.Random(entries)
    rows = [(i, [draw.gauss(i % 3, 0.3) for _ in range(8)], draw.choice([None, 1, 2])) for i in range(350)]
    rows += [(400 + i, [0.5] * 8, 9) for i in range(700)]  # one vector fills blocks of its own
    rows += [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [float("inf")] * 8, 2), (2004, [], 2), (2005, [1.0] * 4, 2)]
    rows += [(5, [0.25] * 8, 1), (5, [0.25] * 8, 1), (None, [3.0] * 8, None)]
    want = _brute([r for r in rows if r[0] is None or r[0] < 2004], 4, entries, rounds, 1024)
    rows = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, c) for i, v, c in rows]
    want = _brute([r for r in rows if r[0] is None or r[0] < 2004], 4, entries, rounds, 1024)
    got = codes.compress(_frame(spark, rows), entries=entries, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_few_and_no_rows(spark):
    one = codes.compress(_frame(spark, [(3, [0.1, -0.1, 0.0, 2.0], None)])).collect()
    assert [tuple(r)[:4] for r in one] == [(3, "00000000", 0, 0)]
    assert codes.compress(_frame(spark, [])).count() == 0
    assert codes.compress(_frame(spark, [(1, None, 2)])).count() == 0
    assert codes.compress(_frame(spark, [(None, [1.0] * 4, 2)])).count() == 0  # nothing to start from


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="must stay below"):
        codes.compress(_frame(spark, [(1, [3e30] * 4, 1)])).collect()


def test_curve_visits_each_cell_once_by_single_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2 ** bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        place = codes.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_short_list_keeps_every_nearest_entry():
    draw = np.random.default_rng(2)
    for _ in range(200):
        points, book = draw.integers(-20, 20, (9, 3)), draw.integers(-30, 30, (12, 3))
        listed = codes.short_list(points.min(axis=0), points.max(axis=0), book)
        best = ((points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
        assert set(best) <= set(listed) and (np.diff(listed) > 0).all()
