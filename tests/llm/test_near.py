import random
from collections import defaultdict

import pytest

from leafmill.llm import near
from leafmill.llm.graph import components

from .conftest import HARD


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[p:p + size]) for p in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """Component of each row as the smallest key, from all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    order = lambda x: (x is not None, x or 0)  # noqa: E731  NULL first, as in Spark
    return [(rows[i][0], len(sets[i]), min(groups[find(i)], key=order)) for i in range(len(rows))]


def result(docs, size, percent, **more):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(docs, size=size, percent=percent, **more).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("size,percent,block", [(3, 85, 1 << 18), (5, 80, 1 << 18), (3, 85, 400), (5, 80, 150)])
def test_groups_of_near_copies(docs, size, percent, block):
    draw, rows = random.Random(3), []
    for group in range(6):
        base = [f"g{group}w{draw.randrange(500)}" for _ in range(80)]
        for _ in range(draw.choice([2, 5, 40])):
            words = list(base)
            for _ in range(draw.randrange(6)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500, rows[0][1].upper()), (501, rows[0][1])]
    assert ordered(result(docs(rows), size, percent, block=block)) == ordered(brute(rows, size, percent))


def test_hard_rows(hard):
    assert ordered(result(hard, 3, 85)) == ordered(brute(HARD, 3, 85))
    left = near.keep_one(hard)
    assert left.columns == hard.columns
    texts = [r.text for r in left.collect()]
    assert texts.count("one two three") == 2 and sum(not (t or "").split() for t in texts) == 4


def test_empty_table(docs):
    assert result(docs([]), 3, 85) == [] and near.keep_one(docs([])).count() == 0


def test_bands_reach_the_threshold():
    for threshold in (0.7, 0.8, 0.85, 0.95):
        rows = near.band_rows(threshold)
        assert (1 - threshold ** rows) ** (2 * near.PERMUTATIONS // rows) <= near.MISS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {301: 300}


@pytest.mark.parametrize("crossing", [False, True])
def test_no_group_grows_with_a_cluster(docs, monkeypatch, crossing):
    """Two families joined by false buckets (and, if ``crossing``, by one chain of links): no group holds a whole family."""
    draw, rows, block = random.Random(8), [], 600
    shared = [f"s{k}" for k in range(25)]
    for family in "ab":
        base = shared + [f"{family}{k}" for k in range(35)]
        for _ in range(60):
            words = list(base)
            for _ in range(2):
                words[draw.randrange(25, 60)] = f"x{draw.randrange(10 ** 6)}"
            rows.append((len(rows) + 2, " ".join(words)))
    if crossing:
        steps = [" ".join(shared + [f"b{k}" if k < n else f"a{k}" for k in range(35)]) for n in range(0, 36)]
        rows += [(1000 + i, t) for i, t in enumerate(steps)]
    linker = near._linker

    def bounded(size, percent):
        link = linker(size, percent)

        def run(table):
            texts = set(table.column("text").to_pylist())
            assert sum(len(t.split()) for t in texts) <= 4 * block, "a group has grown with its cluster"
            return link(table)
        return run
    monkeypatch.setattr(near, "_linker", bounded)
    monkeypatch.setattr(near, "ANCHORS", 6)
    monkeypatch.setattr(near, "band_rows", lambda *a: 4)
    got = ordered(result(docs(rows), 1, 80, block=block))
    assert got == ordered(brute(rows, 1, 80)) and len({r[2] for r in got}) == (1 if crossing else 2)


def test_texts_are_not_shuffled_to_leave_out_few(spark):
    """What goes is a small table whose size is known; the texts that stay are not shuffled to meet it."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (None, "of no key"), (None, "of no key"), (3, None)]
    left = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, left.collect())) == sorted(f"Row(doc_id={k}, text={t!r})" for k, t in rows if k != 2)
