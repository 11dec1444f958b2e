"""Pages in tiles give the figures of whole pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import imaging, tiles


def _pages(spark, shapes, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for n, (w, h) in enumerate(shapes):
        page = draw.integers(0, 256, (h, w))
        page[:, ::3] //= 4  # bars
        page[h // 3:h // 3 + max(1, h // 8)] //= 8  # a dark band
        rows.append((n if n else None, 1, n, w, h, page.reshape(-1).tolist()))
    return spark.createDataFrame(rows, "page_id long, doc_id long, page_num int, width int, height int, gray array<int>")


@pytest.mark.parametrize("side", [2, 5, 7, 64])
def test_tiles_equal_the_page(spark, side):
    pages = _pages(spark, [(16, 9), (15, 14), (21, 8), (7, 7), (8, 15), (2, 6), (11, 20)])
    got = {r.page_id: r for r in tiles.tiled_metrics(tiles.cut_tiles(pages, side), side).collect()}
    want = imaging.image_metrics(pages).collect()
    assert len(got) == len(want)
    for r in want:
        for name in got[r.page_id].__fields__:
            a, b = got[r.page_id][name], r[name]
            assert a == (pytest.approx(b, rel=1e-9, abs=1e-9) if isinstance(b, float) else b), (r.page_id, name)


def test_no_pages_and_repeated_tiles(spark):
    assert tiles.tiled_metrics(tiles.cut_tiles(_pages(spark, []))).count() == 0
    pages = _pages(spark, [(16, 9), (9, 9)])
    once = tiles.cut_tiles(pages, 4)
    got, want = tiles.tiled_metrics(once.union(once), 4), tiles.tiled_metrics(once, 4)
    assert got.exceptAll(want).count() == 0 and got.count() == 2


def test_a_large_scan(spark):
    """A page of 3,000 x 2,000 pixels that arrives in tiles; no row has more than a tile and its edges."""
    w, h, side = 3000, 2000, 512
    draw = np.random.default_rng(2)
    page = draw.integers(0, 256, (h, w)).astype(np.uint8)
    page[700:900] //= 16
    rows = [(5, w, h, x, y, bytearray(page[y * side:(y + 1) * side, x * side:(x + 1) * side].tobytes())) for y in range(4) for x in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, width int, height int, tile_x int, tile_y int, pixels binary")
    assert tiles.with_edges(frame).select(F.max(F.length("own") + F.length("n") + F.length("e"))).first()[0] <= side * side + 2 * side
    got = tiles.tiled_metrics(frame).first()
    whole = page.astype(np.int64)
    padded = np.pad(whole, 1, mode="reflect")
    edge = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * whole
    assert got.variance == pytest.approx(whole.var()) and got.sharpness == pytest.approx(edge.var()) and got.brightness == pytest.approx(whole.mean())
    assert got.density == pytest.approx((whole[:h // 3 * 3, :w // 3 * 3] < 240).mean())
    low = np.pad(whole[int(h * 0.66):], 1, mode="reflect")
    sobel = np.abs((low[:-2] + 2 * low[1:-1] + low[2:])[:, 2:] - (low[:-2] + 2 * low[1:-1] + low[2:])[:, :-2])
    assert got.bars == ((sobel > sobel.mean() + sobel.std()).sum(axis=0) > h * 0.1).sum()
    means = whole.mean(axis=1)
    dark, best, run = means < means.mean() - means.std(), 0, 0
    for d in dark:
        run = run + 1 if d else 0
        best = max(best, run)
    assert got.longest_run == best == 200
