"""Figures of page images that are kept in tiles, so that no row has to hold a page.

A tile is a row with the bytes of its own pixels. Each tile hands its edges to its neighbours, one aggregate by
tile puts them around it, and numpy kernels run over a tile at a time; what lies beyond the page is its
mirror image. Tiles give whole-number sums, which add up to the figures of the page exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions import imaging as rules
from leafmill.sources.scratch import keep

#: Pixels along a tile's sides.
SIDE = 512
_SIDES = {"n": (0, -1), "s": (0, 1), "w": (-1, 0), "e": (1, 0), "nw": (-1, -1), "ne": (1, -1), "sw": (-1, 1), "se": (1, 1)}
_PAGE = ["page_id", "width", "height"]
#: First row of the part of a card that is looked through for bars.
_LOWER = "cast(floor(height * 0.66) AS int)"


def cut_tiles(images: DataFrame, side: int = SIDE) -> DataFrame:
    """(page_id, width, height, tile_x, tile_y, pixels) of images that do fit a row, with a ``gray`` array of values up to 255."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, height = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                page = batch.column("gray")[i].values.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(height, width)
                spots = [(x, y) for y in range(-(-height // side)) for x in range(-(-width // side))]
                n = len(spots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("page_id")[i].as_py()] * n, batch.schema.field("page_id").type), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()),
                     pa.array([x for x, _ in spots], pa.int32()), pa.array([y for _, y in spots], pa.int32()),
                     pa.array([page[y * side:(y + 1) * side, x * side:(x + 1) * side].tobytes() for x, y in spots], pa.binary())],
                    [*_PAGE, "tile_x", "tile_y", "pixels"])

    rows = images.filter("width > 0 AND height > 0").select("page_id", F.col("width").cast("int"), F.col("height").cast("int"), F.col("gray").cast("array<int>"))
    return rows.mapInArrow(cut, f"page_id {rows.schema['page_id'].dataType.simpleString()}, width int, height int, tile_x int, tile_y int, pixels binary")


def _shape(tile: dict, side: int) -> tuple[int, int]:
    return min(side, tile["height"] - tile["tile_y"] * side), min(side, tile["width"] - tile["tile_x"] * side)


def with_edges(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles with the edge pixels of the up to eight tiles around them, NULL where the page ends. Pixels are shuffled once."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in [*_PAGE, "tile_x", "tile_y", "side", "pixels"]}
            for tile in batch.to_pylist():
                rows, columns = _shape(tile, side)
                own = np.frombuffer(tile["pixels"], np.uint8).reshape(rows, columns)
                parts = [("own", tile["tile_x"], tile["tile_y"], tile["pixels"])]
                for name, (dx, dy) in _SIDES.items():  # this tile lies to that side of the one that gets the edge
                    x, y = tile["tile_x"] - dx, tile["tile_y"] - dy
                    if 0 <= x < -(-tile["width"] // side) and 0 <= y < -(-tile["height"] // side):
                        edge = own[{-1: slice(-1, None), 0: slice(None), 1: slice(0, 1)}[dy], {-1: slice(-1, None), 0: slice(None), 1: slice(0, 1)}[dx]]
                        parts.append((name, x, y, edge.tobytes()))
                for name, x, y, pixels in parts:
                    for c, v in zip(out, (tile["page_id"], tile["width"], tile["height"], x, y, name, pixels)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field(c).type if c in _PAGE else pa.string() if c == "side" else pa.binary() if c == "pixels" else pa.int32()) for c, v in out.items()], list(out))

    kind = tiles.schema["page_id"].dataType.simpleString()
    columns = tiles.select("page_id", F.col("width").cast("int"), F.col("height").cast("int"), F.col("tile_x").cast("int"), F.col("tile_y").cast("int"), "pixels")
    edges = columns.mapInArrow(spread, f"page_id {kind}, width int, height int, tile_x int, tile_y int, side string, pixels binary")
    return edges.groupBy(*_PAGE, "tile_x", "tile_y").agg(*[F.max(F.when(F.col("side") == s, F.col("pixels"))).alias(s) for s in ("own", *_SIDES)]).filter("own IS NOT NULL")


def _framed(tile: dict, side: int) -> np.ndarray:
    """The tile with a frame of one pixel: its neighbours' edges, or the mirror image at the end of the page."""
    rows, columns = _shape(tile, side)
    found = {s: np.frombuffer(tile[s], np.uint8).astype(np.int64) if tile[s] is not None else None for s in ("own", *_SIDES)}
    out = np.zeros((rows + 2, columns + 2), np.int64)

    def line(own: np.ndarray, left: np.ndarray | None, right: np.ndarray | None) -> np.ndarray:
        """Rows with a pixel more at each end."""
        near = own[:, 1:2] if columns > 1 else (right if right is not None else own)
        far = own[:, -2:-1] if columns > 1 else (left if left is not None else own)
        return np.hstack([left if left is not None else near, own, right if right is not None else far])

    across = lambda s, n: None if found[s] is None else found[s].reshape(n, 1)
    out[1:-1] = line(found["own"].reshape(rows, columns), across("w", rows), across("e", rows))
    above = None if found["n"] is None else line(found["n"].reshape(1, columns), across("nw", 1), across("ne", 1))[0]
    below = None if found["s"] is None else line(found["s"].reshape(1, columns), across("sw", 1), across("se", 1))[0]
    out[0] = above if above is not None else out[2] if rows > 1 else below if below is not None else out[1]
    out[-1] = below if below is not None else out[-3] if rows > 1 else above if above is not None else out[1]
    return out


def _sobel(framed: np.ndarray, first: int, top: int, height: int) -> np.ndarray:
    """Absolute horizontal Sobel response of the tile's rows from page row ``top`` on, where the image is mirrored."""
    begin = max(top - first, 0)
    middle, up, down = framed[1 + begin:-1], framed[begin:-2].copy(), framed[2 + begin:].copy()
    if len(middle) and first + begin == top:
        up[0] = down[0] if top + 1 < height else middle[0]
    if len(middle) and first + begin + len(middle) == height and top + 1 == height:
        down[-1] = middle[-1]
    smooth = up + 2 * middle + down
    return np.abs(smooth[:, 2:] - smooth[:, :-2])


def _sums(side: int):
    """Per tile: sums of pixels, ink, Laplacian and Sobel, and of each of its rows."""
    names = ["n", "s", "q", "ink", "le", "lq", "en", "es", "eq"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = []
            for tile in batch.to_pylist():
                framed, (rows, columns) = _framed(tile, side), _shape(tile, side)
                own, y, x = framed[1:-1, 1:-1], tile["tile_y"] * side, tile["tile_x"] * side
                cells = own[:max(0, tile["height"] // 3 * 3 - y), :max(0, tile["width"] // 3 * 3 - x)]
                edge = framed[:-2, 1:-1] + framed[2:, 1:-1] + framed[1:-1, :-2] + framed[1:-1, 2:] - 4 * own
                bars = _sobel(framed, y, tile["lower"], tile["height"]) if y + rows > tile["lower"] else np.zeros((0, columns), np.int64)
                found.append([own.size, own.sum(), (own * own).sum(), (cells < rules.WHITE).sum(), edge.sum(), (edge * edge).sum(), bars.size, bars.sum(), (bars * bars).sum(), y, own.sum(axis=1).tolist()])
            columns = [pa.array([int(f[k]) for f in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PAGE), *columns, pa.array([f[-2] for f in found], pa.int32()), pa.array([f[-1] for f in found], pa.list_(pa.int64()))], [*_PAGE, *names, "y", "rows"])

    return add, "width int, height int, " + ", ".join(f"{n} long" for n in names) + ", y int, rows array<long>"


def _columns_over(side: int):
    """Per tile: how many responses of each of its columns are above the page's limit."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = [(_sobel(_framed(t, side), t["tile_y"] * side, t["lower"], t["height"]) > t["cut"]).sum(axis=0).tolist() for t in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("tile_x"), pa.array(over, pa.list_(pa.int64()))], ["page_id", "tile_x", "over"])
    return count


def _spread(n: str, s: str, q: str) -> Column:
    """Population variance from whole-number sums, exact up to the division."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    top = F.greatest(F.lit(0).cast("decimal(38,0)"), big(n) * big(q) - big(s) * big(s))
    return top.cast("double") / (F.col(n).cast("double") * F.col(n).cast("double"))


def tiled_metrics(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The figures of ``imaging.image_metrics`` for pages kept as tiles (page_id, width, height, tile_x, tile_y, pixels).

    ``page_id`` is unique to a page and all its tiles are there; of a tile that is repeated one counts. Pages are at
    least two pixels wide and high. A task holds one tile and its edges at a time; a page's rows and columns
    meet as one number each, in aggregates by (page, row) and (page, column).
    """
    kind = tiles.schema["page_id"].dataType.simpleString()
    framed = keep(with_edges(tiles, side), "tiles").withColumn("lower", F.expr(_LOWER))
    add, fields = _sums(side)
    sums = keep(framed.mapInArrow(add, f"page_id {kind}, {fields}"), "tile-sums")
    pages = sums.groupBy(*_PAGE).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "ink", "le", "lq", "en", "es", "eq")])
    pages = pages.withColumns({
        "variance": _spread("n", "s", "q"), "brightness": F.col("s") / F.col("n"), "contrast": F.sqrt(_spread("n", "s", "q")),
        "sharpness": _spread("n", "le", "lq"), "cut": F.col("es") / F.col("en") + F.sqrt(_spread("en", "es", "eq")),
        "density": F.try_divide("ink", F.floor(F.col("width") / 3) * F.floor(F.col("height") / 3) * 9)})
    limits = pages.select(F.col("page_id").alias("of"), "cut")
    lower = framed.filter((F.col("tile_y") + 1) * side > F.col("lower")).join(limits, framed["page_id"].eqNullSafe(limits["of"])).drop("of")
    over = lower.mapInArrow(_columns_over(side), f"page_id {kind}, tile_x int, over array<long>").select("page_id", "tile_x", F.posexplode("over").alias("x", "n"))
    columns = over.groupBy("page_id", (F.col("tile_x") * side + F.col("x")).alias("x")).agg(F.sum("n").alias("n"))
    heights = pages.select(F.col("page_id").alias("of"), "height")
    bars = (columns.join(heights, columns["page_id"].eqNullSafe(heights["of"])).filter(F.col("n") > F.col("height") * 0.1)
            .groupBy(F.col("page_id").alias("bar_page")).agg(F.count(F.lit(1)).cast("int").alias("bars")))
    rows = sums.select("page_id", "width", "y", F.posexplode("rows").alias("at", "v")).groupBy("page_id", "width", (F.col("y") + F.col("at")).alias("y")).agg(F.sum("v").alias("v"))
    means = rows.groupBy(F.col("page_id").alias("row_page")).agg(F.array_sort(F.collect_list(F.struct("y", (F.col("v") / F.col("width")).alias("m")))).alias("rows"))
    runs = means.select("row_page", rules.longest_dark_run(F.transform("rows", lambda r: r["m"])).alias("run"))
    joined = (pages.join(bars, pages["page_id"].eqNullSafe(bars["bar_page"]), "left").join(runs, pages["page_id"].eqNullSafe(runs["row_page"]))
              .withColumn("bar", rules.bar_verdict(F.coalesce("bars", F.lit(0)), F.col("width"))).withColumn("band", rules.band_verdict(F.col("run"), F.col("height")))
              .withColumn("tone", rules.tone_verdict(F.col("brightness"), F.col("contrast"))))
    return joined.select("page_id", "variance", "density", "brightness", "contrast", "tone.issues", F.col("tone.level").alias("tone_level"), "sharpness",
                         rules.sharpness_level(F.col("sharpness")).alias("sharpness_level"), "bar.bars", "bar.has_barcode", F.col("bar.confidence").alias("barcode_conf"),
                         "band.longest_run", "band.has_stripe", F.col("band.confidence").alias("stripe_conf"))
