"""Compression of vectors to codes, one entry of a codebook per part.

Vectors become integers and are cut into equal parts. The parts at one position are
sorted along a Hilbert curve and kept as flat blocks with the bounds of their box and
their sums. In each round the distances from entries to a box leave a short list of
entries: an entry whose nearest corner is farther than another's farthest one can serve no
part in the block. A list of one takes the block as a whole, by its sums; the
rest is settled by an exact integer kernel over the list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.shared import salt, saved
from leafmill.llm.vectors import as_binary, batches_of, is_sound, matrix, products, usual_length, whole_numbers

#: Parts in a block, and positions of a part that the curve runs through.
BLOCK, AXES = 256, 16
_BLOCK_FIELDS = ["part", "rows", "values", "low", "high", "sums"]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points (a row each) with coordinates below 2^bits (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(x[i] & q, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(axes):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def _sorted_parts(kept: DataFrame, books: list[np.ndarray], width: int, scale: int) -> DataFrame:
    """(part, place, row, values) in the order of the curve. The curve's grid spans the starting entries."""
    parts, axes = len(books), min(width, AXES)
    bits = min(8, 62 // axes)
    grid = []
    for book in books:
        spread = book.std(axis=0) if len(book) else np.zeros(width)
        chosen = np.sort(np.argsort(-spread, kind="stable")[:axes])
        low = book[:, chosen].min(axis=0) if len(book) else np.zeros(axes)
        step = (book[:, chosen].max(axis=0) - low + 1) / 2 ** bits if len(book) else np.ones(axes)
        grid.append((chosen, low, step))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = whole_numbers(matrix(batch, "x", width * parts), scale, width)
            for part, (chosen, low, step) in enumerate(grid):
                values = numbers[:, part * width:(part + 1) * width]
                place = hilbert(np.clip((values[:, chosen] - low) / step, 0, 2 ** bits - 1), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), part, np.int32)), pa.array(place), batch.column("row"), as_binary(values)], ["part", "place", "row", "values"])

    rows = kept.select("row", "x").mapInArrow(cut, "part int, place long, row long, values binary")
    return rows.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")


def _as_blocks(width: int):
    """Rows in order to blocks of at most ``BLOCK`` parts of one position."""
    def block(part: int, rows: list, values: list) -> tuple:
        inside = np.frombuffer(b"".join(values), np.int32).reshape(-1, width)
        ends = (inside.min(axis=0)[None], inside.max(axis=0)[None], inside.sum(axis=0, dtype=np.int64)[None])
        return (pa.array([part], pa.int32()), as_binary(np.array(rows, np.int64)[None]), as_binary(inside.reshape(1, -1)), *map(as_binary, ends))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, rows, values = None, [], []
        for batch in batches:
            for part, row, value in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "values"))):
                if rows and (part != at or len(rows) == BLOCK):
                    yield block(at, rows, values)
                    rows, values = [], []
                at = part
                rows.append(row)
                values.append(value)
        if rows:
            yield block(at, rows, values)

    return lambda batches: batches_of(gather(batches), _BLOCK_FIELDS)


def short_list(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to some point of the box, ascending."""
    outside = np.maximum(np.maximum(low - book, book - high), 0)
    across = np.maximum(np.abs(book - low), np.abs(book - high))
    return np.flatnonzero((outside * outside).sum(axis=1) <= (across * across).sum(axis=1).min())


def _settled(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], errors: bool) -> Iterator[tuple]:
    """Per block: its part, the entry of each of its rows or one entry for all of them, its
    values, sums, row numbers, and on request the squared distances."""
    for batch in batches:
        for part, rows, values, low, high, sums in zip(*(batch.column(c).to_pylist() for c in _BLOCK_FIELDS)):
            book = books[part]
            low, high = (np.frombuffer(b, np.int32).astype(np.int64) for b in (low, high))
            inside = np.frombuffer(values, np.int32).reshape(-1, book.shape[1])
            listed = short_list(low, high, book)
            gap = None
            if len(listed) == 1:
                entry = int(listed[0])
                if errors:
                    away = inside - book[entry]
                    gap = (away * away).sum(axis=1)
            else:
                few = book[listed]
                cost = (few * few).sum(axis=1) - 2 * products(inside, few.T)
                best = cost.argmin(axis=1)
                entry = listed[best]
                if errors:
                    own = inside.astype(np.int64)
                    gap = (own * own).sum(axis=1) + cost[np.arange(len(best)), best]
            yield part, entry, inside, np.frombuffer(sums, np.int64), np.frombuffer(rows, np.int64), gap


def _totals(books: list[np.ndarray]):
    """Per task: counts and sums of the parts of each entry."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(book), np.int64) for book in books]
        totals = [np.zeros(book.shape, np.int64) for book in books]
        for part, entry, inside, sums, rows, _ in _settled(batches, books, errors=False):
            if isinstance(entry, int):
                counts[part][entry] += len(rows)
                totals[part][entry] += sums
            else:
                counts[part] += np.bincount(entry, minlength=len(counts[part]))
                np.add.at(totals[part], entry, inside)
        for part, (n, total) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"])
    return add


def _codes(books: list[np.ndarray]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, entry, _, _, rows, gap in _settled(batches, books, errors=True):
            n = len(rows)
            yield np.array(rows), np.full(n, part, np.int32), np.broadcast_to(np.int32(entry), n).copy() if isinstance(entry, int) else entry.astype(np.int32), gap

    return lambda batches: batches_of(assign(batches), ["row", "part", "entry", "error"])


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
             entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Per sound vector: key, ``code`` (hexadecimal entries in the order of the parts), ``error`` (squared
    distance to the code's entries), ``label_error`` (errors added over equal labels) and
    ``codebooks_sha256`` (of all components of the final entries, by part, entry and position).

    Vectors that are NULL or hold NULLs or components that are not finite are dropped, and so are those whose length is
    not the one that most vectors have, of lengths that ``parts`` divides. Components become floor(scale * x);
    one too large for exact sums in 64 bits ends the job with an error. Codebooks start from the smallest keys;
    rows with equal keys start it in the order of their vectors, and rows without a key are coded but start nothing.
    Repeated rows are coded one by one. NULL labels count as equal. Ties go to the lower entry; an entry without parts
    stays as it is. With fewer vectors than ``entries`` codebooks are shorter. An empty table gives no rows.

    Only codebooks (``entries`` rows of a vector's length) and their sums pass through the driver.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("label")).filter(is_sound("x"))
    length = usual_length(rows, "x", parts)
    width = max(1, length // parts)
    kept = saved(rows.filter(F.size("x") == length).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = kept.filter("id IS NOT NULL").orderBy("id", "x").limit(entries).select("x").collect()
    start = whole_numbers(np.array([r["x"] for r in first], np.float64).reshape(len(first), width * parts), scale, width).astype(np.int64)
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    if not len(start):
        kept = kept.limit(0)
    blocks = saved(_sorted_parts(kept, books, width, scale).mapInArrow(
        _as_blocks(width), "part int, rows binary, values binary, low binary, high binary, sums binary"), "blocks")
    for _ in range(rounds):
        added = blocks.mapInArrow(_totals(books), "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for r in added.collect():
            books[r["part"]][r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    digest = hashlib.sha256(",".join(str(c) for book in books for c in book.reshape(-1).tolist()).encode()).hexdigest()
    digits = max(2, len(f"{entries - 1:x}"))
    final = blocks.mapInArrow(_codes(books), "row long, part int, entry int, error long").groupBy("row").agg(
        *[F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)], F.sum("error").alias("error"))
    code = F.concat(*[F.lpad(F.lower(F.hex(f"e{p}")), digits, "0") for p in range(parts)])
    coded = saved(kept.select("row", "id", "label").join(final.select("row", code.alias("code"), "error"), "row"), "codes")
    # A label may have a third of all rows: its sum is taken by part and goes back to each part.
    coded = coded.withColumn("part", salt("row"))
    sums = (coded.groupBy("label", "part").agg(F.sum("error").alias("some"))
            .groupBy("label").agg(F.sum("some").alias("label_error"), F.collect_list("part").alias("parts"))
            .select(F.col("label").alias("of"), "label_error", F.explode("parts").alias("at")))
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]) & (coded["part"] == sums["at"]))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
