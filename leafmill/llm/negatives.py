"""Hard negatives: for each anchor and positive, the unlike rows that score next below it.

Every row has a code of one bit per coordinate of its rotation into a larger space. Beside
it stand its alignment (the product of row and code) and the length of what
the code leaves over. The product of an anchor with a code comes from popcounts over the bit planes of the
anchor's rotated coordinates. By Cauchy-Schwarz the left-over part can move the score by no
more than its length times that of the anchor across the code; so each row has an interval that holds its
score. Rows whose interval cannot reach the wanted range, or the best scores found so far, are dropped, and
the others are scored in integers. No row is lost: the bounds hold always, not only on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.llm.shared import saved
from leafmill.llm.vectors import as_binary, from_binary, is_sound, matrix, products, usual_length, whole_numbers

#: Bits of a code per component, bits of a rotated coordinate of an anchor, and the rotation's seed.
SPREAD, PLANES, SEED = 8, 6, 11
#: Rows and anchors that meet in one group.
ROWS, ANCHORS = 16_384, 4_096
#: Candidates that are scored first, by their estimates, to get a bound for the others.
TRIED = 64
_ROW = "row long, id long, label long, anchor boolean, numbers binary, code binary, align double, code_length double, rest double"


def rotation(width: int) -> np.ndarray:
    """Orthonormal columns that carry ``width`` components to a whole number of 64-bit words."""
    larger = -(-width * SPREAD // 64) * 64
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(larger, max(width, 1))))[0]


def encode(numbers: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: code words, alignment with the code, length of the code's image, length of the rest."""
    values = numbers.astype(np.float64)
    bits = values @ turn.T >= 0
    signs = np.where(bits, 1.0, -1.0) / np.sqrt(len(turn))
    image = signs @ turn
    align, size = (image * values).sum(axis=1), (image * image).sum(axis=1)
    rest = np.sqrt(np.maximum(0, (values * values).sum(axis=1) - align * align / np.maximum(size, 1e-12)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), align, np.sqrt(size), rest


class Codes:
    """Codes of a group's rows, and the score interval of each against an anchor."""

    def __init__(self, words: np.ndarray, align: np.ndarray, size: np.ndarray, rest: np.ndarray):
        self.words, self.rest, self.size = words, rest, np.maximum(size, 1e-6)
        self.factor, self.ones = align / self.size ** 2, np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    def interval(self, anchor: np.ndarray, turn: np.ndarray, rows: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the integer products of ``anchor`` with the rows."""
        spun = turn @ anchor
        step = max(np.abs(spun).max(initial=0), 1e-9) / (2 ** (PLANES - 1) - 1)
        level = np.rint(spun / step)
        off = np.linalg.norm(spun - step * level)
        shifted = (level + 2 ** (PLANES - 1)).astype(np.int64)
        words = self.words[rows]
        inside = -(2 ** (PLANES - 1)) * self.ones[rows]
        for plane in range(PLANES):
            mask = np.packbits(((shifted >> plane) & 1).astype(bool), bitorder="little").view(np.uint64)
            inside = inside + (np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64) << plane)
        along = step * (2 * inside - level.sum()) / np.sqrt(len(turn))  # anchor times code, off by no more than ``off``
        length = np.linalg.norm(anchor)
        least = np.maximum(0, np.abs(along) - off) / self.size[rows]
        across = np.sqrt(np.maximum(0, length ** 2 - np.minimum(least, length) ** 2))
        width = self.rest[rows] * across + np.abs(self.factor[rows]) * off
        slack = 1e-9 * (1 + length * (self.rest[rows] + np.abs(self.factor[rows]))) + 1e-6
        middle = self.factor[rows] * along
        return middle - width - slack, middle + width + slack


def _order(scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Higher scores first, then smaller ids; rows without an id come last."""
    return np.lexsort((ids, ~known, -scores))


def best(low: np.ndarray, high: np.ndarray, ranges: list[tuple[int, int]], n: int, score) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range, indices and scores of all rows in it that may be among its first ``n``.
    ``score(indices)`` gives exact scores; intervals decide which rows need one."""
    able = np.flatnonzero(np.logical_or.reduce([(high >= a) & (low <= b) for a, b in ranges]))
    first = able[np.argsort(-(low[able] + high[able]), kind="stable")[:max(TRIED, n)]]
    found = score(first)
    needed = np.zeros(len(low), bool)
    for a, b in ranges:
        inside = np.sort(found[(found >= a) & (found <= b)])
        needed |= (low <= b) & (high >= (inside[-n] if len(inside) >= n else a))
    needed[first] = False
    others = np.flatnonzero(needed)
    index, scores = np.concatenate([first, others]), np.concatenate([found, score(others)])
    return [(index[fits], scores[fits]) for a, b in ranges for fits in [(scores >= a) & (scores <= b)]]


def _split(table: pa.Table) -> tuple[dict, dict]:
    """Columns of the anchors and of the rows of a group, as numpy arrays."""
    table = table.combine_chunks()
    asks = table.column("asks").to_numpy().astype(bool)
    out = []
    for part in (table.filter(pa.array(asks)), table.filter(pa.array(~asks))):
        ids = part.column("id").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        one = {c: part.column(c).to_numpy() for c in ("row", "label", "align", "code_length", "rest")}
        one |= {"id": ids.fill_null(0).to_numpy(zero_copy_only=False), "known": ids.is_valid().to_numpy(zero_copy_only=False)}
        if part.num_rows:
            one |= {"numbers": from_binary(part.column("numbers"), np.int32), "words": from_binary(part.column("code"), np.uint64)}
        one["goals"] = part.column("goals").to_pylist() if "goals" in part.column_names else []
        out.append(one)
    return out[0], out[1]


def _search(turn: np.ndarray, alike: bool, n: int, ranges, names: list[str], kinds: list[pa.DataType]):
    """Group function: for each anchor and each of its ranges the first ``n`` rows with its label, or
    with others. ``ranges(goals)`` lists the score ranges of an anchor."""
    def run(table: pa.Table) -> pa.Table:
        asks, rows = _split(table)
        out: list[list] = [[] for _ in names]
        if len(asks["row"]) and len(rows["row"]):
            order = np.argsort(rows["label"], kind="stable")
            rows = {k: v[order] for k, v in rows.items() if k != "goals"}
            codes = Codes(rows["words"], rows["align"], rows["code_length"], rows["rest"])
            for k, anchor in enumerate(asks["numbers"]):
                goals = asks["goals"][k] if asks["goals"] else None
                wanted = ranges(goals)
                lo, hi = np.searchsorted(rows["label"], asks["label"][k]), np.searchsorted(rows["label"], asks["label"][k], side="right")
                if not wanted or (alike and lo == hi):
                    continue
                part = slice(lo, hi) if alike else slice(None)
                low, high = codes.interval(anchor.astype(np.float64), turn, part)
                if alike:
                    out_of = rows["row"][part] == asks["row"][k]
                else:
                    out_of = np.zeros(len(low), bool)
                    out_of[lo:hi] = True
                low[out_of], high[out_of] = np.inf, -np.inf
                start = lo if alike else 0
                for place, (index, scores) in enumerate(best(low, high, wanted, n, lambda at: products(rows["numbers"][at + start], anchor))):
                    index = index + start
                    top = _order(scores, rows["id"][index], rows["known"][index])[:n]
                    for i in top:
                        at = index[i]
                        found = {"at": int(asks["row"][k]), "anchor_id": int(asks["id"][k]) if asks["known"][k] else None, "id": int(rows["id"][at]) if rows["known"][at] else None,
                                 "score": int(scores[i]), "place": place, "positive_id": goals[place]["id"] if goals else None, "positive_score": goals[place]["score"] if goals else None}
                        for values, name in zip(out, names):
                            values.append(found[name])
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds)], names=names)
    return run


def _meet(asks: DataFrame, rows: DataFrame, tasks: int, n_rows: int, n_asks: int) -> DataFrame:
    """Anchors and rows dealt to groups (chunk, side) so that each pair of them meets in one group.
    There are enough chunks for all tasks, and none has more than about ``ROWS`` rows."""
    chunks = max(-(-n_rows // ROWS), min(tasks, -(-n_rows // 256)), 1)
    sides = max(-(-n_asks // ANCHORS), 1)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    one = lambda n, name: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)
    left = asks.select("*", F.lit(True).alias("asks"), one(sides, "side")).select("*", every(chunks, "chunk"))
    right = rows.select("*", F.lit(False).alias("asks"), one(chunks, "chunk")).select("*", every(sides, "side"))
    return left.unionByName(right, allowMissingColumns=True).repartition(max(tasks, min(chunks * sides, 16 * tasks)), "chunk", "side").groupBy("chunk", "side")


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """Per anchor, positive and negative: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchor`` tells which rows are anchors; all rows are searched for each. A score is the product of
    floor(scale * x) components; higher ones come first, then smaller keys, then rows without one. Positives are the
    first ``positives`` other rows of the anchor's label; negatives the first ``negatives`` rows of other labels
    that score from ``least`` to ``most`` percent of the positive. Keys and labels are integers.

    Rows with a NULL label, a NULL vector, a NULL component or one that is not finite take no part, and neither do
    vectors whose length is not the usual one. A component too large for exact sums in 64 bits ends the job with an
    error. Repeated rows are rows of their own: a copy of an anchor is an anchor and a positive too. Anchors without
    positives, and positives without negatives, give no rows; neither does an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("long").alias("label"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor")).filter(F.col("label").isNotNull() & is_sound("x"))
    width = usual_length(rows, "x")
    turn = spark.sparkContext.broadcast(rotation(width))  # SPREAD times the square of a vector's length

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = whole_numbers(matrix(batch, "x", width), scale, width)
            words, align, size, rest = encode(numbers, turn.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "anchor")), as_binary(numbers), as_binary(words), pa.array(align), pa.array(size), pa.array(rest)],
                                             [c.split()[0] for c in _ROW.split(", ")])

    kept = rows.filter(F.size("x") == width).withColumn("row", F.monotonically_increasing_id())
    coded = saved(kept.select("row", "id", "label", "anchor", "x").mapInArrow(code, _ROW), "codes")
    sizes = coded.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("anchor"), 1)).alias("asks")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, asks = coded.drop("anchor"), coded.filter("anchor").drop("anchor")

    def search(asked: DataFrame, alike: bool, n: int, ranges, output: str) -> DataFrame:
        names, kinds = zip(*[c.split() for c in output.split(", ")])
        types = [pa.int64() if k == "long" else pa.int32() for k in kinds]
        shared = turn
        return _meet(asked, rows, tasks, sizes["rows"], sizes["asks"]).applyInArrow(
            lambda table: _search(shared.value, alike, n, ranges, list(names), types)(table), output)

    def ranked(found: DataFrame, *groups: str, n: int) -> DataFrame:
        order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    everything = [(-2 ** 62, 2 ** 62)]
    likes = ranked(search(asks, True, positives, lambda goals: everything, "at long, id long, score long"), "at", n=positives)
    goals = likes.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("goals"))
    asked = saved(asks.join(goals, asks["row"] == goals["at"]).drop("at"), "anchors")

    def bounds(goals: list | None) -> list[tuple[int, int]]:
        return [(-(-least * g["score"] // 100), most * g["score"] // 100) for g in goals or []]

    output = "at long, place int, anchor_id long, positive_id long, positive_score long, id long, score long"
    unlike = ranked(search(asked, False, negatives, bounds, output), "at", "place", n=negatives)
    return unlike.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
