"""Byte-level BPE by rank files, with a segment tree for the merges.

A piece of text starts as one token per byte. A segment tree over the byte
positions holds in each leaf the rank of the pair that begins there (with its
position, so that the smallest value is the leftmost minimum) and in each node
the smaller of its children. The root names the next merge; a merge changes the
leaves of at most three live neighbours and the paths above them, so it costs a
logarithm of the length. Many pieces are merged side by side: each is a row of
one array, and every step merges the best pair of every row that has one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.shared import whole
from leafmill.llm.tokens import portions, units

NONE = np.int64(2 ** 62)
CACHED = 250_000
#: Leaves of all rows merged side by side; longer pieces are merged alone.
WIDTH = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bpe:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.ranks = read_ranks(path)
        self.pieces = regex.compile(pattern).findall
        self.cut_at_blanks = pattern == public_tokenizers.PATTERN
        spelled = sorted((r, t) for t, r in self.ranks.items())
        self.lengths, self.starts = np.zeros((2, spelled[-1][0] + 1), np.int64)
        self.lengths[[r for r, _ in spelled]] = [len(t) for _, t in spelled]
        self.starts[:] = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(t for _, t in spelled), np.uint8)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        self.byte_pairs = self._rank(self.byte.repeat(256), np.tile(self.byte, 256), np.zeros(1 << 16, np.int64))
        self.known: dict[str, list[int]] = {}    # by match of the pattern
        self.units: dict[str, bytes] = {}        # 32-bit ids by unit between blanks

    def _rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs: rank and position, or NONE."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place] << 32 | at, NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of pieces with at most ``leaves`` bytes, a power of two that holds the longest."""
        n, leaves = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        sizes = np.array([len(p) for p in pieces], np.int64)
        column = np.arange(leaves)
        alive = column < sizes[:, None]
        ids, data = np.zeros((2, n, leaves), np.int64)
        data[alive] = np.frombuffer(b"".join(pieces), np.uint8)
        ids[:] = self.byte[data]
        after = np.where(column + 1 < sizes[:, None], column + 1, leaves)   # next live token, or none
        before = np.broadcast_to(column - 1, (n, leaves)).copy()            # live token before, or -1
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        pairs = alive[:, :-1] & alive[:, 1:]
        rows, at = np.nonzero(pairs)
        tree[rows, leaves + at] = np.minimum(self.byte_pairs[data[rows, at] << 8 | data[rows, at + 1]] | at, NONE)
        span = leaves
        while span > 1:
            span >>= 1
            np.minimum(tree[:, 2 * span:4 * span:2], tree[:, 2 * span + 1:4 * span:2], out=tree[:, span:2 * span])

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = leaves + at
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at], alive[rows, gone], after[rows, at] = rank, False, follow
            update(rows, gone, np.full(len(rows), NONE))
            on = follow < leaves
            before[rows[on], follow[on]] = at[on]
            value = np.full(len(rows), NONE)
            value[on] = self._rank(rank[on], ids[rows[on], follow[on]], at[on])
            update(rows, at, value)
            prior = before[rows, at]
            has = prior >= 0
            if has.any():
                update(rows[has], prior[has], self._rank(ids[rows[has], prior[has]], rank[has], prior[has]))
            rows = rows[tree[rows, 1] < NONE]
        flat = ids[alive].tolist()
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set[str]) -> None:
        missing = pieces - self.known.keys()
        if len(self.known) + len(missing) > CACHED:
            self.known = {p: self.known[p] for p in pieces & self.known.keys()}
        by_size: dict[int, list[str]] = {}
        for p in missing:
            data = p.encode()
            if data in self.ranks:
                self.known[p] = [self.ranks[data]]
            else:
                by_size.setdefault((len(data) - 1).bit_length(), []).append(p)
        for bits, group in by_size.items():
            step = max(1, WIDTH >> bits)
            for k in range(0, len(group), step):
                part = group[k:k + step]
                self.known.update(zip(part, self.merge([p.encode() for p in part])))

    def _ids(self, pieces: list[str]) -> bytes:
        return np.array([i for p in pieces for i in self.known[p]], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Each match of the pattern is encoded on its own; no special tokens.
        What stands between blanks is encoded once and remembered."""
        cut = [units(t) if self.cut_at_blanks else None for t in texts]
        wanted = set().union(*(x for x in cut if x))
        new = {u: self.pieces(u) for u in wanted - self.units.keys()}
        odd = [self.pieces(t) for t, x in zip(texts, cut) if x is None]
        if len(self.units) + len(new) > CACHED:
            self.units = {u: self.units[u] for u in wanted & self.units.keys()}
        self._learn(set().union(*new.values(), *odd))
        self.units.update({u: self._ids(x) for u, x in new.items()})
        whole_texts = map(self._ids, odd)
        return [np.frombuffer(b"".join(map(self.units.__getitem__, x)) if x is not None else next(whole_texts), "<i4") for x in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.spelling[shift + np.arange(len(shift))].tobytes()


_MODELS: dict[tuple[str, str], Bpe] = {}


def model(path: str, pattern: str) -> Bpe:
    """The model of a rank file, one for each worker process."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = Bpe(path, pattern)
    return _MODELS[path, pattern]


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: key and ``ids``. A NULL or empty text has no ids. Other columns are not read."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(bpe.encode(batch.column("text").to_pylist())), pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", key)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one blank) and ``decoded_sha256``
    (bytes decoded from the ids). The ids stay in the worker that made them. A NULL text is empty and has no ids;
    repeated rows are encoded alike; other columns are not read; an empty table gives no rows."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        names = [str(i) for i in range(len(bpe.lengths))]
        for batch in portions(batches):
            ids = bpe.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(" ".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", key)
