"""Words of whole Arrow columns as arrays of hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time. A longer text is handled alone.
PORTION = 1 << 20


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of text. All rows come, texts are never cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts on end, and the offset of each text in them.
    Words are runs of other than blanks and characters 9 to 13; ``fold`` lower-cases A-Z first. NULL has no words."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if fold else texts)
    values = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not len(values):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    coded = pc.dictionary_encode(values)
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    if not real.all():  # blanks at an edge leave an empty word
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        hashes = hashes[real]
    return hashes, offsets


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes (64-bit, mixed) of all runs of ``size`` values; runs may span texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k:k + n]
    return mix(out)


_BLANK_INSIDE = re.compile(r" (?:\s|\Z)")


def units(text: str) -> list[str] | None:
    """The text cut before its blanks, where patterns of the kind `` ?letters| ?digits| ?marks|\\s+(?!\\S)|\\s+``
    always begin a match: before a blank that a character other than white space follows. None if it has other blanks."""
    return text.replace(" ", "\0 ").split("\0") if not _BLANK_INSIDE.search(text) and "\0" not in text else None
