"""Repeated passages: token windows that occur before.

Every window of ``size`` words gets a Rabin-Karp hash, hashes are counted in
Spark, and the windows that start earlier elsewhere merge into maximal removal
intervals per text.

Most windows occur once, and a row for each would be several times the input. So
each window is first known by its anchor, the smallest Rabin-Karp hash among the
shorter runs inside it, which depends on the window's words alone. Equal windows
have equal anchors, and neighbouring windows mostly share theirs, so about one
row in seven words finds all windows that can repeat, and only those are hashed
and counted in full. Texts with equal word sequences are taken as one: in all but
the first, every word goes that lies in a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.shared import KeyMap, saved, whole
from leafmill.llm.tokens import hashed_words, portions, rolling

KEY = "id {}, text_key long"


def _anchors(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the anchor of each ``size``-word window of ``words``."""
    short = max(1, (2 * size) // 5)
    runs, span = rolling(words, short), size - short + 1
    if len(runs) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(runs) - span + 1)
    return at, runs[at]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _summaries(size: int):
    """Per text: words, digest of its word sequence, SHA-256 of its words joined by blanks, and its anchors."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words, offsets = hashed_words(batch.column("text"), fold=False)
            at, hashes = _anchors(words, size)
            anchors, digests, plain = [], [], []
            for a, b, text in zip(offsets[:-1], offsets[1:], batch.column("text").to_pylist()):
                own = at[a:max(a, b - size + 1)]
                fresh = np.flatnonzero(np.diff(own, prepend=-1))
                anchors.append(hashes[a:max(a, b - size + 1)][fresh].view(np.int64))
                digests.append(_digest(words[a:b].tobytes()))
                plain.append(hashlib.sha256(b" ".join(text.encode().split())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()),
                 pa.array(plain, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                ["id", "text_key", "n_words", "digest", "plain_sha256", "anchors"])
    return scan


def _windows(size: int):
    """(key, start, hash) of the windows whose anchor is among the row's ``hits``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words, offsets = hashed_words(batch.column("text"), fold=False)
            full, (_, anchor) = rolling(words, size), _anchors(words, size)
            rows, starts, found = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                hits = batch.column("hits")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                own = np.flatnonzero(np.isin(anchor[a:b - size + 1], hits))
                rows.append(np.full(len(own), i))
                starts.append(own)
                found.append(full[a:b - size + 1][own])
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("text_key").take(rows), pa.array(np.concatenate(starts)),
                 pa.array(np.concatenate(found).view(np.int64))], ["id", "text_key", "start", "window"])
    return scan


def same(a: DataFrame, b: DataFrame) -> Column:
    """The join of two frames on key and text key; a NULL key meets a NULL key."""
    return a["id"].eqNullSafe(b["id"]) & (a["text_key"] == b["text_key"])


class Repeats:
    """What is repeated in ``docs``; see ``repeats``."""

    def __init__(self, texts: DataFrame, summary: DataFrame, copies: DataFrame, spans: DataFrame, size: int):
        self.texts, self.summary, self.copies, self.spans, self.size = texts, summary, copies, spans, size


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> Repeats:
    """Find the windows of ``size`` words whose words also start earlier: in a text with
    a smaller key (then a smaller hash of the text), or before in the same text.

    ``spans`` has (id, text_key, starts, ends): maximal intervals of words to remove,
    ends excluded, for the first of each class of equal word sequences; ``copies``
    has the others of ``size`` words or more, which go whole; ``texts`` the texts
    that may have spans. A NULL text has no words. Rows with the same key and text
    are judged alike and not against each other. Other columns are not read. An empty
    table gives empty tables. Windows are equal by one 64-bit hash and not compared word by word.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole(text)).alias("text_key"), whole(text).alias("text"))
    named = KEY.format(rows.schema["id"].dataType.simpleString())
    summary = saved(rows.mapInArrow(_summaries(size), f"{named}, n_words long, digest binary, plain_sha256 string, anchors array<long>"), "summaries")
    long_ones = summary.filter(F.col("n_words") >= size)
    firsts = long_ones.groupBy("digest").agg(F.min(F.struct("id", "text_key")).alias("first")).select("first.*")
    firsts = saved(firsts, "firsts")
    copies = saved(long_ones.join(firsts, same(long_ones, firsts), "left_anti").select("id", "text_key").distinct(), "copies")
    # The first of each class stay where they are; only what may be a copy is shuffled with its anchors.
    copied = KeyMap(copies, "id", "text_key")
    may = copied.inside(long_ones, "id", "text_key")
    anchors = (copied.outside(long_ones, "id", "text_key").union(may.join(copies, same(may, copies), "left_anti"))
               .select("id", "text_key", F.explode("anchors").alias("anchor")))
    again = saved(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    hits = saved(anchors.join(again, "anchor").groupBy("id", "text_key").agg(F.collect_set("anchor").alias("hits")), "hits")
    # Rows with the same key and text have one summary each; they count as one text here.
    may = KeyMap(hits, "id", "text_key").inside(rows, "id", "text_key")
    texts = saved(may.join(hits, same(may, hits)).select(may["id"], may["text_key"], "text", "hits"), "texts")
    windows = texts.mapInArrow(_windows(size), f"{named}, start long, window long")
    # Saved, so that both sides of the join are plain exchanges and Spark can split a frequent window.
    first_at = saved(windows.groupBy("window").agg(F.min(F.struct("id", "text_key", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("window", "first"), "windows")
    later = windows.join(first_at, "window").filter(F.struct("id", "text_key", "start") > F.col("first"))
    starts = later.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    # A run of overlapping windows is one interval: it begins where no window covers the word before, and ends where none goes on.
    gap = lambda s, other, n: F.coalesce(F.abs(F.get(F.col("at"), other) - s) > n, F.lit(True))
    begins = F.filter(F.col("at"), lambda s, i: gap(s, i - 1, size))
    ends = F.transform(F.filter(F.col("at"), lambda s, i: gap(s, i + 1, size)), lambda s: s + size)
    spans = saved(starts.withColumnRenamed("starts", "at").select("id", "text_key", begins.alias("starts"), ends.alias("ends")), "spans")
    return Repeats(texts, summary, copies, spans, size)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed words, and SHA-256 of the kept words joined by blanks."""
    for batch in portions(batches):
        removed, digests = [], []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
            words, at, kept = text.encode().split(), 0, []
            for a, b in zip(starts, ends):
                kept += words[at:a]
                at = b
            kept += words[at:]
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                         ["id", "text_key", "n_removed", "kept_sha256"])


def digests(found: Repeats, key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined by one blank)."""
    texts, spans = found.texts, found.spans
    cut = texts.dropDuplicates(["id", "text_key"]).join(spans, same(texts, spans)).select(texts["id"], texts["text_key"], "text", "starts", "ends")
    changed = cut.mapInArrow(_digests, KEY.format(texts.schema["id"].dataType.simpleString()) + ", n_removed long, kept_sha256 string")
    gone = found.copies.select("id", "text_key", F.lit(None).cast("long"), F.sha2(F.lit(""), 256))
    verdicts = saved(changed.union(gone), "removals")
    rows = found.summary.select("id", "text_key", "n_words", "plain_sha256")
    return rows.join(verdicts, same(rows, verdicts), "left").select(
        rows["id"].alias(key), "n_words",
        F.when(F.col("kept_sha256").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "plain_sha256").alias("kept_sha256"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words of its spans; the blanks around kept words stay as they were."""
    import re
    for batch in portions(batches):
        left = []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
            if starts:
                places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                at, parts = 0, []
                for a, b in zip(starts, ends):
                    parts.append(text[at:places[a][0]])
                    at = places[b][0] if b < len(places) else len(text)
                text = "".join(parts) + text[at:]
            left.append(text)
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n not in ("starts", "ends", "text")), pa.array(left, pa.string())],
                                         [*(n for n in batch.schema.names if n not in ("starts", "ends", "text")), "text"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """``docs`` without their repeated words, with all columns. Rows whose text is left without
    words by that go; texts without repeats, empty ones too, stay as they are."""
    found = repeats(docs, key, text, size)
    verdicts = saved(found.spans.select("id", "text_key", "starts", "ends")
                     .union(found.copies.select("id", "text_key", F.lit(None), F.lit(None))), "verdicts")
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
                        F.col(key).alias("id"), F.xxhash64(whole(text)).alias("text_key"), whole(text).alias("text"))
    marked = verdicts.withColumn("hit", F.lit(True))
    # Rows that surely have no verdict stay where they are.
    judged = KeyMap(verdicts, "id", "text_key")
    may = judged.inside(inner, "id", "text_key")
    joined = may.join(marked, same(may, marked), "left").filter("hit IS NULL OR starts IS NOT NULL")
    names = [f"c{i}" for i in range(len(docs.columns)) if docs.columns[i] != text]
    null_text = F.col(f"c{docs.columns.index(text)}").isNull().alias("null_text")
    cut = joined.select(*names, "text", "starts", "ends", null_text, F.col("starts").isNull().alias("uncut"))
    schema = ", ".join(f"{n} {dict(inner.dtypes)[n]}" for n in names) + ", null_text boolean, uncut boolean, text string"
    cut = cut.mapInArrow(_cut, schema).filter(F.col("uncut") | F.col("text").rlike(r"[^ \t-\r]"))
    done = judged.outside(inner, "id", "text_key").select(*names, null_text, "text").union(cut.select(*names, "null_text", "text"))
    return done.select(*[F.when(~F.col("null_text"), F.col("text")).alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
