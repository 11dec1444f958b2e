"""Mixture-controlled packing of documents into token sequences.

Sources are queues that are served a quantum at a time. A queue earns credit in
proportion to its target share and is served when its credit has grown to half a
quantum past what it got, so its deficit is carried from window to window and no
queue strays more than about a quantum from its share at any point. When a queue
is empty the others go on in their proportions. Served quanta follow each other
without gaps and are cut only at window ends, so all sequences but the last are full.

The place of a quantum in that order has a closed form: it is the number of
tokens that each queue gets before it. So after one count per queue every
document finds its own places; no step runs over the sequences one by one, and
deficits cross partitions without being passed along.
"""

from __future__ import annotations

import json
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from leafmill.llm.shared import saved, whole
from leafmill.llm.tokens import portions

LENGTH, QUANTUM = 1024, 128
#: Sources with a queue of their own; smaller ones share the last queue.
QUEUES = 255
#: Parts of a queue's order, and resolution of the shares.
PARTS, SHARES = 1024, 1 << 20
#: Units that a worker remembers since it last forgot some; it keeps as many of those before, if they are met again.
CACHED = 300_000
#: Letters that every version of Unicode of the last years knows as such come before this one.
LETTERS = "\u0530"

#: White space other than blanks and line ends, pairs of those, and the mark that texts are cut at.
_ODD = [*map(chr, [0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]), "  ", " \n", "\n ", "\n\n"]


def _is_odd(text: str) -> bool:
    """Whether a text has white space other than single blanks and line ends between other characters."""
    return text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _ODD)


class Units(dict):
    """Ids by unit. A new unit is encoded when it is asked for; ``before`` has the units of the time before.

    A unit of letters, with a blank before them or not, is one match of the pre-tokenizer, and goes to the
    merges of the model itself; marks behind it are a match of their own. Other units take the whole way.
    """

    def __init__(self, model, plain: bool):
        self.model, self.merges, self.plain = model, model.model, plain
        self.before: dict[str, bytes] = {}
        # Bytes as the characters that stand for them in the file: those that can be printed stand for themselves.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in seen]
        self.signs = "".join(chr(x) if x in seen else chr(256 + others.index(x)) for x in range(256))

    def __missing__(self, unit: str) -> bytes:
        ids = self.before.get(unit)
        if ids is None:
            ids = self._ids(unit)
        self[unit] = ids
        return ids

    def _ids(self, unit: str) -> bytes:
        bare = unit.rstrip(string.punctuation)
        word = bare[1:] if bare[:1] == " " else bare
        if not (self.plain and word.isalpha() and (word.isascii() or max(word) < LETTERS)):
            return pack_ids(self.model.encode_batch_fast([unit], add_special_tokens=False)[0].ids)
        if len(bare) < len(unit):
            return self[bare] + self[unit[len(bare):]]
        signs = bare.replace(" ", self.signs[32]) if bare.isascii() else bare.encode().decode("latin-1").translate(self.signs)
        return pack_ids([t.id for t in self.merges.tokenize(signs)])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class Encoder:
    """Ids of a byte-level BPE file for whole texts.

    A blank before a character that is no white space always begins a token, and a
    line end between such characters is one, so a text is cut there and each unit
    is encoded once and remembered. Texts with other white space are encoded as they are.
    With ``added`` the file's added tokens are found in texts, as the tokenizer does by
    default, and a text with one is encoded as it is; without, they are plain characters.
    """

    def __init__(self, path: str, added: bool = False):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not added
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()] if added else []
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        first = parts.get("pre_tokenizer") or {}
        plain = not parts.get("normalizer") and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        self.known = Units(self.model, plain)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text on its own."""
        return [pack_ids(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        out, known = [], self.known
        for text in texts:
            if _is_odd(text) or any(a in text for a in self.added):
                out += self._encode([text])
                continue
            if len(known) > CACHED:
                known.before = dict(known)
                known.clear()
            out.append(b"".join(map(known.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """The encoder of a file, one for each worker process."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added)
    return _ENCODERS[path, added]


def _tokenize(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, added=True)
        for batch in portions(batches):
            ids = [x + b"\0\0" for x in model.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), batch.column("source"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["id", "row", "source", "tokens", "ids"])
    return scan


class Schedule:
    """Places of the quanta of all queues: ``totals`` tokens and relative ``weights`` by queue."""

    def __init__(self, totals: list[int], weights: list[float]):
        self.totals = np.array(totals, np.int64)
        share = np.array(weights, float) / max(sum(weights), 1e-300)
        self.weights = np.maximum(1, np.round(share * SHARES)).astype(np.int64)

    def place(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """Tokens served before each (queue, quantum). A quantum i of queue q is due at (2i + 1) / weight;
        of quanta due together the one of the smaller queue goes first."""
        out = np.zeros(len(queue), np.int64)
        for other, (total, weight) in enumerate(zip(self.totals, self.weights)):
            due = (2 * quantum + 1) * weight
            before = (np.where(other < queue, due, due - 1) // self.weights[queue] + 1) // 2
            out += np.minimum(total, QUANTUM * np.where(other == queue, quantum, before))
        return out


def _pieces(schedule: Schedule, length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "ids"):
            queue, begin, tokens = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "begin", "tokens"))
            low, high = begin // QUANTUM, (begin + tokens - 1) // QUANTUM
            doc = np.repeat(np.arange(len(queue)), high - low + 1)
            quantum = np.arange(len(doc)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[doc]
            first = np.maximum(begin[doc], quantum * QUANTUM)
            last = np.minimum((begin + tokens)[doc], (quantum + 1) * QUANTUM)
            place = schedule.place(queue[doc], quantum) + first - quantum * QUANTUM
            start, size = first - begin[doc], last - first
            # A quantum over a window's end is cut there, and what lies side by side in one window is one piece.
            head = np.minimum(size, length - place % length)
            over = np.flatnonzero(head < size)
            doc, start, place, size = (np.concatenate(x) for x in (
                (doc, doc[over]), (start, start[over] + head[over]), (place, place[over] + head[over]), (head, (size - head)[over])))
            order = np.lexsort((start, doc))
            doc, start, place, size = doc[order], start[order], place[order], size[order]
            goes_on = np.zeros(len(doc), bool)
            goes_on[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + size[:-1]) & (place[1:] // length == place[:-1] // length)
            heads = np.flatnonzero(~goes_on)
            size = np.add.reduceat(size, heads) if len(heads) else size
            doc, start, place = doc[heads], start[heads], place[heads]
            wide = [np.frombuffer(x, "<u2").astype("<u4") for x in batch.column("ids").to_pylist()]
            crc = [zlib.crc32(wide[d][s:s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), *map(pa.array, (start, size)), pa.array(crc, pa.int64()),
                 *map(pa.array, (tokens[doc], place // length, place % length, queue[doc]))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])
    return scan


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None,
         path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all texts in sequences of ``length`` tokens.

    Each text gives its ids by the tokenizer file ``path`` (added tokens in a text have their own ids) and id 0; a NULL text is
    empty. ``targets`` has the wanted share of each source; by default it is the
    source's share of all tokens, so that all queues last to the end. A source
    without target gets its share of all tokens. A NULL source is a source. Columns: key, ``start``, ``length``,
    ``ids_crc32`` (unsigned 32-bit ids, little-endian), ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``queue``. Each id lies in one piece; offsets
    of a sequence have no gap; all sequences but the last are full. Repeated rows
    are packed each. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(source).cast("string").alias("source"), whole(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    tokens = saved(rows.mapInArrow(_tokenize(path or public_tokenizers.path("byte_bpe_50k.json")),
                                   f"id {id_type}, row long, source string, tokens long, ids binary"), "tokens")
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("n"))
    top = sums.orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(QUEUES).collect()
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    totals = [r["n"] for r in top]
    totals.append(total - sum(totals))
    weights = [(targets or {}).get(r["source"], r["n"] / total) for r in top] + [totals[-1] / max(total, 1)]
    queues = spark.createDataFrame([(r["source"], i) for i, r in enumerate(top)], "name string, queue int")
    queued = (tokens.join(F.broadcast(queues), tokens["source"].eqNullSafe(queues["name"]), "left")
              .select("id", "row", "tokens", "ids", F.coalesce("queue", F.lit(len(top))).alias("queue"),
                      F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int").alias("part")))
    parts = queued.groupBy("queue", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("queue", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (queued.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["queue", "part"])
              .select("id", "tokens", "ids", "queue", (F.col("base") + F.col("own")).alias("begin")))
    out = placed.mapInArrow(_pieces(Schedule(totals, weights), length),
                            f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue long")
    return out.withColumnRenamed("id", key)
