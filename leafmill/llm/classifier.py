"""Quality classifier on random-indexing word vectors.

Every word has a fixed sparse random index vector; its word vector is the sum of
the index vectors of the words around it, over the whole corpus. Words are hashed
to a fixed number of slots, so the vectors have one size whatever the corpus. A
text is the weighted mean of its words' vectors and a few shares of its surface.
A network of two layers in numpy scores it, and a temperature fitted on held-back
labelled texts turns scores into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.shared import saved, whole
from leafmill.llm.tokens import hashed_words, mix, portions

#: Slots that words are hashed to, size of a vector, marks per index vector, and words on each side.
SLOTS, WIDTH, MARKS, REACH = 1 << 14, 48, 4, 2
#: Labelled texts that the network is fitted on: those with the smallest hashes of their key, if there are more.
SAMPLE = 50_000
HIDDEN, BATCH, STEPS, RATE, DECAY, SEED = 32, 512, 1500, 0.01, 1e-4, 7

#: Patterns whose share of a text's characters or words is a feature.
_SHARES = [re.compile(p) for p in (r"[#*$%&|<>]", r"[A-Z]", r"[!?]", r"[0-9]", r"[.,]")]


def _index_vectors(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the marks of the index vectors of word slots."""
    seed = mix(slots.astype(np.uint64)[:, None] * np.uint64(MARKS) + np.arange(MARKS, dtype=np.uint64) + np.uint64(SEED))
    return (seed % np.uint64(WIDTH)).astype(np.int64), np.where(seed >> np.uint64(63), 1.0, -1.0)


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, offsets = hashed_words(texts, fold=True)
    return (words % np.uint64(SLOTS)).astype(np.int64), offsets


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and slot: the sum of the index vectors around its words, and its count."""
    places, signs = _index_vectors(np.arange(SLOTS))
    sums, counts = np.zeros((SLOTS, WIDTH)), np.zeros(SLOTS, np.int64)
    flat = sums.reshape(-1)
    for batch in portions(batches):
        slots, offsets = _slots(batch.column("text"))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        counts += np.bincount(slots, minlength=SLOTS)
        for step in range(1, REACH + 1):
            left, right = slots[:-step], slots[step:]
            near = text[:-step] == text[step:]
            pair, n = np.unique(left[near] * SLOTS + right[near], return_counts=True)
            for here, there in ((pair // SLOTS, pair % SLOTS), (pair % SLOTS, pair // SLOTS)):
                for m in range(MARKS):
                    flat += np.bincount(here * WIDTH + places[there, m], n * signs[there, m], minlength=SLOTS * WIDTH)
    used = np.flatnonzero(counts)
    for part in np.array_split(used, max(1, len(used) // 2048)):
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part]), pa.array(list(sums[part].astype(np.float32)), pa.list_(pa.float32()))],
                                             ["slot", "n", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all slots (zero for unused ones) from the whole corpus, weighted down for frequent words.
    A fixed size is sent to the driver: ``SLOTS`` rows of ``WIDTH`` numbers."""
    rows = docs.select(whole(text).alias("text"))
    per_task = rows.mapInArrow(_contexts, "slot long, n long, sums array<float>")
    total = per_task.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("double")).alias(f"v{i}") for i in range(WIDTH)]).toPandas()
    vectors = np.zeros((SLOTS, WIDTH), np.float32)
    if len(total):
        values = total[[f"v{i}" for i in range(WIDTH)]].to_numpy()
        share = total["n"].to_numpy() / total["n"].sum()
        unit = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
        vectors[total["slot"].to_numpy()] = unit * (1e-3 / (1e-3 + share))[:, None]
    return vectors


def features(docs: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and ``features``; a text without words has zeros. The vectors go to all tasks; their size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in portions(batches):
            slots, offsets = _slots(batch.column("text"))
            sizes, out = np.diff(offsets), np.zeros((batch.num_rows, WIDTH + len(_SHARES) + 4), np.float32)
            full = np.flatnonzero(sizes)
            if len(full):
                for d in range(WIDTH):
                    out[full, d] = np.add.reduceat(table[slots, d], offsets[full]) / sizes[full]
            text = np.repeat(np.arange(len(sizes)), sizes)
            chars = np.maximum(1, pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False))
            for i, pattern in enumerate(_SHARES):
                out[:, WIDTH + i] = pc.count_substring_regex(batch.column("text"), pattern.pattern).to_numpy(zero_copy_only=False) / chars
            pairs = pd.DataFrame({"t": text[1:], "p": slots[:-1] * SLOTS + slots[1:]})[text[1:] == text[:-1]] if len(text) > 1 else pd.DataFrame({"t": [], "p": []})
            fresh = np.bincount(pairs.drop_duplicates()["t"].astype(int), minlength=len(sizes))
            words = pd.DataFrame({"t": text, "w": slots}).drop_duplicates()["t"]
            out[:, -4] = np.log1p(sizes)
            out[:, -3] = fresh / np.maximum(1, sizes - 1)
            out[:, -2] = np.bincount(words.astype(int), minlength=len(sizes)) / np.maximum(1, sizes)
            out[:, -1] = chars / np.maximum(1, sizes) / 10
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out), pa.list_(pa.float32()))], ["id", "features"])

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(pool, f"id {rows.schema['id'].dataType.simpleString()}, features array<float>").withColumnRenamed("id", key)


class Network:
    """Two layers, fitted by Adam on the cross entropy, with a temperature for its scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        inputs = x.shape[1]
        self.layers = [draw.normal(0, inputs ** -0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        back = draw.random(len(x)) < 0.2
        if len(np.unique(y[~back])) == 2:
            self._fit(x[~back], y[~back], draw)
            if len(np.unique(y[back])) == 2:
                self._calibrate(x[back], y[back])
        else:  # one label or none: the same score for all
            self.layers[2][:], self.layers[3][:] = 0, 4 * (y.mean() - 0.5) if len(y) else 0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.layers[0] + self.layers[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.layers[2] + self.layers[3]

    def _fit(self, x: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> None:
        first, second = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers]
        steps = 0
        for _ in range(max(5, STEPS * BATCH // len(x))):
            order = draw.permutation(len(x))
            for k in range(0, len(x), BATCH):
                part = order[k:k + BATCH]
                h = self._hidden(x[part])
                error = 1 / (1 + np.exp(-(h @ self.layers[2] + self.layers[3]))) - y[part]
                back = np.outer(error, self.layers[2]) * (1 - h * h)
                slopes = [((x[part] - self.mean) / self.scale).T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True)]
                steps += 1
                for p, slope, a, b in zip(self.layers, slopes, first, second):
                    slope = slope / len(part) + DECAY * p
                    a += 0.1 * (slope - a)
                    b += 0.001 * (slope * slope - b)
                    p -= RATE * (a / (1 - 0.9 ** steps)) / (np.sqrt(b / (1 - 0.999 ** steps)) + 1e-8)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logit(x)
        tried = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def held_out(key: str) -> Column:
    """True for the fifth of the keys that no label is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(known: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Network:
    """The network fitted on the labelled rows of ``known`` (key, features) that are not held out: all
    of them, or the ``sample`` rows with the smallest hashes of their key. Rows without key or label are left out."""
    marked = labels.filter(~held_out(key) & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"))
    rows = known.join(marked, known[key] == marked["k"]).orderBy(F.xxhash64("k"), "k", "y").limit(sample).select("features", "y").toPandas()
    x = np.stack(rows["features"].to_list()).astype(float) if len(rows) else np.zeros((0, WIDTH + len(_SHARES) + 4))
    return Network(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: key, ``held_out``, ``score`` (probability of label 1) and ``predicted`` (score >= ``least``).

    Only the text is an input of the score; NULL and empty texts have one too, from zero features. Without
    labels all scores are 0.5. Repeated rows are scored alike. An empty table gives no rows.
    """
    known = saved(features(docs, word_vectors(docs, text), key, text), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(known, labels, key, label, sample))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.value.probability(x))], ["id", "score"])

    scored = known.select(F.col(key).alias("id"), "features").mapInArrow(judge, f"id {known.schema[key].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
