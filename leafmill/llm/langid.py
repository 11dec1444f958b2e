"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes, its n-grams, the word itself and the lexicons it is in;
transitions between the languages of neighbouring words are learned with them. It is trained on sequences
spliced from spans of several documents, so that it sees changes of language. Forward-backward
gives each word a probability per language; a document's language is the one with the largest sum.

Texts of any length run side by side: they are cut into blocks of words, a block's product of
transition matrices is taken first, products are chained along each text, and the words inside follow from the values at
the edges of their block. The result is that of one pass over the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.classifier import held_out
from leafmill.llm.shared import whole
from leafmill.llm.tokens import mix, portions

#: Spans per language that the model is fitted on (expected number; a span is ``SPAN`` characters of whole words).
SAMPLE, SPAN = 4_000, 160
#: Words in a training sequence, in a block of a text, and entries of a language's lexicon.
SEQUENCE, BLOCK, LEXICON = 48, 64, 1_000
EPOCHS, BATCH, RATE, DECAY, SEED = 3, 256, 0.1, 1e-5, 5
UNKNOWN = "und"
#: Bytes of text that a task works on at a time. A longer text is handled alone.
PORTION = 2 << 20

# Kinds of features; each has its own hashes.
_WORD, _PREFIX, _SUFFIX, _GRAM = (np.uint64(k << 56) for k in range(1, 5))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@dataclass
class Words:
    """Distinct words as code points of their letters, lower-cased, on end."""

    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def spell(words: list[str]) -> Words:
    """Letters of the words; what is no letter is left out."""
    joined = "\n".join(words).lower() if words else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = points == 10
    owner = np.cumsum(edge)
    keep = _letters()[points] & ~edge
    sizes = np.bincount(owner[keep], minlength=len(words))[:len(words)] if len(words) else np.zeros(0, np.int64)
    return Words(points[keep].astype(np.uint64), np.cumsum(sizes) - sizes, sizes)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature hash) of all words that have letters."""
    base = np.uint64(0x100000001B3)
    own, hashes = [], []
    full = np.flatnonzero(words.sizes)

    def add(which: np.ndarray, value: np.ndarray, kind: np.uint64, size: int) -> None:
        own.append(which)
        hashes.append(mix(mix(value) ^ kind ^ np.uint64(size << 48)))

    starts, sizes, points = words.starts[full], words.sizes[full], words.points
    # Whole words: a sum over their letters and places.
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    total = np.add.reduceat(mix(points * base + place.astype(np.uint64)), starts) if len(full) else np.zeros(0, np.uint64)
    add(full, total, _WORD, 0)
    # Prefixes and suffixes of one to three letters.
    head, tail = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
    for k in range(1, 4):
        long = sizes >= k
        head[long] = head[long] * base + points[starts[long] + k - 1] + np.uint64(1)
        tail[long] = tail[long] * base + points[starts[long] + sizes[long] - k] + np.uint64(1)
        add(full[long], head[long], _PREFIX, k)
        add(full[long], tail[long], _SUFFIX, k)
    # N-grams of two and three letters anywhere.
    word = np.repeat(np.arange(len(words.sizes)), words.sizes)
    value = np.zeros(len(points), np.uint64)
    for k in range(1, 4):
        value = value[:len(points) - k + 1] * base + points[k - 1:] + np.uint64(1) if len(points) >= k else value[:0]
        inside = word[:len(value)] == word[k - 1:k - 1 + len(value)] if len(value) else np.zeros(0, bool)
        if k > 1:
            add(word[:len(value)][inside], value[inside], _GRAM, k)
    return np.concatenate(own), np.concatenate(hashes)


@dataclass
class Model:
    """Weights per known feature and language, per lexicon and language, and of starts and transitions."""

    languages: list[str]
    known: np.ndarray
    weights: np.ndarray
    listed: np.ndarray
    lists: np.ndarray
    lexicon: np.ndarray
    start: np.ndarray
    change: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Score of each word and language: the sum of its features' weights; a word without letters has none."""
        out = np.zeros((len(words.sizes), len(self.languages)))
        own, hashes = features(words)
        which, at = self.find(hashes)
        own = own[which]
        for k, column in enumerate(np.ascontiguousarray(self.weights.T)):
            out[:, k] = np.bincount(own, column[at], minlength=len(out))
        return out + self.in_lists(hashes[:np.count_nonzero(words.sizes)], np.flatnonzero(words.sizes), len(out)) @ self.lexicon

    def __post_init__(self):
        """Where the known hashes with the same leading bits begin; mostly there is one or none."""
        self.bits = np.uint64(64 - max(4, int(len(self.known) * 4).bit_length()))
        slots = np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64)
        self.first = np.searchsorted(self.known >> self.bits, slots).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are known, and their places in ``known``."""
        slot = (hashes >> self.bits).astype(np.int64)
        at = self.first[slot]
        left = np.flatnonzero(self.first[slot + 1] > at)
        at, upto = at[left], self.first[slot[left] + 1]
        out = []
        while len(left):
            hit = self.known[at] == hashes[left]
            out.append((left[hit], at[hit]))
            more = ~hit & (at + 1 < upto)
            left, at, upto = left[more], at[more] + 1, upto[more]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def in_lists(self, hashes: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """Per word a mark for each language whose lexicon has it."""
        marks = np.zeros((n, len(self.languages)))
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, hashes), len(self.listed) - 1)
            hit = self.listed[at] == hashes
            marks[which[hit]] = self.lists[at[hit]]
        return marks


def marginals(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, change: np.ndarray, block: int = 0) -> np.ndarray:
    """Probability of each label for each of the words on end (``scores``) of texts with ``sizes`` words, by
    forward-backward over blocks of ``block`` words. Blocks stand along the last axis of all arrays."""
    n, labels = scores.shape
    if not n:
        return scores
    block = block or max(BLOCK, 16 * labels)  # so that the products of all blocks take no more room than the scores
    psi = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-30).T
    first, move = np.exp(start - start.max()), np.exp(change - change.max())
    sizes = sizes[sizes > 0]
    per_text = -(-sizes // block)
    number = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.repeat(np.cumsum(sizes) - sizes, per_text) + number * block
    length = np.minimum(block, np.repeat(sizes, per_text) - number * block)
    # Longer blocks first, so that the blocks with a word at a step are always the first ones.
    rank = np.argsort(-length, kind="stable")
    begin, length, opens, place = begin[rank], length[rank], number[rank] == 0, np.argsort(rank, kind="stable")
    active = np.searchsorted(-length, -np.arange(block), side="left")  # blocks longer than the step
    steps = [psi[:, begin[:k] + j] for j, k in enumerate(active) if k]
    into = np.where(opens, first[None, :, None], move[:, :, None])

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.reshape(-1, x.shape[-1]).max(axis=0)

    product = scaled(into * steps[0])
    for j in range(1, len(steps)):
        k = active[j]
        product[:, :, :k] = scaled(np.matmul(move.T, product[:, :, :k]) * steps[j])
    # Values that enter each block from the left and from the right, along each text.
    edge = np.cumsum(per_text) - per_text
    enter, leave = np.ones((labels, len(begin))), np.ones((labels, len(begin)))
    order = np.argsort(-per_text, kind="stable")
    longest = per_text[order]
    for j in range(1, int(longest[0])):
        some = order[:np.searchsorted(-longest, -j, side="left")]
        before = edge[some] + j - 1
        enter[:, before + 1] = scaled(np.einsum("ib,ijb->jb", enter[:, before], product[:, :, place[before]]))
        after = edge[some] + per_text[some] - j
        leave[:, after - 1] = scaled(np.einsum("ijb,jb->ib", product[:, :, place[after]], leave[:, after]))
    value = scaled(np.einsum("ib,ijb->jb", enter[:, rank], into) * steps[0])
    forward = [value]
    for j in range(1, len(steps)):
        value = scaled((move.T @ value[:, :active[j]]) * steps[j])
        forward.append(value)
    value, out = leave[:, rank], np.empty((labels, n))
    for j in reversed(range(len(steps))):
        k = active[j]
        out[:, begin[:k] + j] = forward[j] * value[:, :k]
        value[:, :k] = scaled(move @ (steps[j] * value[:, :k]))
    return (out / out.sum(axis=0)).T


def _pairs(psi: np.ndarray, start: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of equally long sequences (sequence, step, label), and expected transitions in all."""
    n, steps, labels = psi.shape
    first, move = np.exp(start - start.max()), np.exp(change - change.max())
    ahead, behind = np.empty_like(psi), np.ones_like(psi)
    ahead[:, 0] = first * psi[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        ahead[:, t] = (ahead[:, t - 1] @ move) * psi[:, t]
        ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        behind[:, t] = (psi[:, t + 1] * behind[:, t + 1]) @ move.T
        behind[:, t] /= behind[:, t].sum(axis=1, keepdims=True)
    each = ahead * behind
    each /= each.sum(axis=2, keepdims=True)
    both = ahead[:, :-1, :, None] * move * (psi * behind)[:, 1:, None, :]
    both /= np.maximum(both.sum(axis=(2, 3), keepdims=True), 1e-300)
    return each, both.sum(axis=(0, 1))


def spliced(spans: list[tuple[int, list[str]]], draw: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Words and labels of all spans on end: spans in random order, often several of one language in a row."""
    by_language: dict[int, list[int]] = {}
    for k, (language, _) in enumerate(spans):
        by_language.setdefault(language, []).append(k)
    queues = {c: list(draw.permutation(v)) for c, v in by_language.items()}
    words, labels = [], []
    while queues:
        language = list(queues)[draw.integers(len(queues))]
        for _ in range(1 + draw.integers(4)):
            if queues[language]:
                span = spans[queues[language].pop()][1]
                cut = 1 + draw.integers(len(span)) if draw.random() < 0.3 else len(span)
                for part in (span[:cut], span[cut:]) if draw.random() < 0.5 else (span[cut:], span[:cut]):
                    words += part
                    labels += [language] * len(part)
        if not queues[language]:
            del queues[language]
    return words, np.array(labels, np.int64)


def fit(spans: list[tuple[str, str]], epochs: int = EPOCHS) -> Model | None:
    """The model fitted on (language, text) spans by adaptive gradient steps on the log likelihood. None without any."""
    languages = sorted({language for language, _ in spans})
    cut = [(languages.index(language), text.split()) for language, text in spans]
    cut = [(language, words) for language, words in cut if words]
    if not cut:
        return None
    draw = np.random.default_rng(SEED)
    words, labels = spliced(cut, draw)
    vocabulary, index = np.unique(np.array(words, object), return_inverse=True)
    spelt = spell(list(vocabulary))
    own, hashes = features(spelt)
    full = np.flatnonzero(spelt.sizes)
    n = len(languages)
    counts = np.zeros((len(vocabulary), n))
    np.add.at(counts, (index, labels), 1)
    listed, back = np.unique(hashes[:len(full)], return_inverse=True)
    per_list = np.zeros((len(listed), n))
    np.add.at(per_list, back, counts[full])
    lists = np.zeros(per_list.shape)
    for k in range(n):
        top = np.argsort(-per_list[:, k], kind="stable")[:LEXICON]
        lists[top[per_list[top, k] > 1], k] = 1
    used = lists.any(axis=1)
    weight_of = np.bincount(index, minlength=len(vocabulary))
    known, slot = np.unique(hashes, return_inverse=True)
    often = np.bincount(slot, weight_of[own]) > 1
    known, keep = known[often], often[slot]
    own, slot = own[keep], (np.cumsum(often) - 1)[slot[keep]]
    model = Model(languages, known, np.zeros((len(known), n)), listed[used], lists[used], np.zeros((n, n)), np.zeros(n), np.zeros((n, n)))
    marks = model.in_lists(hashes[:len(full)], full, len(vocabulary))
    bounds = np.searchsorted(own_sorted := own[order := np.argsort(own, kind="stable")], np.arange(len(vocabulary) + 1))
    slot = slot[order]
    steps = min(SEQUENCE, len(words))
    usable = len(words) // steps * steps
    index, labels = index[:usable].reshape(-1, steps), labels[:usable].reshape(-1, steps)
    seen = [np.full(w.shape, 1e-6) for w in (model.weights, model.lexicon, model.start, model.change)]
    for _ in range(epochs):
        order = draw.permutation(len(index))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            some, local = np.unique(index[part], return_inverse=True)
            local = local.reshape(len(part), steps)
            width = bounds[some + 1] - bounds[some]
            flat = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(bounds[some], width)
            holder, which = np.repeat(np.arange(len(some)), width), slot[flat]
            score = marks[some] @ model.lexicon
            for k in range(n):
                score[:, k] += np.bincount(holder, model.weights[which, k], minlength=len(some))
            chosen = score[local]
            psi = np.maximum(np.exp(chosen - chosen.max(axis=2, keepdims=True)), 1e-30)
            each, moves = _pairs(psi, model.start, model.change)
            gold = labels[part]
            each[np.arange(len(part))[:, None], np.arange(steps), gold] -= 1
            lead = each[:, 0].sum(axis=0)
            np.add.at(moves, (gold[:, :-1], gold[:, 1:]), -1)
            word_slope = np.stack([np.bincount(local.reshape(-1), each[:, :, k].reshape(-1), minlength=len(some)) for k in range(n)], axis=1)
            touched, where = np.unique(which, return_inverse=True)
            slope = np.stack([np.bincount(where, word_slope[holder, k], minlength=len(touched)) for k in range(n)], axis=1) / len(part) + DECAY * model.weights[touched]
            seen[0][touched] += slope * slope
            model.weights[touched] -= RATE * slope / np.sqrt(seen[0][touched])
            for value, past, step in ((model.lexicon, seen[1], marks[some].T @ word_slope), (model.start, seen[2], lead), (model.change, seen[3], moves)):
                step = step / len(part) + DECAY * value
                past += step * step
                value -= RATE * step / np.sqrt(past)
    return model


def sample_spans(known: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``sample`` spans per language, chosen evenly by hash from all spans of all ``known`` rows; equal rows
    count once. A span holds the whole words within ``SPAN`` characters, wherever they stand in the text."""
    rows = known.select(F.col(lang).cast("string").alias("lang"), whole(text).alias("text"), F.col(key).cast("string").alias("id"))
    rows = rows.withColumns({"pieces": F.ceil(F.octet_length("text") / SPAN).cast("int"), "hash": F.xxhash64("text")}).filter("pieces > 0")
    sizes = {r["lang"]: r["all"] for r in rows.groupBy("lang").agg(F.sum("pieces").alias("all")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for language, n in sizes.items() for x in (language, min(1.0, sample / n))])[F.col("lang")]

    def words(piece: Column) -> Column:
        """Whole words of a piece: those cut by its edges are left to none."""
        inner = F.substring("text", piece * SPAN + 1, F.lit(SPAN))
        inside = F.when(piece == 0, inner).otherwise(F.regexp_replace(inner, r"^\S*", ""))
        return F.when(F.char_length(inner) < SPAN, inside).otherwise(F.regexp_replace(inside, r"\S*$", ""))

    # Pieces are chosen by number first, so that a text is not copied for each of them.
    chosen = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1),
                      lambda piece: F.pmod(F.xxhash64("id", "hash", piece), F.lit(1 << 40)) / float(1 << 40) < F.col("share"))
    spread = rows.withColumn("share", share).withColumn("chosen", chosen).filter(F.size("chosen") > 0)
    spans = spread.select("lang", "hash", F.explode(F.transform("chosen", lambda piece: F.struct(piece.alias("piece"), words(piece).alias("words")))).alias("s"))
    found = spans.select("lang", "hash", "s.piece", "s.words").filter(F.col("words").rlike(r"\S")).dropDuplicates(["lang", "hash", "piece"])
    return [(r["lang"], r["words"]) for r in found.orderBy("hash", "piece", "lang").collect()]


def _read(texts: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a portion of texts: probabilities of all words on end, whether each has a letter, and words per text."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = spell(coded.dictionary.to_pylist())
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return marginals(model.scores(words)[index], sizes, model.start, model.change), (words.sizes > 0)[index], sizes


def identify(docs: DataFrame, known: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", runs: bool = False, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: key, ``lang_pred``, ``score``, and on request ``runs``, the text's maximal runs of words of
    one language as structs (lang, first_word, last_word).

    ``known`` tells which rows with a language may be learned from; language and key are no inputs of a prediction. Words are
    what stands between blanks; words without letters carry no evidence and take their language from their
    neighbours. ``score`` is the mean probability of the language over the words with letters. A NULL text, an
    empty one and one without letters get ``und`` and 0, and so do all without anything to learn from.
    Equal texts get equal answers; ties go to the language that sorts first. An empty table gives no rows.
    Spans for the fit, about ``sample`` per language, go to the driver; there must be few languages.
    """
    labelled = docs.filter(known & F.col(lang).isNotNull() & F.col(text).isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(fit(sample_spans(labelled, text, lang, key, sample)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in portions(batches, limit=PORTION):
            n = batch.num_rows
            if fitted is None:
                best, score, found = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            else:
                names = np.array(fitted.languages + [UNKNOWN], object)
                chance, lettered, sizes = _read(batch.column("text"), fitted)
                owner = np.repeat(np.arange(n), sizes)
                total = np.stack([np.bincount(owner[lettered], chance[lettered, k], minlength=n) for k in range(chance.shape[1])], axis=1)
                words = np.bincount(owner[lettered], minlength=n)
                top = total.argmax(axis=1)
                score = np.clip(total[np.arange(n), top] / np.maximum(words, 1), 0, 1)
                best = names[np.where(words > 0, top, len(fitted.languages))]
                found = _runs(chance.argmax(axis=1), owner, sizes, names) if runs else None
            columns = [batch.column("id"), pa.array(best, pa.string()), pa.array(score)]
            if runs:
                columns.append(pa.array(found, _RUNS))
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "runs"][:len(columns)])

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"))
    extra = ", runs array<struct<lang: string, first_word: int, last_word: int>>" if runs else ""
    found = rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double{extra}")
    return found.withColumnRenamed("id", key)


_RUNS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def _runs(label: np.ndarray, owner: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in sizes]
    if len(label):
        first = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])])
        begin = np.cumsum(sizes) - sizes
        for a, b in zip(first, np.r_[first[1:], len(label)]):
            out[owner[a]].append({"lang": names[label[a]], "first_word": int(a - begin[owner[a]]), "last_word": int(b - 1 - begin[owner[a]])})
    return out


def of_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``identify`` learned from the rows that are not held out: key, ``held_out``, ``lang_pred`` and ``score``.
    A row without a key is neither held out nor learned from."""
    found = identify(docs, ~held_out(key) & F.col(key).isNotNull(), key, text, lang)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
