"""Near duplicates by min-max hashing.

Every permutation of the shingle space gives a text two signature values, the
smallest and the largest hash of its shingles, so the hash evaluations are half
of those of plain MinHash. Bands of signature values name buckets; texts that
share a bucket are candidates. Links are confirmed on the full shingle sets.

Texts with the same shingle set form one class and are handled once. Candidate
clusters (classes joined by shared buckets) hold all links. A cluster within one
task's measure is searched at once, by walking from linked text to linked text
over an inverted index, so a large group of copies costs about one comparison a
text. A larger cluster is dealt to blocks that all hold a few common texts. Links
that this leaves out lie in buckets whose texts are still of several components:
there, texts outside the bucket's largest component meet all of its texts, in
pairs of parts that each fill a task's measure at most. So no link between two
components is lost, no group grows with the cluster, and pairs are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.graph import components
from leafmill.llm.shared import KeyMap, salt, saved, whole, without
from leafmill.llm.tokens import hashed_words, mix, portions, rolling

PERMUTATIONS = 96
#: Chance that a pair just at the threshold shares no band: one in a million at most.
MISS = 1e-6
#: Shingles that one task compares at a time, and texts that all blocks of a cluster hold.
BLOCK_SHINGLES, ANCHORS = 1 << 18, 48


def band_rows(threshold: float, values: int = 2 * PERMUTATIONS) -> int:
    """The longest bands that miss a pair at ``threshold`` with chance ``MISS`` at most."""
    fit = [r for r in range(1, 17) if (1 - threshold ** r) ** (values // r) <= MISS]
    return max(fit)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted. A text of fewer words is one shingle; without words it has none."""
    words, offsets = hashed_words(texts, fold=True)
    runs = rolling(words, size)
    short = lambda a, b: rolling(words[a:b], b - a)
    return [np.unique(runs[a:b - size + 1]) if b - a >= size else short(a, b) for a, b in zip(offsets[:-1], offsets[1:])]


def _signer(size: int, rows: int):
    draw = np.random.Generator(np.random.PCG64(20240229))
    odd = draw.integers(0, 2 ** 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2 ** 63, PERMUTATIONS, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = shingle_sets(batch.column("text"), size)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = [None] * len(sets)
            if len(full):
                flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                values = np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
                for p in range(PERMUTATIONS):
                    hashed = flat * odd[p]
                    hashed += add[p]
                    values[p] = np.minimum.reduceat(hashed, starts)
                    values[PERMUTATIONS + p] = np.maximum.reduceat(hashed, starts)
                bands = values[:len(values) // rows * rows].reshape(-1, rows, len(full))
                key = np.broadcast_to(np.arange(len(bands), dtype=np.uint64)[:, None], (len(bands), len(full))).copy()
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, r])
                for i, k in zip(full, key.T.view(np.int64)):
                    keys[i] = k
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "text_key", "n_shingles", "digest", "bands"])
    return sign


def linked_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of the first set of its component, where sets are linked at
    ``100 * intersection >= percent * union``. Walks from each set to the unvisited ones that
    it is linked to; the inverted index of the unvisited is rebuilt whenever they have halved."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes.astype(np.int64), np.cumsum(sizes)[:-1])
    group, open_ = np.full(n, -1, np.int64), np.ones(n, bool)
    left, built, post = n, 2 * n + 2, None
    for first in range(n):
        if not open_[first]:
            continue
        group[first], open_[first], left = first, False, left - 1
        queue = [first]
        while queue and left:
            if left * 2 < built:
                rows = np.flatnonzero(open_)
                flat = np.concatenate([codes[i] for i in rows])
                order = np.argsort(flat, kind="stable")
                post = np.repeat(rows, sizes[rows])[order]
                begin = np.searchsorted(flat[order], np.arange(len(names) + 1))
                built = left
            at = queue.pop()
            counts = begin[codes[at] + 1] - begin[codes[at]]
            take = np.repeat(begin[codes[at]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            shared = np.bincount(post[take], minlength=n)
            new = np.flatnonzero(open_ & (100 * shared >= percent * (sizes[at] + sizes - shared)) & (shared > 0))
            group[new], open_[new], left = first, False, left - len(new)
            queue += new.tolist()
    return group


def _linker(size: int, percent: int):
    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        digests = table.column("digest").to_pylist()
        distinct = {d: i for i, d in reversed(list(enumerate(digests)))}  # anchors may come twice
        rows = sorted(distinct.values())
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        group = linked_groups(shingle_sets(texts.take(pa.array(rows)), size), percent)
        pairs = [(digests[rows[i]], digests[rows[g]]) for i, g in enumerate(group) if i != g]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})
    return link


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    block: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: key, ``text_key``, ``n_shingles``, ``component_id``, the smallest key of
    its component, and ``kept``, true for the row with that key.

    A text's set holds its distinct shingles of ``size`` words after lower-casing
    A-Z; a text with fewer words is one shingle; without words (or NULL) it has
    none and is its own component. Texts are linked where
    ``100 * intersection >= percent * union``. A pair at the threshold shares no
    bucket, and is then not compared, with a chance of one in a million.
    Repeated rows are one component and have one verdict. Other columns are not read. ``text_key``
    tells rows with the same key apart.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole(text)).alias("text_key"), whole(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sets = saved(rows.mapInArrow(_signer(size, band_rows(percent / 100)),
                                 f"id {id_type}, text_key long, n_shingles long, digest binary, bands array<long>"), "shingles")
    classes = saved(sets.filter("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct("id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    member = classes.select("digest", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("digest").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    clusters = components(member.join(buckets, "bucket").filter("digest <> pivot").select("digest", "pivot").distinct())
    clusters = clusters.union(clusters.select("root", "root").distinct()).toDF("digest", "cluster")
    sized = clusters.join(classes.select("digest", "rep", "n_shingles"), "digest")
    # A cluster may be large: counted down per part first, and each part gets the totals.
    sized = sized.withColumn("part", salt("digest"))
    totals = (sized.groupBy("cluster", "part").agg(F.sum("n_shingles").alias("sum"), F.count(F.lit(1)).alias("n"))
              .groupBy("cluster").agg(F.ceil(F.sum("sum") / block).alias("blocks"), F.sum("n").alias("texts"), F.collect_set("part").alias("parts"))
              .select("cluster", "blocks", "texts", F.explode("parts").alias("part")))
    placed = saved(sized.join(totals, ["cluster", "part"]).drop("part"), "clusters")
    found = _texts(rows, placed)
    # Repeated rows bring their text again; the linker takes one of each digest.
    found = found.select("cluster", "digest", "blocks", "texts", "text")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks"))
    common = F.pmod(F.xxhash64("digest", F.lit("common")), F.col("texts")) < ANCHORS
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    spread = F.explode(F.when((F.col("blocks") > 1) & common, every).otherwise(F.array(own))).alias("block")
    link = lambda df, *names: df.groupBy(*names).applyInArrow(_linker(size, percent), "a binary, b binary")
    links = saved(link(found.select("cluster", spread, "digest", "text"), "cluster", "block"), "links")
    large = placed.filter("blocks > 1").select("cluster", "digest", "n_shingles")
    roots = components(links.join(large, links["a"] == large["digest"], "left_semi"))
    joined = large.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    # A cluster that is one component already has nothing left to link.
    several = joined.groupBy("cluster").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("cluster")
    unsettled = classes.select("digest", "bands").join(joined.join(several, "cluster", "left_semi"), "digest")
    meetings = saved(_meetings(unsettled.select("cluster", "digest", "n_shingles", "root", F.explode("bands").alias("bucket")), block), "meetings")
    # Kept as a table first: where few texts meet again, Spark knows so before it moves any text.
    wanted = saved(placed.select("digest", "rep").join(meetings, "digest"), "wanted")
    again = _texts(rows, wanted)
    joined_up = components(roots.union(link(again.select("bucket", "rest_part", "block", "digest", "text"), "bucket", "rest_part", "block")))
    # In a cluster of one block every link already leads to its component's first text.
    single = links.join(large, links["a"] == large["digest"], "left_anti").toDF("node", "root")
    return _named(sets, single.union(joined_up), key)


def _texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` with the texts of its ``rep``; other texts are not shuffled for that."""
    may = KeyMap(chosen, "rep.id", "rep.text_key").inside(rows, "id", "text_key")
    return may.join(chosen, may["id"].eqNullSafe(chosen["rep.id"]) & (may["text_key"] == chosen["rep.text_key"]))


def _meetings(member: DataFrame, block: int) -> DataFrame:
    """(bucket, rest_part, block, digest): groups of at most about two ``block`` shingles (or one text), in which
    every two texts meet that share a bucket and have different roots. ``member`` has bucket, digest, root, cluster
    and n_shingles. Small buckets of a cluster share a group, which then has a number from 0 as its bucket."""
    # A bucket may be large: counted down per root and per part first, and each part gets the totals.
    member = member.withColumn("part", salt("digest"))
    by_root = member.groupBy("cluster", "bucket", "root").agg(F.sum("n_shingles").alias("sum"), F.count(F.lit(1)).alias("n"))
    open_ = (by_root.groupBy("cluster", "bucket").agg(F.max(F.struct("n", "root", "sum")).alias("top"), F.sum("sum").alias("sum"), F.count(F.lit(1)).alias("roots"))
             .filter("roots > 1").select("cluster", "bucket", "sum", F.col("top.root").alias("top"), (F.col("sum") - F.col("top.sum")).alias("rest")))
    parts = member.select("bucket", "part").distinct().groupBy("bucket").agg(F.collect_set("part").alias("parts"))
    small = F.col("sum") * 8 <= block
    packs = (open_.filter(small).withColumn("part", salt("bucket")).groupBy("cluster", "part").agg(F.sum("sum").alias("sum"))
             .groupBy("cluster").agg(F.ceil(F.sum("sum") * 2 / block).alias("packs"), F.collect_set("part").alias("pack_parts"))
             .select("cluster", "packs", F.explode("pack_parts").alias("pack_part")))
    open_ = saved(open_.withColumn("pack_part", F.when(small, salt("bucket"))).join(packs, ["cluster", "pack_part"], "left").join(parts, "bucket")
                  .select("bucket", "sum", "rest", "top", "packs", F.explode("parts").alias("part")), "buckets")
    rows = member.join(open_, ["bucket", "part"])
    zero = F.lit(0).cast("long")
    dealt = lambda n, name: F.pmod(F.xxhash64("digest", F.lit(name)), n)
    blocks, rest_parts = F.ceil(F.col("sum") / block), F.ceil(F.col("rest") / block)
    to = lambda rest_part, at: F.struct(rest_part.alias("rest_part"), at.alias("block"))
    # All texts of a block visit every part of the rest, and a text of the rest every block with its part.
    as_member = F.transform(F.sequence(zero, rest_parts - 1), lambda i: to(i, dealt(blocks, "block")))
    as_rest = F.transform(F.sequence(zero, blocks - 1), lambda i: to(dealt(rest_parts, "rest"), i))
    own = rows.filter("packs IS NULL").select(
        "cluster", "bucket", "digest", F.inline(F.when(F.col("root") == F.col("top"), as_member).otherwise(F.array_distinct(F.concat(as_member, as_rest)))))
    packed = rows.filter("packs IS NOT NULL").select(
        "cluster", F.pmod(F.xxhash64("bucket"), F.col("packs")).alias("bucket"), "digest", F.lit(-1).cast("long").alias("rest_part"), zero.alias("block")).distinct()
    # A packed group is told apart by its cluster, an own one by its bucket.
    return own.union(packed).select(F.xxhash64("cluster", "bucket", "rest_part").alias("bucket"), "rest_part", "block", "digest")


def _named(sets: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Rows with the first row of their component. A set or component may be a third of all
    rows: rows are counted down per set before they meet, and verdicts go back per set and part."""
    rows = sets.select("id", "text_key", "n_shingles", "digest", salt("id", "text_key").alias("part"))
    smallest = rows.filter("n_shingles > 0").groupBy("digest", "part").agg(F.min(F.struct("id", "text_key")).alias("first"))
    parts = smallest.groupBy("digest").agg(F.min("first").alias("first"), F.collect_set("part").alias("parts"))
    parts = parts.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = parts.groupBy("root").agg(F.min("first").alias("first"))
    verdict = parts.drop("first").join(least, "root").select("digest", "first", F.explode("parts").alias("part"))
    own = F.struct("id", "text_key")
    first = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(own)
    return (rows.join(verdict, ["digest", "part"], "left")
            .select(F.col("id").alias(key), "text_key", "n_shingles", first["id"].alias("component_id"), first.eqNullSafe(own).alias("kept")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The first row of ``docs`` of each component, with all its columns: the one with the
    smallest key (then text hash). Texts without words stay."""
    gone = near_duplicates(docs, key, text, size, percent).filter(~F.col("kept")).select(F.col(key).alias("gone_id"), F.col("text_key").alias("gone_key"))
    return without(docs, saved(gone.distinct(), "gone"), key, text)
