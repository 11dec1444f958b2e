"""Registered queries of the training-data operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm import bpe, classifier, codes, exact, langid, licenses, near, negatives, packing, quality, substring, urls, warc
from leafmill.llm.shared import scratch
from leafmill.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if oracle:
            ORACLES[build.__name__] = oracle
        return build
    return register


@query()
def op3_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    """Weakly supervised quality rules over all documents."""
    return quality.judge(read_table(spark, path, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@query(oracle="""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
               FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    """All documents as the first batch of a digest index."""
    return exact.DigestIndex(spark).add(read_table(spark, path, "documents"))


#: The rules of the contract (host, path, action), and labels of hosts whose pages are listed one by one.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_LABELS = r"(^|\.)(cheap-pills|ads-track|spam-farm)\."


@query(oracle=f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM p),
    r(rh, rp, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
    b AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
          FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN regexp_matches(host, '{LISTED_LABELS}') THEN 'block' ELSE 'allow' END) AS verdict
    FROM b""")
def op9_url_filters(spark: SparkSession, path: str) -> DataFrame:
    """All pages against the rules, and against a list of the pages on known spam hosts."""
    pages = read_table(spark, path, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    listed = pages.filter(urls.host_of(F.col("url")).rlike(LISTED_LABELS)).select("url")
    return urls.judge(pages, rules, listed)


@query(oracle="""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS shingle
          FROM d, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS u(i)),
    n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id
          WHERE 100 * shared >= 85 * (a.n_shingles + b.n_shingles - shared)),
    r AS (WITH RECURSIVE walk(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM walk JOIN e ON x = node)
          SELECT node, min(root) AS component_id FROM walk GROUP BY node)
    SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents LEFT JOIN n USING (doc_id) JOIN r ON doc_id = node""")
def op10_minmax_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Components of near duplicates over all documents: three-word shingles, similarity 0.85."""
    return near.near_duplicates(read_table(spark, path, "documents"), size=3, percent=85).drop("text_key")


@query(oracle="""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 19)) AS u(i)),
    l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS no FROM s),
    c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM l WHERE no > 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id) AS n_removed,
           sha256(array_to_string(list_filter(w, lambda x, j: NOT list_contains(coalesce(g, []), j)), ' ')) AS kept_sha256
    FROM d LEFT JOIN (SELECT doc_id, list(pos) AS g FROM c GROUP BY doc_id) USING (doc_id)""")
def op2_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Removal of repeated 20-word windows over all documents."""
    return substring.digests(substring.repeats(read_table(spark, path, "documents"), size=20))


@query()
def op5_mixture_packing(spark: SparkSession, path: str) -> DataFrame:
    """All documents in sequences of 1,024 tokens, mixed by source."""
    return packing.pack(read_table(spark, path, "documents"))


@query()
def op6_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    """All documents encoded and decoded by the rank file."""
    return bpe.round_trip(read_table(spark, path, "documents"))


@query(oracle="""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to FROM t""")
def op7_warc(spark: SparkSession, path: str) -> DataFrame:
    """All pages written to archives and read back."""
    archives = scratch(spark, "archives")
    warc.write_archives(read_table(spark, path, "pages"), archives)
    return warc.index(warc.read_chunks(spark, archives, data=False)).drop("intact")


@query(oracle="""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    f(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
    b AS (SELECT doc_id, i - 1 AS place, label FROM w, unnest(generate_series(1, len(w))) AS u(i), f WHERE w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
    n AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM w),
    p(pattern, label) AS (VALUES
        (' licensed under the (terms of the )?gnu general public license (gpl )?version 3 ', 'gpl-3.0'),
        (' this( [^ ]+){1,4} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version( [^ ]+){1,2} of the license or at your option any later version ', 'gpl-notice'),
        (' (released|licensed) under the (terms of the )?mit license ', 'mit'),
        (' licensed under the (terms of the )?apache license (version )?2 0 ', 'apache-2.0'),
        (' licensed under (a )?(the )?cc by 4 0 ', 'cc-by-4.0'), (' licensed under (a )?(the )?cc by nc 4 0 ', 'cc-by-nc-4.0'), (' licensed under (a )?(the )?cc by sa 4 0 ', 'cc-by-sa-4.0'),
        (' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ', 'bsd')),
    m AS (SELECT doc_id, label FROM n, p WHERE regexp_matches(t, pattern)),
    a AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
    l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN doc_id IN (SELECT doc_id FROM m) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5 ELSE 0 END AS score
    FROM w LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)""")
def op1_license_scan(spark: SparkSession, path: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.scan(read_table(spark, path, "documents")).drop("matches")


@query()
def op8_quality_classifier(spark: SparkSession, path: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    return classifier.score(read_table(spark, path, "documents"), read_table(spark, path, "labels"))


def _code_rounds(rounds: int) -> str:
    """SQL of codebooks ``b0`` to the last, each round an assignment ``a`` and means ``u``. Sums of whole
    numbers below 2^53 are exact in doubles."""
    assign = """
    a{r} AS MATERIALIZED (SELECT x.vec_id, x.p, any_value(x.z) AS z, min({{'d': list_inner_product(x.z, x.z) - 2 * list_inner_product(x.z, b.z) + list_inner_product(b.z, b.z), 'e': b.e}}) AS best
          FROM x JOIN b{r} b ON x.p = b.p GROUP BY x.vec_id, x.p)"""
    update = """,
    u{r} AS (SELECT p, e, list(c ORDER BY i) AS z FROM (SELECT p, best.e AS e, i, floor(sum(z[i]) / count(*)) AS c
          FROM a{r}, unnest(generate_series(1, len(z))) AS s(i) GROUP BY ALL) GROUP BY p, e),
    b{n} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(u{r}.z, b{r}.z) AS z FROM b{r} LEFT JOIN u{r} USING (p, e)),"""
    return "".join(assign.format(r=r) + update.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds)


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query(oracle=f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z FROM embeddings WHERE {_SOUND}),
    x AS MATERIALIZED (SELECT vec_id, p, z[p * (len(z) // 4) + 1:(p + 1) * (len(z) // 4)] AS z FROM k, unnest(range(4)) AS s(p)),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, z FROM x QUALIFY e < 256),
    {_code_rounds(4)},
    h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
          FROM (SELECT p, e, i, z[i] AS c FROM b4, unnest(generate_series(1, len(z))) AS s(i))),
    r AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a4 GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h""")
def op12_vector_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes of all sound embeddings: four parts, 256 entries, four rounds."""
    return codes.compress(read_table(spark, path, "embeddings"))


@query(oracle=f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
               FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.z, b.z)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT p.anchor_id, p.other AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other))::INT AS rank,
           n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    QUALIFY rank <= 10""")
def op13_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all of them, with some labels moved on by one."""
    rows = read_table(spark, path, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


@query()
def op11_language_crf(spark: SparkSession, path: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return langid.of_documents(read_table(spark, path, "documents"))
