"""Address comparison jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmill.functions import normalize as rules


def address_edit_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Score pairs of addresses by edit distance, with match flags."""
    keyed = pairs.withColumn("key_a", rules.address_match_key(left)).withColumn(
        "key_b", rules.address_match_key(right))
    percent = F.round(rules.edit_similarity(F.col("key_a"), F.col("key_b")) * 100, 1)
    return (keyed.withColumn("edit_similarity_percent", percent)
            .withColumn("edit_match", F.col("edit_similarity_percent") >= rules.MATCH_PERCENT)
            .withColumn("edit_likely_match", F.col("edit_similarity_percent") >= rules.LIKELY_PERCENT))


def address_pairs(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Pair each seen address with the known address of the same record key.

    ``key`` must be unique in ``known``, so the output grows with ``seen``; the
    pairs inside a shared block are not all listed.
    """
    return seen.join(known, key)


def address_duplicates(addresses: DataFrame) -> DataFrame:
    """Records that share a match key, as (match_key, records, first_id, last_id).
    Copies are counted, not paired."""
    keyed = addresses.select("id", rules.address_match_key("address").alias("match_key"))
    return keyed.groupBy("match_key").agg(
        F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id")).filter("records > 1")
