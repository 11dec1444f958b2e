"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from leafmill.sources.scratch import keep

#: Parts that the links of one node are dealt to before they meet.
PARTS = 64


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with ``low``, the smallest b of their a. One node may have a third of all links:
    each task sends one row of it, with the parts that it has, and the minimum goes back to each part."""
    links = links.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    least = (links.groupBy("a").agg(F.min("b").alias("low"), F.collect_set("part").alias("parts"))
             .select("a", "low", F.explode("parts").alias("part")))
    return links.join(least, ["a", "part"])


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014): larger neighbours move to a node's smallest
    neighbour, then a node and its smaller neighbours move to the smallest of them."""
    large = (_with_least(links.union(links.select("b", "a"))).filter("b > a")
             .select(F.col("b").alias("a"), F.least("a", "low").alias("b")))
    small = _with_least(large).select(F.explode(F.array(
        F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not the smallest of its component.

    ``links`` has two columns of one type without NULLs; repeated links, loops and either direction are fine. Each
    round is one job: its figures are taken while its links are written, and the rounds end when they stay the same.
    """
    links = keep(links.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    figures = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("mix"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("sum"))
    before = None
    while True:
        seen = Observation()
        links = keep(_round(links), "stars", seen, *figures)
        if seen.get == before:
            return links.toDF("node", "root")
        before = seen.get
