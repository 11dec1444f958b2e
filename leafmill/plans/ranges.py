"""Blocks of equal depth: ranges of (key, order) with about as many rows each, whatever the keys are.

A fixed span of time holds as many rows as a key happens to have in it. Here Spark samples the rows, sets
bounds along key and order, and each task takes one range; the range's number becomes a column of a table, so all
later reads share the same bounds. A key with a third of all rows is in a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.plans.ordered import TOP_LIMIT, top_rows
from leafmill.sources.scratch import keep

RANGE = "__range"


def in_ranges(df: DataFrame, keys: list[str], order: list[Column | str], ranges: int | None = None) -> DataFrame:
    """``df`` with the number of its range in ``__range``; numbers follow keys and order. There are as many ranges as shuffle
    partitions unless told otherwise. The rows are written once, so that bounds hold for every reader."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def blocks(df: DataFrame, keys: list[str], order: list[str], block: str, time: str = "ts") -> tuple[DataFrame, Column]:
    """Rows and the block they fall in: a span of ``time`` that ``date_trunc`` knows, or ``range`` for ranges of equal depth."""
    return (in_ranges(df, keys, order), F.col(RANGE)) if block == "range" else (df, F.date_trunc(block, time))


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank", ranges: int | None = None) -> DataFrame:
    """First ``n`` rows per key, for any ``n``, with their rank; NULL is a key. ``order`` must leave no ties.

    Up to ``TOP_LIMIT`` rows Spark trims each task's rows before they are shuffled. Beyond it rows are ranked within ranges, the
    sizes of a key's earlier ranges are added, and ranges past the ``n``-th row are not looked at. No task has more than a range.
    """
    if n <= TOP_LIMIT:
        return top_rows(df, keys, order, n, rank)
    dealt = in_ranges(df, keys, order, ranges)
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("__size"))
    needed = (sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).filter(F.col("__before") < n)
              .select(*[F.col(c).alias(f"__key_{c}") for c in [*keys, RANGE]], "__before"))
    same = F.col(RANGE) == F.col(f"__key_{RANGE}")
    for k in keys:
        same = same & dealt[k].eqNullSafe(needed[f"__key_{k}"])
    local = Window.partitionBy(*keys, RANGE).orderBy(*order)
    ranked = dealt.join(needed, same).withColumn(rank, (F.col("__before") + F.row_number().over(local)).cast("int"))
    return ranked.filter(F.col(rank) <= n).select(*df.columns, rank)
