"""Running values over long ordered groups, without one task per group.

A plain window sends every row of a key to one task. Here a key is cut into
blocks that follow the order (an hour, ten thousand lines, a thousand pages).
Windows run inside (key, block); one small row per block carries the value in
from the blocks before it. A hot key is then spread over its blocks, at the
price of one more narrow read of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import NumericType

_MERGE = {
    "sum": lambda a, b: a + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
}
_AGG = {"sum": F.sum, "max": F.max}
_BLOCK = "__block"
#: Rows per key up to which Spark trims each task's rows before they are shuffled.
TOP_LIMIT = 1000

Step = Callable[[WindowSpec], Column]


class Ordered:
    """Rows grouped by ``keys`` and totally ordered by ``order`` within a key; NULL is a key.

    ``block`` must never fall along the order, and must be bounded in rows: take
    a finer one where a single key fills the default block.
    """

    def __init__(self, keys: list[str], order: list[str], block: Column):
        self.keys, self.order, self.block = keys, order, block
        # Two columns stand for each key, neither ever NULL, so that plain equality matches them.
        self.groups = [f"__{part}_{k}" for k in keys for part in ("value", "missing")]
        self.cells = self.groups + [_BLOCK]
        self.local = Window.partitionBy(*self.cells).orderBy(*order)
        self.upto = self.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.blocks = Window.partitionBy(*self.groups).orderBy(_BLOCK)
        self.earlier = self.blocks.rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, df: DataFrame, local: dict[str, Column], totals: dict[str, Column],
              before: dict[str, Column]) -> DataFrame:
        """Rows with ``local`` columns and the ``before`` columns of their block.

        ``local`` is computed row by row in a block, ``totals`` once per block,
        ``before`` over the blocks of a key; each may use the names before it.
        """
        inside = df.withColumns({_BLOCK: self.block, **self._stand_ins(df)})
        for name, value in local.items():
            inside = inside.withColumn(name, value)
        blocks = inside.groupBy(*self.cells).agg(*[v.alias(n) for n, v in totals.items()])
        for name, value in before.items():
            blocks = blocks.withColumn(name, value)
        side = blocks.select(*[F.col(c).alias(f"__key_{c}") for c in self.cells], *before)
        # Plain equality keeps the partitioning of the windows, so the rows are not
        # shuffled again for this join.
        match = reduce(lambda a, b: a & b, [inside[c] == side[f"__key_{c}"] for c in self.cells])
        return inside.join(side, match, "left").drop(*self.cells, *[f"__key_{c}" for c in self.cells])

    def _stand_ins(self, df: DataFrame) -> dict[str, Column]:
        kinds = {f.name: f.dataType for f in df.schema}
        found = {}
        for k in self.keys:
            number = isinstance(kinds[k], NumericType)
            value = F.coalesce(k, F.lit(0).cast(kinds[k])) if number else F.coalesce(F.col(k).cast("string"), F.lit(""))
            found |= {f"__value_{k}": value, f"__missing_{k}": F.col(k).isNull()}
        return found

    def running(self, df: DataFrame, how: str, **values: Column) -> DataFrame:
        """Add ``name = how(value)`` from the first row of the key to this row."""
        agg = _AGG[how]
        joined = self.carry(
            df,
            {n: agg(v).over(self.upto) for n, v in values.items()},
            {f"__total_{n}": agg(v) for n, v in values.items()},
            {f"__before_{n}": agg(f"__total_{n}").over(self.earlier) for n in values})
        return joined.withColumns(
            {n: _MERGE[how](F.col(n), F.col(f"__before_{n}")) for n in values}
        ).drop(*[f"__before_{n}" for n in values])

    def segments(self, df: DataFrame, values: list[str],
                 breaks: Callable[[Column, Column], Column]) -> DataFrame:
        """Cut each key where ``breaks(row, row before)`` holds, both given as
        structs of ``values``; the first row of a key always starts a segment.

        Adds ``prior`` (values of the row before), ``starts``, ``segment`` (from
        1 per key), ``position`` (from 1 per segment) and ``is_last`` (of the key).
        """
        def cut(row: Column, prior: Column) -> Column:
            return F.when(prior.isNull(), 1).otherwise(
                F.coalesce(breaks(row, prior), F.lit(False)).cast("int"))

        row, head = F.struct(*values), F.col("__head")
        first, last = F.min(F.struct(*self.order, *self._extra(values))), F.max(F.struct(*self.order, *self._extra(values)))

        def pick(edge: Column) -> Column:
            return F.when(edge.isNotNull(), F.struct(*[edge.getField(v).alias(v) for v in values]))

        joined = self.carry(
            df,
            {"__row": row,
             "__prior": F.lag("__row").over(self.local),
             "__no": F.row_number().over(self.local),
             "__cut": F.when(F.col("__no") == 1, 0).otherwise(cut(F.col("__row"), F.col("__prior"))),
             "__cuts": F.sum("__cut").over(self.upto),
             "__at": F.max(F.when(F.col("__cut") == 1, F.col("__no"))).over(self.upto)},
            {"__first": first, "__last": last, "__sum": F.sum("__cut"), "__rows": F.count(F.lit(1)),
             "__late": F.max(F.when(F.col("__cut") == 1, F.col("__no")))},
            {"__enter": pick(F.lag("__last").over(self.blocks)),
             "__head": cut(pick(F.col("__first")), F.col("__enter")),
             "__seen": F.coalesce(F.sum(F.col("__head") + F.col("__sum")).over(self.earlier), F.lit(0)),
             "__skip": F.coalesce(F.sum("__rows").over(self.earlier), F.lit(0)),
             "__all": F.sum("__rows").over(Window.partitionBy(*self.groups)),
             "__open": F.when(F.col("__head") == 1, F.col("__skip") + 1),
             "__from": F.max(F.greatest(F.col("__skip") + F.col("__late"), F.col("__open"))).over(self.earlier)})
        begin = F.coalesce(F.col("__skip") + F.col("__at"), F.col("__open"), F.col("__from"))
        top = F.col("__no") == 1
        return (joined
                .withColumn("prior", F.when(top, F.col("__enter")).otherwise(F.col("__prior")))
                .withColumn("starts", F.when(top, head).otherwise(F.col("__cut")) == 1)
                .withColumn("segment", F.col("__seen") + head + F.col("__cuts"))
                .withColumn("position", F.col("__skip") + F.col("__no") - begin + 1)
                .withColumn("is_last", F.col("__skip") + F.col("__no") == F.col("__all"))
                .drop(*[c for c in joined.columns if c.startswith("__")]))

    def _extra(self, values: list[str]) -> list[str]:
        return [v for v in values if v not in self.order]


def number_rows(df: DataFrame, name: str, ordered: Ordered) -> DataFrame:
    """Row numbers from 1 per key."""
    return ordered.running(df, "sum", **{name: F.lit(1)})


def top_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int,
             rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark trims each task to ``n`` rows per key
    before the shuffle, so a hot key does not gather in one task; it does so up to
    ``TOP_LIMIT`` rows, and more are refused."""
    if n > TOP_LIMIT:
        raise ValueError(f"at most {TOP_LIMIT} rows per key")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
