"""Helpers of the training-data operators: shared scratch tables and text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but blanks and the control characters 9 to 13.
WORD = r"[^ \t-\r]+"
#: Parts that the rows of one key are dealt to before they meet.
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one in ``spark.checkpoint.dir``;
    where that is unset, a folder in the warehouse, which is shared as well."""
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


#: Lets Spark drop the shuffle files of a job when the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a table of the shared folder and read from there:
    its readers share it, and a lost executor replays nothing before it. The
    shuffle files behind it are not needed after that and are dropped."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold_case(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of one-byte characters take the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def whole(text: str | Column) -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


#: Bits of a map for each key, bits of one block of it (4 KB), and bits of a map at most (16 MB).
BITS_A_KEY, BLOCK_BITS, MOST_BITS = 16, 1 << 15, 1 << 27


class KeyMap:
    """Tells the rows that may have a key of ``keys`` from those that surely have none, where they stand.

    Each key sets the bit of its hash in a map that all executors get. Most rows without a key (15 of 16) find
    their bit unset, so that only the others need be shuffled to meet the keys themselves. A map has ``MOST_BITS``
    at most: with more keys than a quarter of that it tells fewer rows apart, and none wrongly.
    ``keys`` is best a table, as it is read twice.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        n, self.bits = keys.count(), BLOCK_BITS
        while self.bits < min(BITS_A_KEY * n, MOST_BITS):
            self.bits *= 2
        block, at = self._place(*columns)
        self.blocks = saved(keys.groupBy(block.alias("map_block")).agg(F.bitmap_construct_agg(at).alias("map_bits")), "key-map")

    def _place(self, *columns: Column | str) -> tuple[Column, Column]:
        """Block and place in it of the bit of a key."""
        slot = F.xxhash64(*columns).bitwiseAND(F.lit(self.bits - 1))
        return F.floor(slot / BLOCK_BITS), slot.bitwiseAND(F.lit(BLOCK_BITS - 1))

    def _met(self, rows: DataFrame, columns: tuple[Column | str, ...], how: str) -> DataFrame:
        block, at = self._place(*[rows[c] if isinstance(c, str) else c for c in columns])
        byte = F.conv(F.hex(F.substr("map_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        is_set = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
        return rows.join(F.broadcast(self.blocks), (block == F.col("map_block")) & is_set, how)

    def inside(self, rows: DataFrame, *columns: Column | str) -> DataFrame:
        """Every row with a key, and few others."""
        return self._met(rows, columns, "left_semi")

    def outside(self, rows: DataFrame, *columns: Column | str) -> DataFrame:
        """The rows that ``inside`` leaves out; none of them has a key."""
        return self._met(rows, columns, "left_anti")


def without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose key and text hash are not in ``gone`` (gone_id, gone_key), with all their columns. A NULL key
    meets a NULL key; rows with the same key and text share their verdict. Only the
    rows that may be in ``gone`` are shuffled to meet it; ``gone`` is best a table."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index
    rows = docs.toDF(*names)
    found, own = KeyMap(gone, "gone_id", "gone_key"), (names[place(key)], F.xxhash64(whole(names[place(text)])))
    may = found.inside(rows, *own)
    match = may[own[0]].eqNullSafe(gone["gone_id"]) & (own[1] == gone["gone_key"])
    return found.outside(rows, *own).union(may.join(gone, match, "left_anti")).toDF(*docs.columns)
