"""Exact duplicates by a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest. A batch of documents
is reduced to one row per digest, sort-merged against the index, and the digests
that the index does not hold are appended. The index is never rewritten and its
side of the join is never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafmill.llm.shared import KeyMap, fold_case, salt, saved, scratch, whole
from leafmill.sources.ledger import Folder

COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"


class DigestIndex:
    """Digest index at ``path`` (one in the shared folder by default).

    A path that already holds an index is opened, so that it outlives the session.
    ``buckets`` is kept beside the index, and another number is refused; take about one per
    hundred million texts and per core. ``close`` drops the session's table of the index, not its data.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        layout = Folder(spark, f"{self.path}/_layout")
        if not layout.put("buckets.json", {"buckets": buckets}) and layout.read("buckets.json")["buckets"] != buckets:
            raise ValueError(f"the index at {self.path} has {layout.read('buckets.json')['buckets']} buckets, not {buckets}")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) "
                  f"SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        self.buckets = buckets

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Judge ``docs`` against the index and each other, and append what is new.

        Texts are equal if identical after lower-casing A-Z; a NULL text is empty.
        Of equal texts in a batch the row with the largest key stays (a NULL key
        loses to any other; of rows with the same key and text one stays), unless
        an earlier batch brought the text: then none stays.

        Returns one row per row of ``docs``: key, ``keep_id`` (of the row that
        stays, maybe of an earlier batch), ``group_size`` (rows of this batch with
        that text), ``kept`` and ``text_sha256``. Other columns are not read. An
        empty batch gives no rows and leaves the index as it is.

        A batch with a name may be run again after a failure, wherever it was killed: digests that
        an earlier run of it appended count as its own, and those that it did not reach are appended. The verdicts are those of
        one run. Without a name each call is a batch of its own.
        """
        rows = saved(docs.select(
            F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(fold_case(whole(text)), 256)).alias("digest")), "digests")
        rows = rows.withColumn("salt", salt("row"))
        # A text may be a third of all rows: counted per part first, and each part
        # gets its own copy of the verdict, so no task sees the whole group.
        groups = (rows.groupBy("digest", "salt")
                  .agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
                  .groupBy("digest")
                  .agg(F.max("top").alias("top"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")))
        batch = batch or uuid.uuid4().hex
        new = groups.join(self.table().hint("merge"), "digest", "left_anti")
        # Dealt by bucket first: one file a bucket and batch.
        (new.select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"),
                    F.lit(batch).alias("batch"))
         .repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.name))
        verdicts = (groups.select("digest", "top", "group_size", "salts").join(self.table().hint("merge"), "digest")
                    .withColumn("salt", F.explode("salts")))
        return (rows.join(verdicts, ["digest", "salt"])
                .select(F.col("id").alias(key), "keep_id", "group_size",
                        ((F.col("batch") == batch) & (F.col("row") == F.col("top.row"))).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``DigestIndex.add``.
    Of rows with the same key and text one stays. Only the rows that may go are shuffled to meet their verdicts."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    verdicts = index.add(docs, key, text)
    verdicts = saved(verdicts.select(F.col(key).alias("id"), F.unhex("text_sha256").alias("sha"), "kept"), "verdicts")
    rows = docs.toDF(*names)
    own, body = (rows[names[docs.columns.index(c)]] for c in (key, text))
    rows = rows.withColumns({"id": own.cast("long"), "sha": F.unhex(F.sha2(fold_case(whole(body)), 256))})
    # Of repeated rows all but one have a verdict to go, so that all of them are inside.
    going = KeyMap(verdicts.filter("NOT kept"), "id", "sha")
    # A NULL key meets a NULL key; the same columns in the join and the window, so that texts are dealt once.
    same = {"at": F.coalesce("id", F.lit(0)), "bare": F.col("id").isNull()}
    stay = going.inside(rows, "id", "sha").withColumns(same).join(verdicts.filter("kept").withColumns(same).select("at", "bare", "sha"), ["at", "bare", "sha"], "left_semi")
    again = Window.partitionBy("at", "bare", "sha").orderBy("sha")
    one = stay.withColumn("again", F.row_number().over(again)).filter("again = 1").select(*names)
    return going.outside(rows, "id", "sha").select(*names).union(one).toDF(*docs.columns)
