"""Readers and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Folders that session results are spread over.
SESSION_FOLDERS = 256


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One parquet table of a data directory; filters and columns reach the scan."""
    return spark.read.parquet(os.path.join(path, f"{name}.parquet"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int,
              parts: int, **options: str) -> DataFrame:
    """A relational table read in ``parts`` key ranges, so no single task pulls it all."""
    return (spark.read.format("jdbc").options(**options)
            .option("url", url).option("dbtable", table)
            .option("partitionColumn", key).option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", parts).load())


def scan_objects(spark: SparkSession, path: str, glob: str = "*", content: bool = False) -> DataFrame:
    """Files below ``path``: path, name, length, modificationTime (and bytes on request)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    columns = ["path", object_name("path").alias("name"), "length", "modificationTime"]
    return files.select(*columns, *(["content"] if content else []))


def object_name(url: str | Column) -> Column:
    """File name of a URL or path: the last segment before any ``?``."""
    base = F.split_part(F.col(url) if isinstance(url, str) else url, F.lit("?"), F.lit(1))
    return F.element_at(F.split(base, "/"), -1)


def write_session_results(results: DataFrame, path: str) -> None:
    """JSON lines in a fixed number of folders that sessions are hashed to; the session
    stays a field. Rows are rebalanced by folder, so a folder gets one file per append
    unless it is too large for one task."""
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_FOLDERS))
    (results.withColumn("bucket", bucket).hint("rebalance", "bucket")
     .write.mode("append").partitionBy("bucket").json(path))


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The results of one session, from its folder alone."""
    bucket = F.pmod(F.xxhash64(F.lit(session_id)), F.lit(SESSION_FOLDERS))
    return spark.read.json(path).filter((F.col("bucket") == bucket) & (F.col("session_id") == session_id)).drop("bucket")


def append_executions(runs: DataFrame, path: str) -> None:
    """Append run-log rows, one folder per day, so later scans prune by date. Rows are
    rebalanced by day, so a day gets one file per append unless it is too large for one
    task. Of a repeated append both count; ``ledger.Ledger`` stores a batch once."""
    (runs.withColumn("day", F.to_date("created_at")).hint("rebalance", "day")
     .write.mode("append").partitionBy("day").parquet(path))


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """Write one string column as text lines."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
