"""Growing object stores: files are listed once, and what has expired is reported once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.pages import expired_objects
from leafmill.sources.ledger import Ledger, append_stream
from leafmill.sources.tables import object_name

LISTING = "path string, name string, length bigint, modificationTime timestamp"
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_objects(spark: SparkSession, path: str, glob: str = "*", content: bool = False, per_batch: int = 10_000) -> DataFrame:
    """New files below ``path`` as a stream (path, name, length, modificationTime, and bytes on request). The checkpoint of the
    query remembers what it has seen, so that a later run reads new files only; a file's bytes are read only if asked for."""
    files = (spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path))
    columns = ["path", object_name("path").alias("name"), "length", "modificationTime"]
    return files.select(*columns, *(["content"] if content else []))


def listing(spark: SparkSession, path: str) -> Ledger:
    """The table of files seen so far, by day of their time."""
    return Ledger(spark, path, LISTING, "modificationTime")


def list_new(spark: SparkSession, path: str, seen: Ledger, checkpoint: str, name: str = "files", glob: str = "*", **trigger) -> StreamingQuery:
    """Add the files that are new below ``path`` to ``seen``, each once."""
    return append_stream(stream_objects(spark, path, glob), seen, name, checkpoint, **trigger)


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose file, at that time, is not in ``right``."""
    other = right.select(F.col("path").alias("__path"), F.col("modificationTime").alias("__time"))
    return left.join(other, (left["path"] == other["__path"]) & left["modificationTime"].eqNullSafe(other["__time"]), "left_anti")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Difference of two listings: rows with ``change`` ``added`` or ``removed``. A file that was written again is both."""
    return (_apart(now, before).withColumn("change", F.lit("added"))
            .unionByName(_apart(before, now).withColumn("change", F.lit("removed"))))


def report_expired(objects: DataFrame, reported: Ledger, as_of: Column, batch: str, older_than_hours: int = 24) -> DataFrame:
    """Files past the cutoff that no earlier report named; they are stored in ``reported`` as ``batch``, and a batch
    that runs again stores nothing new. Deleting them is left to the caller."""
    columns = [f.name for f in reported.schema.fields]
    fresh = _apart(expired_objects(objects, as_of, older_than_hours), reported.read()).select(*columns)
    reported.append(fresh, batch)
    return reported.rows(reported.parts_of(batch)).select(*columns)
