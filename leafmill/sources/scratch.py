"""Tables that a job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared too."""
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


#: Lets Spark drop the shuffle files of a job when the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, seen: Observation | None = None, *figures) -> DataFrame:
    """``df`` written once and read from there, so that later steps start from a table and a lost executor
    replays nothing before it. ``seen`` gets ``figures`` of the rows while they are written. Shuffle files
    behind the table are dropped; the table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/core/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.observe(seen, *figures) if seen else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # only a path that is there can be marked
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
