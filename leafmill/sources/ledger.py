"""A table that is appended to in batches, each stored exactly once.

Rows of a batch are written to a folder of their own, which nobody reads yet. The batch counts when its manifest
appears: a small file, named after the batch, that lists the folders. Manifests are moved into
place and never replaced, so of two runs of a batch one counts. Readers follow the manifests; what a killed write
leaves behind is invisible. Small files are merged by day, in a manifest that replaces the folders it merged.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructType


@dataclass
class Folder:
    """The few file operations that a ledger needs, on any file system that Spark reaches."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        jvm = self.spark.sparkContext._jvm
        self.hadoop = jvm.org.apache.hadoop
        self.here = self.hadoop.fs.Path(self.path)
        self.conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.here.getFileSystem(self.conf)

    def names(self, at: str) -> list[str]:
        place = self.hadoop.fs.Path(self.here, at)
        return sorted(s.getPath().getName() for s in self.system.listStatus(place)) if self.system.exists(place) else []

    def exists(self, at: str) -> bool:
        return self.system.exists(self.hadoop.fs.Path(self.here, at))

    def read(self, at: str) -> dict:
        stream = self.system.open(self.hadoop.fs.Path(self.here, at))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, at: str, content: dict) -> bool:
        """A new file, whole or not at all; False where there is one of that name."""
        target, draft = self.hadoop.fs.Path(self.here, at), self.hadoop.fs.Path(self.here, f"drafts/{uuid.uuid4().hex}")
        stream = self.system.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        self.system.mkdirs(target.getParent())
        context = self.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        rename = self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Options.Rename, 1)
        rename[0] = self.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, rename)  # unlike a plain move, it fails where the target exists
        except Py4JJavaError:
            self.system.delete(draft, False)
            if self.system.exists(target):
                return False
            raise
        return True

    def drop(self, at: str) -> None:
        self.system.delete(self.hadoop.fs.Path(self.here, at), True)

    def replace(self, draft: str, at: str) -> None:
        """Move a folder into place as a whole, instead of the one that may be there."""
        target = self.hadoop.fs.Path(self.here, at)
        self.system.delete(target, True)
        self.system.mkdirs(target.getParent())
        if not self.system.rename(self.hadoop.fs.Path(self.here, draft), target):
            raise OSError(f"{draft} could not be moved to {at}")


class Ledger:
    """A table below ``path``, in one folder per batch and day."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, time: str = "created_at"):
        self.spark, self.path, self.time = spark, path.rstrip("/"), time
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.folder = Folder(spark, self.path)

    def _manifests(self) -> list[dict]:
        return [self.folder.read(f"log/{name}") for name in self.folder.names("log")]

    def has(self, batch: str) -> bool:
        return self.folder.exists(f"log/{batch}.json")

    def parts(self) -> list[str]:
        """Folders (batch/day) that count, in order."""
        listed, replaced = set(), set()
        for manifest in self._manifests():
            listed.update(manifest["parts"])
            replaced.update(manifest.get("replaces", []))
        return sorted(listed - replaced)

    def _stage(self, rows: DataFrame, name: str) -> list[str]:
        """The rows in a folder that no manifest names yet. They are rebalanced by day, so that a day gets one file, or more
        where it is too large for one task."""
        day = F.to_date(self.time)
        dealt = rows.select([f.name for f in self.schema.fields]).withColumn("day", day).hint("rebalance", "day")
        folder = f"batch={name}-{uuid.uuid4().hex}"
        dealt.write.partitionBy("day").parquet(f"{self.path}/data/{folder}")
        return [f"{folder}/{day}" for day in self.folder.names(f"data/{folder}") if day.startswith("day=")]

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Store a batch; False if a batch of that name is stored already, whatever its rows. A run that fails
        or is killed leaves nothing that readers see, and may be repeated."""
        if self.has(batch):
            return False
        parts = self._stage(rows, batch)
        return self.folder.put(f"log/{batch}.json", {"parts": parts})

    def read(self, days: tuple[str, str] | None = None) -> DataFrame:
        """All rows that count, with their ``day``; of ``days`` (first and last, ISO dates) alone if given, whose folders
        alone are listed then."""
        parts = self.parts()
        if days:
            parts = [p for p in parts if days[0] <= p.rpartition("=")[2] <= days[1]]
        return self.rows(parts)

    def parts_of(self, batch: str) -> list[str]:
        """Folders that a stored batch wrote."""
        return self.folder.read(f"log/{batch}.json")["parts"]

    def rows(self, parts: list[str]) -> DataFrame:
        """The rows of some folders, with their ``day``."""
        schema = StructType([*self.schema.fields]).add("day", DateType())
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{p}" for p in parts])
        return rows.select(*schema.fieldNames())

    def compact(self, least: int = 2) -> list[str]:
        """Merge the folders of each day that has ``least`` or more; the days merged. Of two runs at a time one
        counts for the same folders. Readers that began before keep theirs, for nothing is deleted."""
        by_day: dict[str, list[str]] = {}
        for part in self.parts():
            by_day.setdefault(part.split("/")[1], []).append(part)
        many = {day: parts for day, parts in by_day.items() if len(parts) >= least}
        if not many:
            return []
        old = sorted(p for parts in many.values() for p in parts)
        rows = self.rows(old)
        # The name follows from what is merged, so that a second merge of the same folders has the same one.
        name = "merged-" + uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(old)).hex
        parts = self._stage(rows, name)
        done = self.folder.put(f"log/{name}.json", {"parts": parts, "replaces": old})
        return sorted(day.removeprefix("day=") for day in many) if done else []

    def unused(self) -> list[str]:
        """Folders of batches that no manifest names, or only names as replaced; deleting them is left to the caller."""
        used = {p.split("/")[0] for p in self.parts()}
        return [name for name in self.folder.names("data") if name not in used]


def append_stream(stream: DataFrame, ledger: Ledger, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch once: its number names the batch, and a batch that runs again after a failure finds
    itself stored. ``name`` tells several streams into one ledger apart."""
    def store(batch: DataFrame, number: int) -> None:
        ledger.append(batch, f"{name}-{number:012d}")

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
