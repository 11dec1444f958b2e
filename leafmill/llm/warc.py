"""WARC archives as chunked records.

A payload leaves the table as rows of record and chunk number. Each chunk becomes
one WARC record: the first a response, the others continuations of it, as the
format has it for segmented records. Archives are gzip text files of Spark's own
writer, so they can lie in any store, and since every record ends with a line end
they are read back line by line: a reader holds one line and one chunk at a time,
never a record, and carries the payload's digest from chunk to chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.shared import salt, saved, whole

#: Bytes of payload in a WARC record, and in a row of the reader.
SEGMENT = CHUNK = 1 << 18
#: Payloads below this size are always written in full.
LEAST_REVISIT = 1000
CRLF = "\r\n"


def _payload(html: str) -> Column:
    return F.encode(whole(html), "UTF-8")


def plan_records(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per row: id, payload digest (SHA-1) and bytes, and ``refers_to``: the largest key of the rows with the
    same payload, where that is another key and the payload has ``LEAST_REVISIT`` bytes or more; else NULL.
    ``revisit`` tells whether it is one. Payloads do not travel here."""
    facts = saved(pages.select(F.col(key).cast("long").alias("id"), F.sha1(_payload(html)).alias("sha1"),
                               F.octet_length(whole(html)).cast("long").alias("bytes")), "payloads")
    facts = facts.withColumn("part", salt("id"))
    # A payload may be a third of all rows: counted down per part, and answered per part.
    tops = (facts.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("sha1", "part").agg(F.max("id").alias("top"))
            .groupBy("sha1").agg(F.max("top").alias("top"), F.collect_set("part").alias("parts"))
            .select("sha1", "top", F.explode("parts").alias("part")))
    revisit = (F.col("bytes") >= LEAST_REVISIT) & ~F.col("id").eqNullSafe(F.col("top"))
    return (facts.join(tops, ["sha1", "part"], "left")
            .select("id", "sha1", "bytes", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))
            .distinct())


def payload_chunks(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", segment: int = SEGMENT) -> DataFrame:
    """Rows of (id, url, chunk_no, chunk) with the plan of their record; a revisit has one empty chunk.
    The chunks of a record follow each other in one partition."""
    rows = pages.select(F.col(key).cast("long").alias("page"), F.regexp_replace(whole(url), r"[\r\n]+", " ").alias("url"), _payload(html).alias("payload"))
    plan = plan_records(pages, key, html)
    joined = rows.withColumn("own", F.sha1("payload")).join(plan, rows["page"].eqNullSafe(plan["id"]) & (F.col("own") == plan["sha1"]))
    last = F.when(F.col("revisit"), 0).otherwise(F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / segment)))
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring("payload", (i * segment + 1).cast("int"), F.when(F.col("revisit"), 0).otherwise(segment)))
    return joined.select("id", "url", "sha1", "bytes", "revisit", "refers_to", last.alias("last_no"), F.posexplode(chunks).alias("chunk_no", "chunk"))


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", html: str = "html", url: str = "url",
                   segment: int = SEGMENT) -> None:
    """A WARC record per row of ``pages`` below ``path``. A NULL payload or URL is empty. Keys name the records: rows that share
    a key, or have none, share a record id, which readers then can't tell apart. An empty table gives no records."""
    chunks = payload_chunks(pages, key, html, url, segment)
    first, split = F.col("chunk_no") == 0, F.col("last_no") > 0

    def field(name: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
        return line if when is None else F.when(when, line).otherwise("")

    http = F.when(first, F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                                  F.col("bytes").cast("string"), F.lit(CRLF * 2))).otherwise("")
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    own = F.when(first, _name(F.col("id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", kind), field("WARC-Record-ID", own), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1"), first),
        field("WARC-Refers-To", _name(F.col("refers_to")), F.col("revisit")),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("revisit")),
        field("WARC-Segment-Number", F.col("chunk_no") + 1, split),
        field("WARC-Segment-Origin-ID", _name(F.col("id")), ~first),
        field("WARC-Segment-Total-Length", F.col("bytes"), split & (F.col("chunk_no") == F.col("last_no"))),
        field("Content-Type", F.lit("application/http;msgtype=response"), first),
        field("Content-Length", F.octet_length(http) + F.octet_length("chunk")), F.lit(CRLF))
    # The writer ends each row with a line end; with the one here a record has the two that it needs.
    body = F.concat(F.encode(F.concat(header, http), "UTF-8"), F.col("chunk"), F.lit(CRLF).cast("binary"))
    chunks.select(body.cast("string").alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


FIELDS = ["record", "url", "record_type", "refers_to", "chunk_no", "data", "bytes_so_far", "sha1_so_far", "last", "declared_bytes", "declared_sha1"]
SCHEMA = ("record string, url string, record_type string, refers_to string, chunk_no int, data binary, bytes_so_far long, "
          "sha1_so_far string, last boolean, declared_bytes long, declared_sha1 string")


class _Reader:
    """Takes the lines of whole archives one after another and gives rows of ``FIELDS``."""

    def __init__(self, chunk: int, data: bool):
        self.chunk, self.data = chunk, data
        self.take = self._outside
        self.fields: dict[str, str] = {}
        self.main: dict[str, str] = {}
        self.rows: list[tuple] = []

    def _outside(self, line: bytes) -> None:
        if line.startswith(b"WARC/"):
            self.fields, self.take = {}, self._header

    def _header(self, line: bytes) -> None:
        if line != b"\r":
            name, _, value = line.decode("utf-8", "replace").rstrip("\r").partition(": ")
            self.fields[name.lower()] = value
            return
        self.left = int(self.fields["content-length"])
        self.ends = "warc-segment-number" not in self.fields or "warc-segment-total-length" in self.fields
        if self.fields["warc-type"] == "continuation":
            self.take = self._body
        else:
            self.main, self.declared, self.take = self.fields, 0, self._http
            self.digest, self.held, self.size, self.total, self.number = hashlib.sha1(), [], 0, 0, 0
        if not self.left:
            self._close()

    def _http(self, line: bytes) -> None:
        self.left -= len(line) + 1
        if line[:16].lower() == b"content-length: ":
            self.declared = int(line[16:])
        elif line == b"\r":
            self.take = self._body
            if not self.left:
                self._close()

    def _body(self, line: bytes) -> None:
        part = line + b"\n"
        if len(part) >= self.left:
            part = part[:self.left]
        self.left -= len(part)
        while self.size + len(part) > self.chunk:  # full chunks go out at once
            cut = self.chunk - self.size
            self.held.append(part[:cut])
            part, self.size = part[cut:], self.chunk
            self._row(False)
        self.held.append(part)
        self.size += len(part)
        if not self.left:
            self._close()

    def _close(self) -> None:
        self.take = self._outside
        if self.ends:
            self._row(True)

    def _row(self, last: bool) -> None:
        data = b"".join(self.held)
        self.digest.update(data)
        self.total += len(data)
        self.rows.append((
            self.main["warc-record-id"], self.main.get("warc-target-uri", ""), self.main["warc-type"], self.main.get("warc-refers-to"), self.number,
            data if self.data else None, self.total, self.digest.hexdigest(), last, self.declared, self.main["warc-payload-digest"].removeprefix("sha1:")))
        self.held, self.size, self.number = [], 0, self.number + 1


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """Rows of (record, chunk_no) of the archives below ``path``, with the bytes and the digest of the payload so
    far; ``last`` marks the end of a payload. Without ``data`` the chunks themselves are left out. Archives without
    records give no rows."""
    arrow = pa.schema([("record", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int32()),
                       ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()),
                       ("declared_bytes", pa.int64()), ("declared_sha1", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = _Reader(chunk, data), 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                before = len(reader.rows)
                reader.take(line)
                held += sum(len(r[5] or b"") for r in reader.rows[before:])
                if held > 16 * CHUNK or len(reader.rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*reader.rows), arrow)], schema=arrow)
                    reader.rows, held = [], 0
        if reader.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*reader.rows), arrow)], schema=arrow)

    # A gzip file is never split, so a task reads whole archives.
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(scan, SCHEMA)


def _page(record: str) -> Column:
    return F.regexp_extract(record, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def index(chunks: DataFrame) -> DataFrame:
    """Per record of ``read_chunks``: page_id, payload_bytes, payload_digest, record_type, refers_to and ``intact``.
    A response's figures are those of the payload read; a revisit's are those that it declares."""
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("last").select(
        _page("record").alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_sha1")).otherwise(F.col("sha1_so_far")).alias("payload_digest"), "record_type",
        F.when(revisit, _page("refers_to")).alias("refers_to"),
        (revisit | ((F.col("sha1_so_far") == F.col("declared_sha1")) & (F.col("bytes_so_far") == F.col("declared_bytes")))).alias("intact"))
