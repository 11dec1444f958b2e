import gzip
import hashlib
from glob import glob

import pytest

from leafmill.llm import warc

BIG = "".join(f"<p>line {i} é</p>\r\n\r\nWARC/1.1\r\n" for i in range(3000))
PAGES = [(1, "http://a.example/1", "<p>one</p>"), (2, None, None), (3, "http://a.example/3\nx", ""), (4, "u", "x" * 1000), (5, "v", "x" * 1000), (6, "w", "x" * 1000),
         (7, "s", "y" * 999), (8, "s", "y" * 999), (9, "big", BIG), (10, "big", BIG + "!"), (11, "http://é.example/", "no line end 中" * 400), (12, "t", "\n"), (None, "n", "z" * 2000), (13, "n", "z" * 2000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x", "y") for p in PAGES], "page_id long, url string, html string, id long, sha1 string, chunk string")


def expected():
    out = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        top = max((k for k, _, h in PAGES if (h or "").encode() == data and k is not None), default=None)
        again = len(data) >= 1000 and key != top
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment,chunk", [(1 << 18, 1 << 18), (1000, 300), (777, 1 << 18), (5000, 5000)])
def test_round_trip(spark, pages, tmp_path, segment, chunk):
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages, path, segment=segment)
    chunks = warc.read_chunks(spark, path, chunk=chunk)
    assert sorted((tuple(r) for r in warc.index(chunks).collect()), key=repr) == expected()
    # Chunks in order are the payload, no chunk is larger than asked for, and digests follow.
    rows = sorted((r for r in chunks.collect() if r.record == "<urn:page:9>"), key=lambda r: r.chunk_no)
    assert b"".join(r.data for r in rows) == BIG.encode()
    assert all(len(r.data) <= chunk for r in rows) and len(rows) >= len(BIG.encode()) // chunk
    seen = b""
    for r in rows:
        seen += r.data
        assert (r.bytes_so_far, r.sha1_so_far) == (len(seen), hashlib.sha1(seen).hexdigest())


def test_archives_are_warc_records(pages, tmp_path):
    """A plain parser that goes by Content-Length alone finds one record per row, or per segment."""
    warc.write_archives(pages, f"file://{tmp_path}/archive", segment=4000)
    kinds, payloads = [], {}
    for name in glob(f"{tmp_path}/archive/*.gz"):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            body = data[end + 4:end + 4 + int(fields["Content-Length"])]
            at = end + 4 + len(body)
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
            kinds.append(fields["WARC-Type"])
            if fields["WARC-Type"] == "response":
                payloads[fields["WARC-Record-ID"]] = body.split(b"\r\n\r\n", 1)[1]
            elif fields["WARC-Type"] == "continuation":
                payloads[fields["WARC-Segment-Origin-ID"]] += body
    assert payloads["<urn:page:9>"] == BIG.encode() and payloads["<urn:page:2>"] == b""
    assert kinds.count("response") + kinds.count("revisit") == len(PAGES) and kinds.count("revisit") == 3


def test_empty_table(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.index(warc.read_chunks(spark, f"file://{tmp_path}/none")).count() == 0
