import base64
import glob
import gzip
import hashlib
import zlib

import pytest

from personagraph.llm import gzip_members as G
from personagraph.llm.common import scratch

ROWS = [
    (3, "http://a/", "<p>same</p>"),
    (1, "http://b/", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (4, "http://c/\r\nX: y", "WARC/1.0\r\nWARC-Type: response\r\n\r\nWARC/1.0\r\n é😀"),
    (5, "http://d/", None),
    (6, "http://e/", ""),
    (7, "http://f/", "WARC/1.\r\n\r\n\r\n\r\n"),
    (8, "http://g/", "x" * 300_000),
    (None, "http://h/", "<p>same</p>"),
    (None, "http://i/", "alone"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS bytes", "'x' AS payload", "2 AS first")


def told(row, rows):
    body = (row[2] or "").encode()
    ids = [r[0] for r in rows if (r[2] or "") == (row[2] or "") and r[0] is not None]
    first = min(ids, default=None)
    again = first is not None and row[0] != first
    return row[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None


def test_round_trip(spark):
    path = scratch(spark)
    G.write_monolithic(pages(spark).repartition(2), f"{path}/monolithic")
    index = G.normalise(spark, f"{path}/monolithic", path)
    got = [tuple(r) for r in G.read_records(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(str(told(r, ROWS)) for r in ROWS)
    local = path.removeprefix("file://")
    # Each archive holds the bytes of its monolithic file, and each indexed member one whole record of them.
    whole = sorted(gzip.open(f).read() for f in glob.glob(f"{local}/monolithic/*.gz"))
    members = glob.glob(f"{local}/members/*")
    assert sorted(gzip.open(f).read() for f in members) == whole
    ends = dict.fromkeys(members, 0)
    for r in sorted(index.collect(), key=lambda r: (r["file"], r["offset"])):
        file = f"{local}/members/{r['file']}"
        assert r["offset"] == ends[file]
        ends[file] += r["length"]
        record = zlib.decompress(open(file, "rb").read()[r["offset"] : ends[file]], 31)
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n")
    # Some records only.
    some = G.read_records(spark, path, index.filter("record_id = '<urn:page:8>'")).collect()
    assert [(r["page_id"], r["payload_bytes"]) for r in some] == [(8, 300_000)]


def test_small_payloads_are_responses(spark):
    path = scratch(spark)
    G.write_monolithic(pages(spark), f"{path}/monolithic", least_bytes=12)
    G.normalise(spark, f"{path}/monolithic", path)
    assert {r["record_type"] for r in G.read_records(spark, path).collect()} == {"response"}


def test_empty_table(spark):
    path = scratch(spark)
    G.write_monolithic(pages(spark, []), f"{path}/monolithic")
    G.normalise(spark, f"{path}/monolithic", path)
    assert G.read_records(spark, path).collect() == []


def test_cut_off_archive_is_an_error(spark, tmp_path):
    record = b"WARC/1.0\r\nContent-Length: 10\r\n\r\nshort"
    (tmp_path / "x.gz").write_bytes(gzip.compress(record))
    with pytest.raises(Exception, match="ends within a record"):
        G.normalise(spark, str(tmp_path), scratch(spark)).collect()
