"""WARC archives whose whole file is one gzip stream, made into archives of one gzip member per record.

A monolithic stream can only be read from its start. The normaliser inflates each such file once, in one task that holds
one record at a time, writes every record as a member of its own, and notes file, offset and length of each in a sidecar
index; later readers seek to the records they want, and a large archive is read by many tasks.

Spark's text reader does the inflating (one row for each piece between version lines, so any Hadoop file system works);
pieces of a record whose payload holds a version line itself are put together by its Content-Length. Members are
written through pyarrow's file systems, under a name of the attempt until the file is whole, so a repeated task leaves
the same file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shuffle_parts

VERSION = "WARC/1."
END = b"\r\n\r\n"
LEVEL = 6
#: Payloads of fewer bytes are never told as revisits.
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of base 32 as the hexadecimal conversion writes them, and as digests do.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX = "file string, offset long, length long, record_id string, record_type string"


def _base32(sha1: Column) -> Column:
    """Upper-case base 32 of a hexadecimal SHA-1: ten digits are forty bits, eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(sha1, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every row; refers_to is null for responses.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest page_id are responses and the
    others refer to it. Rows without id refer to the group's smallest id, or are responses where it has none.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"sha1": F.sha1("payload"), "bytes": F.octet_length("payload")})
    keys = rows.select("page_id", "sha1", "bytes").filter(F.col("bytes") >= least_bytes)
    # The smallest ids are found before payloads move; groups of copies shrink to one row before the shuffle.
    firsts = cut(keys.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"))
    again = keys.join(firsts, ["sha1", "bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = cut(again.select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "first").distinct())
    own = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1"))
    return rows.join(again, own, "left").select("page_id", "url", "payload", _base32("sha1").alias("digest"), F.col("first").alias("refers_to"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _records(rows: DataFrame) -> Column:
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length("payload").cast("string")),
        F.lit("\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("payload")),
    )
    return F.concat(
        F.lit(f"{VERSION}0\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.lit(f"WARC-Date: {DATE}\r\nContent-Type: application/http; msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", _urn(F.col("refers_to"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_monolithic(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """One WARC record per row, each file one gzip stream. Null urls have no target line; line breaks in them are
    percent-encoded; null html is an empty payload; repeated rows each give a record."""
    rows = marked(pages, least_bytes)
    records = rows.select(_records(rows).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def _whole_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(file, fields, record with its end) from the pieces between version lines."""
    mark = VERSION.encode()
    file, parts, have, need, fields = None, [], 0, 0, None
    for path, piece in pieces:
        if path != file:
            if parts:
                raise ValueError(f"{file} ends within a record")
            file = path
            if piece:
                raise ValueError(f"{file} does not begin with a WARC record")
            continue  # before the first version line
        parts += [mark, piece]
        have += len(mark) + len(piece)
        if fields is None:
            whole = b"".join(parts)
            at = whole.find(END)
            if at < 0:
                continue  # a version line within the head
            parts, fields = [whole], _fields(whole[:at])
            if "content-length" not in fields:
                raise ValueError(f"{file}: a record without Content-Length")
            need = at + len(END) + int(fields["content-length"])
        if have >= need:
            yield file, fields, b"".join(parts)[:need] + END
            parts, have, fields = [], 0, None
    if parts:
        raise ValueError(f"{file} ends within a record")


def _member(record: bytes, level: int) -> bytes:
    # 31: with gzip header and trailer; the header holds no time, so equal records give equal members.
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrite each gzip file below ``source`` into ``target``/members and return its index, stored in ``target``/index.

    Records keep their order and bytes. No file gives an empty index. A file that ends within a record, or has one
    without Content-Length, is an error.
    """
    bounded_batches(spark, 100)
    pieces = (
        spark.read.option("lineSep", VERSION).text(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    )

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(f"{target}/members")
        where.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, file, name, offset, rows = None, None, None, 0, []

        def close():
            if out is not None:
                out.close()
                where.move(f"{root}/{name}.{attempt}", f"{root}/{name}")

        def packed():
            batch = pa.RecordBatch.from_pylist(rows, schema=schema)
            rows.clear()
            return batch

        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
        each = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for path, fields, record in _whole_records(each):
            if path != file:
                close()
                # The name tells the source file, also where folders hold files of one name.
                file, offset = path, 0
                name = f"{path.rsplit('/', 1)[-1].removesuffix('.gz').removesuffix('.txt')}-{zlib.crc32(path.encode()):08x}.warc.gz"
                out = where.open_output_stream(f"{root}/{name}.{attempt}")
            member = _member(record, level)
            out.write(member)
            rows.append({"file": name, "offset": offset, "length": len(member), "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type")})
            offset += len(member)
            if len(rows) == 1000:
                yield packed()
        close()
        yield packed()

    pieces.mapInArrow(run, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(spark: SparkSession, target: str, wanted: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the index rows in ``wanted`` (all by default).

    Each record is read at its offset alone. The payload of a response is measured and hashed again, and must agree with
    its head; a revisit has no payload, its head tells both.
    """
    index = spark.read.schema(INDEX).parquet(f"{target}/index") if wanted is None else wanted
    dealt = index.select("file", "offset", "length").repartitionByRange(shuffle_parts(spark), "file", "offset").sortWithinPartitions("file", "offset")

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    def run(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(f"{target}/members")
        name, stream = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if file != name:
                    name, stream = file, where.open_input_file(f"{root}/{file}")
                stream.seek(offset)
                record = zlib.decompress(stream.read(length), 31)
                at = record.index(END) + len(END)
                fields = _fields(record[: at - len(END)])
                http = record.index(END, at) + len(END)
                size = int(_fields(record[at : http - len(END)])["content-length"])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response":
                    payload = memoryview(record)[http : at + int(fields["content-length"])]
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{file} at {offset}: the payload is not that of its head")
                rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt.mapInArrow(run, READ)
