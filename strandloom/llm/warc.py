"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions over the archive's files, takes record-type and header
predicates from Spark, parses a record's headers first and inflates the payload
only of records that pass and whose payload is asked for. Each compressed record
is a gzip member whose extra field holds the member's length ("sl": compressed
and uncompressed bytes), so that a reader can step over the rest of a record;
members without it, and plain .warc files, are read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from .common import scratch_path, spread, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Column -> WARC header. All can be pushed down.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_records.json"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]+:/", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)


def _member(record: bytes, level: int) -> bytes:
    """One gzip member whose extra field tells its length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sH", 12, b"sl", 8)
    total = len(head) + 8 + len(body) + 8
    lengths = (total, len(record)) if max(total, len(record)) < 1 << 32 else (0, 0)
    return head + struct.pack("<II", *lengths) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def make_record(row: dict) -> bytes:
    """The bytes of one record; a revisit holds the HTTP head alone, with the full payload's length."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if row.get(column) is not None:
            value = _clean(row[column])
            lines.append(f"{name}: sha1:{value}" if column == "payload_digest" else f"{name}: {value}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Done(WriterCommitMessage):
    def __init__(self, file: str | None, size: int):
        self.file, self.size = file, size


class WarcWriter(DataSourceArrowWriter):
    """A file for each task; only files named in the manifest, written last, count."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 3))
        self.gz = options.get("compression", "gzip") != "none"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _open(self.path)
        name, size, out = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}", 0, None
        try:
            for batch in iterator:
                columns = batch.schema.names
                for k in range(batch.num_rows):
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    record = make_record({c: batch.column(c)[k].as_py() for c in columns})
                    data = _member(record, self.level) if self.gz else record
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Done(name if out is not None else None, size)

    def commit(self, messages) -> None:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps([[m.file, m.size] for m in messages if m is not None and m.file]).encode())

    def abort(self, messages) -> None:
        fs, path = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{path}/{m.file}")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partition_bytes", 16 << 20))
        self.skip = options.get("damaged", "raise").lower() == "skip"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((column, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                files = [(f"{path}/{n}", s) for n, s in json.loads(f.read())]
        else:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
            files = [(x.path, x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.path)]
        out, held = [], 0
        for name, size in sorted(files, key=lambda x: -x[1]):
            if not out or held + size > self.target:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [_Files(x) for x in out] or [_Files([])]

    def passes(self, row: dict) -> bool:
        for column, kind, want in self.tests:
            have = row[column]
            if have is None or not (have == want if kind == "EqualTo" else have in want if kind == "In" else have.startswith(want)):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for name in partition.files:
            for row in self.records(fs, name):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, fs, name: str) -> Iterator[dict]:
        """The records of a file that pass. A record cut short, or bytes that are none, raise, or with `damaged` "skip" end the file there."""
        try:
            yield from self.whole_records(fs, name)
        except (Damaged, zlib.error) as e:
            if not self.skip:
                raise Damaged(f"{name}: {e}") from None

    def whole_records(self, fs, name: str) -> Iterator[dict]:
        with fs.open_input_file(name) as f:
            end, at = f.size(), 0
            while at < end:
                source = _Gzip(f, at, end) if name.endswith(".gz") else _Plain(f, at)
                head = source.until(b"\r\n\r\n")
                if not head:
                    if not source.buf.strip(b"\r\n"):
                        break  # blank lines at the end
                    raise Damaged(f"the record at byte {at} ends within its headers")
                if not head.lstrip(b"\r\n").startswith(b"WARC/"):
                    raise Damaged(f"no record begins at byte {at}")
                lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
                row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
                if row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                length = int(fields.get("content-length", 0))
                if self.passes(row):
                    row |= self.block(source, length, fields)
                    yield row
                at = source.next(len(head) + length + 4)
                if at - 4 > end:
                    raise Damaged(f"a record of {length} bytes ends beyond the file")

    def block(self, source, length: int, fields: dict) -> dict:
        whole = fields.get("content-type", "").startswith("application/http")
        if not whole:
            return {"payload_bytes": length, "payload": source.exactly(length) if self.payload else None}
        http = source.until(b"\r\n\r\n")
        if not http or len(http) > length:
            raise Damaged("a block ends within its HTTP headers")
        size = next((int(m[1]) for m in [re.search(rb"(?im)^content-length:\s*(\d+)", http)] if m), length - len(http))
        held = fields.get("warc-type") != "revisit"
        if held:
            size = length - len(http)
        return {"payload_bytes": size, "payload": source.exactly(size) if self.payload and held else None}


class Damaged(ValueError):
    """An archive whose bytes are not whole records."""


class _Source:
    def exactly(self, n: int) -> bytes:
        data = self.take(n)
        if len(data) < n:
            raise Damaged(f"a payload of {n} bytes ends after {len(data)}")
        return data


class _Plain(_Source):
    def __init__(self, f, at: int):
        self.f, self.at, self.used, self.buf = f, at, 0, b""

    def more(self) -> bool:
        self.f.seek(self.at + self.used + len(self.buf))
        data = self.f.read(1 << 13)
        self.buf += data
        return bool(data)

    def until(self, mark: bytes) -> bytes:
        while (k := self.buf.find(mark)) < 0:
            if not self.more():
                return b""
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        if n > len(self.buf):
            self.f.seek(self.at + self.used + len(self.buf))
            self.buf += self.f.read(n - len(self.buf))
        out, self.buf = self.buf[:n], self.buf[n:]
        self.used += n
        return out

    def next(self, record: int) -> int:
        return self.at + record


class _Gzip(_Source):
    """One member; inflates no more than is asked for, a block at a time."""

    def __init__(self, f, at: int, end: int):
        self.f, self.at, self.buf, self.pos = f, at, b"", at
        f.seek(at)
        head = f.read(min(24, end - at))
        self.length = 0
        if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        self.z = zlib.decompressobj(31)

    def more(self, want: int = 1 << 13) -> bool:
        if self.z.eof:
            return False
        tail = self.z.unconsumed_tail
        if not tail:
            self.f.seek(self.pos)
            tail = self.f.read(1 << 12 if want <= 1 << 13 else 1 << 16)
            self.pos += len(tail)
            if not tail:
                if self.pos > self.at:
                    raise Damaged(f"the member at byte {self.at} is cut short")
                return False
        self.buf += self.z.decompress(tail, want)
        return True

    def until(self, mark: bytes) -> bytes:
        while (k := self.buf.find(mark)) < 0:
            if not self.more():
                return b""
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        parts, have = [self.buf], len(self.buf)
        while have < n:
            self.buf = b""
            if not self.more(1 << 16):
                break
            parts.append(self.buf)
            have += len(self.buf)
        data = b"".join(parts)
        self.buf = data[n:]
        return data[:n]

    def next(self, record: int) -> int:
        if self.length:
            return self.at + self.length
        while self.more(1 << 16):
            self.buf = b""
        return self.pos - len(self.z.unused_data)


class WarcDataSource(DataSource):
    """Format "warc". Options: path; reading: payload (false leaves payloads inflated by nobody), partition_bytes, damaged ("raise", or "skip" for the rest of a damaged file); writing: compression, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", salts: int | None = None) -> DataFrame:
    """WARC records, response or revisit, for (page_id, url, html) rows.

    Of rows with equal payloads of at least `least_bytes`, those of the largest
    page_id are responses and the others revisit it; a row without page_id revisits
    too, if another row has one. A null html is an empty payload. Only payload keys
    that repeat are joined back, salted (by default as often as the shuffle is wide),
    so a payload on a third of all rows is spread over all tasks.
    """
    salts = salts or spread(pages.sparkSession)
    rows = pages.select(
        "page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("_key", F.sha2("payload", 256)).withColumn(
        "_salt", F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(salts))
    )
    again = (
        rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null").select("_key", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    )
    met = rows.join(again, ["_key", "_salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    digest = F.udf(lambda hexed: base64.b32encode(bytes.fromhex(hexed)).decode(), "string", useArrow=True)
    return met.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri",
        F.lit(date).alias("warc_date"), F.when(revisit, name(F.col("first"))).alias("refers_to"), digest(F.sha1("payload")).alias("payload_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).options(**options).save()


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).options(**options).load()


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    check = F.udf(base32_sha1, "string", useArrow=True)
    return back.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), check(F.coalesce("payload", F.lit(b"")))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS x FROM pages
), f AS (SELECT x, max(page_id) AS first FROM p GROUP BY x),
d AS (
  SELECT page_id, n, x, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT)) AS v FROM p
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(v, lambda b: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((b >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (x)
"""
