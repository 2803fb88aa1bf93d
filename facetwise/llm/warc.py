"""WARC archives as a Spark data source: spark.read.format("warc") and df.write.format("warc"), after register(spark).

Reading plans files into partitions on the driver. Predicates on headers (record type among them) are pushed into the
reader, which parses the headers of a record first and decodes its block only if the record is wanted and the schema asks
for the payload; otherwise it seeks past the block (plain files, and gzip files whose members state their length, as those
written here do) or inflates it without keeping it (other gzip files). Writing rolls files at a size and moves them into
place when all tasks are done.

A column stands for a header: its fixed name below, or else the header X-<name>, WARC-<name> or <name>, with dashes for
underscores. Paths go through pyarrow's file systems (local, hdfs, s3, gs), so executors and driver must both reach them.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from facetwise.llm.common import Scratch
from facetwise.llm.components import to_own

#: Headers of the WARC format by column.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "record_date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
    "block_digest": "WARC-Block-Digest", "concurrent_to": "WARC-Concurrent-To", "ip_address": "WARC-IP-Address", "profile": "WARC-Profile", "truncated": "WARC-Truncated", "filename": "WARC-Filename",
    "content_type": "Content-Type", "block_length": "Content-Length",
}
_IDS = {"record_id", "refers_to", "concurrent_to"}
#: Fixed value: the profile of records that repeat the payload of another.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, record_date string, target_uri string, refers_to string, payload_digest string, content_type string, block_length long, headers map<string,string>, payload binary"
#: Bytes of a file that is written, of the small files that share a partition, of a batch of rows, and of one read.
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, STEP = 64 << 20, 16 << 20, 8 << 20, 1 << 18
#: Bytes that are decoded at a time in search of the end of a record's headers.
HEAD_STEP = 1 << 11
#: Bytes of the headers of a record at most: beyond, the file is no archive.
HEAD_BYTES = 1 << 22


def register(spark: SparkSession) -> None:
    """Make format("warc") known to a session, with filters pushed into Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- reading ----


class _Plain:
    """Bytes of a file, in order, with seeks."""

    def __init__(self, f):
        self.f, self.buf = f, b""

    def fill(self, n: int = STEP) -> bool:
        more = self.f.read(max(n, STEP >> 4))
        self.buf += more
        return bool(more)

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self.fill():
            pass
        out, self.buf = self.buf[:n], self.buf[n:]
        return out

    def skip(self, n: int, head: int) -> None:
        """Past n bytes, the block of a record whose head had so many bytes."""
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        else:
            self.f.seek(n - len(self.buf), 1)
            self.buf = b""


class _Gzip(_Plain):
    """Bytes of a file of gzip members, with seeks where a member states its length (extra field `sl`)."""

    def __init__(self, f):
        super().__init__(f)
        self.raw, self.at, self.inflater = b"", 0, None  # at: where raw begins in the file
        self.member = None  # (where it ends, bytes it holds, bytes of the stream before it)
        self.made = 0

    def _more(self) -> bool:
        more = self.f.read(STEP)
        self.raw += more
        return bool(more)

    def _begin(self) -> bool:
        while len(self.raw) < 12 and self._more():
            pass
        if not self.raw.strip(b"\0"):
            return False
        if self.raw[:2] != b"\x1f\x8b":
            raise ValueError("no gzip member where one should begin")
        self.member = None
        if self.raw[3] & 4:
            size = struct.unpack("<H", self.raw[10:12])[0]
            while len(self.raw) < 12 + size and self._more():
                pass
            if self.raw[12:16] == b"sl\x08\x00":
                held, holds = struct.unpack("<II", self.raw[16:24])
                self.member = (self.at + held, holds, self.made)
        self.inflater = zlib.decompressobj(31)
        return True

    def fill(self, n: int = STEP) -> bool:
        if self.inflater is None and not self._begin():
            return False
        if not self.raw and not self._more():
            raise ValueError("the file ends inside a gzip member")
        before = len(self.raw)
        out = self.inflater.decompress(self.raw, n)
        self.raw = self.inflater.unconsumed_tail or self.inflater.unused_data
        self.at += before - len(self.raw)
        if self.inflater.eof:
            self.inflater = None
        self.buf += out
        self.made += len(out)
        return True

    def skip(self, n: int, head: int) -> None:
        here = self.made - len(self.buf)
        if n > len(self.buf) and self.inflater is not None and self.member and self.member[1] == head + n + 4 and here - head == self.member[2]:
            self.f.seek(self.member[0])
            self.raw, self.at, self.inflater, self.buf = b"", self.member[0], None, b""
            return
        while n > len(self.buf):
            n -= len(self.buf)
            self.buf = b""
            if not self.fill():
                raise ValueError("the file ends inside a record")
        self.buf = self.buf[n:]


def _records(stream: _Plain) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers of one record after the other (names in lower case, the first of equal names), block length and head length.

    The caller takes or skips the block before it asks for the next record.
    """
    while True:
        while True:  # line ends between records
            stream.buf = stream.buf.lstrip(b"\r\n")
            if stream.buf or not stream.fill(HEAD_STEP):
                break
        if not stream.buf:
            return
        while (end := stream.buf.find(b"\r\n\r\n")) < 0:
            if len(stream.buf) > HEAD_BYTES or not stream.fill(HEAD_STEP):
                raise ValueError("no end of a record's headers")
        head, stream.buf = stream.buf[:end], stream.buf[end + 4 :]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {head[:40]!r}")
        lines: list[str] = []
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and lines:
                lines[-1] += " " + line.strip()
            else:
                lines.append(line)
        headers: dict[str, str] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        yield headers, int(headers["content-length"]), end + 4


def _digest(value: str) -> str:
    """SHA-1 in hexadecimal where it is given in base 32, without its label; anything else as it is."""
    label, _, rest = value.rpartition(":")
    if label.lower() in ("", "sha1") and len(rest) == 32:
        try:
            return base64.b32decode(rest.upper()).hex()
        except ValueError:
            return value
    return rest.lower() if label.lower() in ("", "sha1") and len(rest) == 40 else value


def _cell(column: str, kind: pa.DataType, headers: dict[str, str]):
    """The value of a column from the headers of a record, or None."""
    if column == "headers":
        return list(headers.items())
    dashed = column.replace("_", "-").lower()
    names = [HEADERS[column].lower()] if column in HEADERS else [f"x-{dashed}", f"warc-{dashed}", dashed]
    value = next((headers[n] for n in names if n in headers), None)
    if value is None:
        return None
    if column in _IDS:
        value = value.removeprefix("<").removesuffix(">")
    elif column == "payload_digest":
        value = _digest(value)
    return int(value) if pa.types.is_integer(kind) else float(value) if pa.types.is_floating(kind) else value


_COMPARED = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a,
}


def _holds(test, value) -> bool | None:
    """A filter on a value, None for unknown as in SQL."""
    if isinstance(test, Not):
        inner = _holds(test.child, value)
        return None if inner is None else not inner
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    if isinstance(test, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, str):
        return _COMPARED[type(test)](value.encode(), test.value.encode())  # strings go by their bytes
    return _COMPARED[type(test)](value, test.value)


def _column(test) -> tuple[str, ...] | None:
    """The column of a filter that headers can answer; None for others. In over a list with null is left to Spark."""
    if isinstance(test, Not):
        return _column(test.child)
    if isinstance(test, In) and any(v is None for v in test.value):
        return None
    return tuple(test.attribute) if isinstance(test, (IsNull, IsNotNull, EqualNullSafe, *_COMPARED)) else None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.fields = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])
        self.tests: list = []

    def pushFilters(self, filters):
        for test in filters:
            column = _column(test)
            if column and len(column) == 1 and column[0] in self.fields.names and column[0] not in ("payload", "headers"):
                self.tests.append((column[0], test))
            else:
                yield test

    def partitions(self):
        store, top = _store(self.options["path"])
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and not any(p[0] in "_." for p in f.path[len(top) :].split("/") if p)]
        limit, parts, size = int(self.options.get("partition_bytes", PARTITION_BYTES)), [], 0
        for f in sorted(found, key=lambda f: (-f.size, f.path)):  # the longest tasks begin first
            if not parts or size + f.size > limit:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition):
        store, _ = _store(self.options["path"])
        names, kinds = self.fields.names, self.fields.types
        kind = dict(zip(names, kinds, strict=True))
        wants_payload, rows, size = "payload" in names, [], 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                magic = f.read(2)
                f.seek(0)
                stream = (_Gzip if magic == b"\x1f\x8b" else _Plain)(f)
                try:
                    for headers, length, head in _records(stream):
                        cells = {c: _cell(c, kind[c], headers) for c, _ in self.tests}
                        wanted = all(_holds(test, cells[c]) for c, test in self.tests)
                        if not wanted or not wants_payload:
                            stream.skip(length, head)
                            payload = None
                        else:
                            block = stream.take(length)
                            if len(block) < length:
                                raise ValueError("the file ends inside a record")
                            payload = _payload(headers, block)
                        if wanted:
                            rows.append([payload if c == "payload" else cells[c] if c in cells else _cell(c, k, headers) for c, k in zip(names, kinds, strict=True)])
                            size += len(payload or b"") + 200
                            if size >= BATCH_BYTES:
                                yield self._batch(rows)
                                rows, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{path}: not a readable archive: {e}") from e
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if len(self.fields) else []
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, self.fields.types, strict=True)], schema=self.fields)


def _payload(headers: dict[str, str], block: bytes) -> bytes | None:
    """What a record holds: its block, without the head of an HTTP message; nothing in a revisit."""
    if headers.get("warc-type") == "revisit":
        return None
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.MapType):
        return pa.map_(pa.string(), pa.string())
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    name = kind.simpleString()
    if name not in simple:
        raise ValueError(f"the warc source has no columns of type {name}")
    return simple[name]


# ---- writing ----


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _member(record: bytes, level: int) -> bytes:
    """A gzip member of one record that states its length and that of the record."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(record) + body.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, 24 + len(packed) + 8, len(record))
    return head + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(value) -> str:
    """A header value on one line: line ends are percent-encoded."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, now: str) -> bytes:
    """One record. row has record_type and any other columns; null ones give no header."""
    payload, kind = row.get("payload"), row.get("record_type") or "resource"
    payload = payload.encode() if isinstance(payload, str) else payload or b""
    if kind == "response":
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        row = {"content_type": "application/http; msgtype=response"} | {k: v for k, v in row.items() if v is not None}
    else:
        block = b"" if kind == "revisit" else payload
    row = {"record_date": now, "record_id": f"urn:uuid:{uuid.uuid4()}"} | {k: v for k, v in row.items() if v is not None} | {"record_type": kind}
    lines = ["WARC/1.1"]
    for column, value in row.items():
        if column in ("payload", "headers", "block_length"):
            continue
        if column in _IDS:
            value = f"<{value}>"
        elif column == "payload_digest" and len(str(value)) == 40:
            value = "sha1:" + base64.b32encode(bytes.fromhex(value)).decode()
        lines.append(f"{HEADERS.get(column) or 'X-' + column.replace('_', '-')}: {_line(value)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.now = self.options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _staged(self) -> tuple[fs.FileSystem, str, str]:
        store, top = _store(self.options["path"])
        return store, top.rstrip("/"), f"{top.rstrip('/')}/_staged-{self.job}"

    def write(self, iterator):
        store, _, staged = self._staged()
        packed = self.options.get("compression", "gzip") == "gzip"
        level, limit = int(self.options.get("level", 1)), int(self.options.get("file_bytes", FILE_BYTES))
        names, out, size = [], None, 0
        store.create_dir(staged, recursive=True)
        try:
            for batch in iterator:
                for row in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
                    if out is None or size >= limit:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * packed}")
                        out, size = store.open_output_stream(f"{staged}/{names[-1]}", compression=None), 0
                        info = record({"record_type": "warcinfo", "content_type": "application/warc-fields", "filename": names[-1], "payload": "software: facetwise\r\nformat: WARC File Format 1.1\r\n"}, self.now)
                        out.write(_member(info, level) if packed else info)
                    raw = record(row, self.now)
                    raw = _member(raw, level) if packed else raw
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        store, top, staged = self._staged()
        old = [f.path for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.File] if self.overwrite else []
        store.create_dir(top, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{staged}/{name}", f"{top}/{name}")
        for path in old:
            store.delete_file(path)
        self._clear(store, staged)

    def abort(self, messages):
        store, _, staged = self._staged()
        self._clear(store, staged)

    def _clear(self, store, staged: str) -> None:
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class WarcSource(DataSource):
    """Options of reading: partition_bytes (small files that share a task). Of writing: compression (gzip or none), level, file_bytes, date.

    Reading: an absent header is null; a schema without `payload` reads no blocks, one without any column but headers' no
    more than headers; a revisit has a null payload; payloads are as stored, without transfer or content decoding; files
    whose names (or folders) begin with _ or . are not read; a damaged file is an error that names it. Writing: a null
    column gives no header, a null payload an empty block, line ends in values are percent-encoded, blanks around them are
    lost; a response gets an HTTP head; no rows give no files.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


# ---- pages ----

#: Bytes of a payload that is stored once for all records that have it.
LEAST_BYTES = 1000


def records(pages: DataFrame, spark: SparkSession, *, least: int = LEAST_BYTES) -> DataFrame:
    """One record a row of pages(page_id, url, html), to be written with format("warc").

    Of the rows with equal payloads of at least `least` bytes those with the greatest page_id are responses, the others
    revisit it; shorter payloads are responses all. Null html is empty; a null page_id comes last (rows with one are
    responses only if all of their payload have none); rows that share the greatest page_id are all responses; payloads of
    any length are one record each; no pages give no records; other columns are not read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_length"), F.sha1(html.cast("binary")).alias("payload_digest"))
    long = own.where(F.col("payload_length") >= least).withColumn("equal", F.sha2(F.col("payload").cast("binary"), 256))
    keepers = long.groupBy("equal").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows_of"))
    # A payload that a large part of the rows have is joined by broadcast, all others by shuffle.
    met = to_own(long, keepers, "equal", pages.count(), Scratch(spark)).withColumn("record_type", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), "response").otherwise("revisit"))
    rows = met.select("page_id", "target_uri", "payload", "payload_length", "payload_digest", "record_type", "keeper").unionByName(
        own.where(F.col("payload_length") < least).withColumn("record_type", F.lit("response")).withColumn("keeper", F.lit(None).cast(pages.schema["page_id"].dataType))
    )
    again = F.col("record_type") == "revisit"
    return rows.select(
        "record_type", F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")).alias("record_id"), "target_uri", F.when(~again, F.col("payload")).alias("payload"), "payload_digest", "payload_length",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("keeper").cast("string"))).alias("refers_to"), F.when(again, F.lit(SAME_PAYLOAD)).alias("profile"), F.col("page_id").cast("string").alias("page_id"),
    )


def archived(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages in archives that `records` made.

    Length and digest of a response are those of the payload as read back, of a revisit those that its headers state.
    """
    register(spark)
    schema = "record_type string, page_id string, payload_length long, payload_digest string, refers_to string, payload binary"
    got = spark.read.format("warc").schema(schema).load(path).where(F.col("record_type").isin("response", "revisit"))
    whole = F.col("record_type") == "response"
    return got.select(
        F.col("page_id").cast(kind).alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.regexp_replace("refers_to", "^urn:page:", "").cast(kind).alias("refers_to"),
    )
