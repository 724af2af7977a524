"""WARC archives as a Spark data source, read and written.

Reading: whole files are packed into partitions of about equal size. Predicates on the record type and
on headers are pushed into the scan; a record's headers are parsed first, and its payload is inflated
only if the predicates hold and the payload is asked for. Archives that this source writes have one
gzip member a record with its length in the member's `sl` field, so an unwanted payload isn't even read.

Writing: each task writes files of its own under names that no other attempt uses, and the commit
lists the files of the attempts that won. A reader takes the listed files alone, so what a lost
executor left behind is never read.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from . import common as C

#: Compressed bytes of a partition when reading, and of a file when writing, about.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTING = "_files-"
SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: The header that each column holds.
HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
_ARROW = {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}


def _file_system(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    import pyarrow.fs as fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path if parts.scheme else path
    return fs.FileSystem.from_uri(path)


# --- records ---------------------------------------------------------------------------------


def _header_lines(fields: Iterable[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in fields if v is not None).encode()


def record(record_type: str, record_id: str, payload: bytes, digest: str, target_uri: str | None, date: str, refers_to: str | None, payload_bytes: int) -> bytes:
    """One record: a response holds the payload as an HTTP message, a revisit none of it."""
    block = b""
    if record_type == "response":
        block = b"HTTP/1.1 200 OK\r\n" + _header_lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n" + payload
    head = _header_lines([
        ("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", target_uri), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if record_type == "revisit" else None), ("WARC-Refers-To", refers_to), ("X-Payload-Length", payload_bytes),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own length, so that readers can pass over it."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(data: bytes) -> dict[str, str]:
    """The named fields of a record's head; a line that starts with a space continues the one before."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {first[:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


class _Wanted:
    """What the scan asks for: predicates on headers, and which columns."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns
        self.tests: list[tuple[str, str, object]] = []

    def accepts(self, head: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            found = column(head, name)
            if not (found is not None and (found in value if kind == "in" else found.startswith(value) if kind == "starts" else True)):  # type: ignore[operator,arg-type]
                return False
        return True

    @property
    def block(self) -> bool:
        return "payload" in self.columns


def column(head: dict[str, str], name: str) -> str | None:
    value = head.get(HEADER_OF[name])
    return value.removeprefix("sha256:") if value is not None and name == "payload_digest" else value


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head, if it has one."""
    if head.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _row(head: dict[str, str], block: bytes | None, columns: list[str]) -> tuple:
    size = head.get("X-Payload-Length")
    payload = None if block is None else payload_of(head, block)
    values: dict[str, Any] = {"payload": payload, "headers": list(head.items()), "payload_bytes": int(size) if size is not None else len(payload) if payload is not None else None}
    return tuple(values[c] if c in values else column(head, c) for c in columns)


def _stream(f: BinaryIO, wanted: _Wanted, seekable: bool) -> Iterator[tuple]:
    """Rows of a sequence of records; an unwanted block is passed over."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        lines = [line.rstrip(b"\r\n")]
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        head = parse_headers(b"\r\n".join(lines))
        left = int(head["Content-Length"])
        if (keep := wanted.accepts(head)) and wanted.block:
            yield _row(head, f.read(left), wanted.columns)
            continue
        if keep:
            yield _row(head, None, wanted.columns)
        if seekable:
            f.seek(left, 1)
        while left and not seekable:
            left -= (n := len(f.read(min(left, 1 << 16)))) or left


def _members(f: BinaryIO, wanted: _Wanted) -> Iterator[tuple]:
    """Rows of an archive whose members tell their lengths; only wanted payloads are read and inflated."""
    at = 0
    while True:
        f.seek(at)
        start = f.read(4096)
        if not start:
            return
        if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
            f.seek(at)
            yield from _stream(gzip.GzipFile(fileobj=f), wanted, False)  # type: ignore[arg-type]
            return
        length = struct.unpack_from("<I", start, 16)[0]
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(start[24:length])
        read = len(start)
        while b"\r\n\r\n" not in data and read < length:
            more = f.read(min(1 << 16, length - read))
            read += len(more)
            data += inflate.decompress(more)
        raw, _, rest = data.partition(b"\r\n\r\n")
        head = parse_headers(raw)
        if wanted.accepts(head):
            block = None
            if wanted.block:
                if read < length:
                    rest += inflate.decompress(f.read(length - read))
                block = (rest + inflate.flush())[: int(head["Content-Length"])]
            yield _row(head, block, wanted.columns)
        at += length


def rows_of(f: BinaryIO, wanted: _Wanted) -> Iterator[tuple]:
    start = f.read(2)
    f.seek(0)
    yield from _members(f, wanted) if start == b"\x1f\x8b" else _stream(f, wanted, True)


# --- the data source -------------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], partition_bytes: int) -> None:
        self.path, self.partition_bytes = path, partition_bytes
        self.wanted = _Wanted(columns)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_OF and isinstance(f, EqualTo):
                self.wanted.tests.append((name, "in", {f.value}))
            elif name in HEADER_OF and isinstance(f, In):
                self.wanted.tests.append((name, "in", set(f.value)))
            elif name in HEADER_OF and isinstance(f, StringStartsWith):
                self.wanted.tests.append((name, "starts", f.value))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.wanted.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        import pyarrow.fs as pafs

        fs, root = _file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = sorted((x for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.File), key=lambda x: x.path)
            if lists := [x.path for x in found if x.base_name.startswith(LISTING)]:
                named: set[str] = set()
                for p in lists:
                    with fs.open_input_stream(p) as f:
                        named.update(json.loads(f.read()))
                found = [x for x in found if x.base_name in named]
            else:
                found = [x for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        out: list[_Files] = []
        size = self.partition_bytes
        for x in found:
            if size + x.size > self.partition_bytes:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Files)
        columns = self.wanted.columns
        schema = pa.schema([(c, _ARROW.get(c, pa.string())) for c in columns])
        rows: list[tuple] = []
        size = 0
        fs, _ = _file_system(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in rows_of(io.BufferedReader(f, 1 << 18), self.wanted):
                    rows.append(row)
                    size += 200 + (len(row[columns.index("payload")] or b"") if self.wanted.block else 0)
                    if size > 4 << 20:
                        yield from C.arrow(schema, rows).to_batches()
                        rows, size = [], 0
        if rows:
            yield from C.arrow(schema, rows).to_batches()


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Rows with the columns of SCHEMA (headers and others are ignored) become records, a gzip member each."""

    def __init__(self, path: str, file_bytes: int) -> None:
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _file_system(self.path)
        names: list[str] = []
        out, size = None, 0
        try:
            for data in iterator:
                for r in data.to_pylist():
                    if out is None or size > self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        fs.create_dir(root)
                        out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    one = member(record(r["record_type"], r["record_id"], r["payload"] or b"", r["payload_digest"], r["target_uri"], r["date"], r["refers_to"], r["payload_bytes"]))
                    out.write(one)
                    size += len(one)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/{LISTING}{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if isinstance(m, _Written) for n in m.names]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _file_system(self.path)
        for name in [n for m in messages if isinstance(m, _Written) for n in m.names]:
            fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Format "warc". A schema with fewer columns is read faster: without payload none is inflated."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema.names, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages -----------------------------------------------------------------------------------


def write_pages(pages: DataFrame, path: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per page; of pages with equal payloads of least_bytes or more, that with the smallest id is a response.

    A null html is an empty payload. Null ids sort after all others: such a page revisits one with an id,
    and if none of its payload has one, all are responses. Rows that repeat the smallest id are responses
    too. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    register(spark)
    C.bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    scratch = C.Scratch(spark)
    firsts = scratch.keep(firsts, "first-pages")  # both sides of the join are then exchanges, and a frequent payload is split
    found = rows.join(firsts, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)
    scratch.drop(firsts)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of write_pages.

    A response's size and digest are those of the payload as read; a revisit, whose payload lies in
    another record, gives those in its headers, and no payload is inflated for it.
    """
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    responses = spark.read.format("warc").schema("record_type string, record_id string, payload binary").load(path).where("record_type = 'response'")
    revisits = spark.read.format("warc").schema("record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long").load(path).where("record_type = 'revisit'")
    return responses.select(
        page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(revisits.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back: the rows of read_pages, whose archives are deleted.

    Nulls, repeated rows and ties are as in write_pages; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write_pages(pages, path)
    found = C.Scratch(spark).keep(read_pages(spark, path), "read-pages")
    C.delete(spark, path)
    return found
