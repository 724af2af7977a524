"""What the operators share: tables, the shared folder, words, blocks and packed arrays.

A *block* is a bounded set of whole documents that one Python call sees together. Where counts of
all documents must come back to each of them, a block sends the distinct sorted hashes that it
holds, cut at fixed ranges of the hash space; each range is merged once over all blocks and the
answers return in the same order. A frequent hash is sent once a block, so no key is hot, and there
is at most one row for each pair of block and range that shares a hash.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import bounded_batches, shared_dir, spread  # noqa: F401

#: Bytes of text in a block, about; a longer document is a block of its own size.
BLOCK_BYTES = 8 << 20
#: Hashes that one range merges, about.
RANGE_ENTRIES = 3_000_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Parquet tables in the shared folder: computed once, lineage cut, safe from lost executors; deleted when no plan reads them."""

    _watched: ClassVar[list[list[Scratch]]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []
        for made in self._watched:
            made.append(self)

    @classmethod
    @contextmanager
    def watched(cls) -> Iterator[None]:
        """Tables made within are deleted at the end: for a caller who writes the result of operators within."""
        made: list[Scratch] = []
        cls._watched.append(made)
        try:
            yield
        finally:
            cls._watched.remove(made)
            for scratch in made:
                scratch.drop_but()

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a table. What its plan has shuffled is deleted once it is written: no later plan reads it."""
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df, path in self.tables:
            if any(df is t for t in tables):
                delete(self.spark, path)
        self.tables = [(df, path) for df, path in self.tables if not any(df is t for t in tables)]

    def drop_but(self, *tables: DataFrame) -> None:
        """Delete all tables but those that a result still reads."""
        self.drop(*(df for df, _ in self.tables if not any(df is t for t in tables)))


def discard_all(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder, those of results too."""
    delete(spark, shared_dir(spark))


#: Ranges into which ordered keys are cut; each is numbered for itself.
_ORDER_RANGES = 64


def numbered(keys: DataFrame, order: Column, scratch: Scratch) -> DataFrame:
    """keys (distinct in order) with place, from 0: ranges in order are written, and the rows before each, at most 64 sums, are added.

    However many keys there are, no task has more than a range of them.
    """
    ranged = scratch.keep(keys.repartitionByRange(_ORDER_RANGES, order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    first = counts.select("part", before.alias("first"))  # of at most _ORDER_RANGES rows
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.join(F.broadcast(first), "part").withColumn("place", place.cast("long")).drop("part", "first")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and the text in UTF-8 bytes; other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def id_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def block_count(n_bytes: int | None, n_rows: int = 0, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for so much text; a row counts 64 bytes besides."""
    return max(1, math.ceil(((n_bytes or 0) + 64 * n_rows) / block_bytes))


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 text: what bytes.split() gives; lower touches A-Z alone."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


_NULL_ID = -(2**63)
_BLOCKS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
BLOCK_SCHEMA = "block long, kind int, doc_ids binary, null_ids binary, sizes binary, texts binary"


def to_blocks(block_bytes: int):
    """Packs rows (doc_id, text, kind) into blocks of one kind, in the order in which they come. No row moves.

    Blocks get random numbers, so they have to be written once and read from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: defaultdict[int, list[tuple[int | None, bytes]]] = defaultdict(list)
        sizes: defaultdict[int, int] = defaultdict(int)

        def made(kind: int) -> pa.RecordBatch:
            rows = open_.pop(kind)
            sizes.pop(kind)
            ids = np.array([_NULL_ID if i is None else i for i, _ in rows], np.int64)
            number = int.from_bytes(os.urandom(8), "little") >> 1
            return batch(_BLOCKS, [number], [kind], [pack(ids)], [pack(np.array([i is None for i, _ in rows], np.uint8))], [pack(np.array([len(t) for _, t in rows], np.int64))], [pack_bytes(b"".join(t for _, t in rows))])

        for data in batches:
            for i, t, kind in zip(*(data.column(c).to_pylist() for c in ("doc_id", "text", "kind")), strict=True):
                open_[kind].append((i, t or b""))
                sizes[kind] += len(t or b"") + 64
                if sizes[kind] >= block_bytes:
                    yield made(kind)
        for kind in list(open_):
            yield made(kind)

    return run


def block_rows(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The ids of a block's documents, which of them are null, and the texts."""
    sizes = unpack(row["sizes"], np.int64)
    whole = unpack_bytes(row["texts"])
    edge = np.concatenate(([0], np.cumsum(sizes)))
    return unpack(row["doc_ids"], np.int64), unpack(row["null_ids"], np.uint8), [whole[edge[k] : edge[k + 1]] for k in range(len(sizes))]


class Vocabulary:
    """Words numbered as they come; hashes() has the 64-bit hash of each."""

    def __init__(self, *reserved: bytes) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        for x in reserved:
            self.ids[x]

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.ids), np.uint64, len(self.ids))


_MIX = 0x9E3779B97F4A7C15


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that ranges of them hold equal shares."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _joined(left: np.ndarray, right: np.ndarray, back: int) -> np.ndarray:
    """Hash of what the left values name, back places earlier, and what the right ones name."""
    moved = np.zeros_like(left)
    moved[back:] = left[: max(0, len(left) - back)]
    return scramble(moved * np.uint64(_MIX) + right)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values that end at each place, by doubling; the first n-1 places hold rubbish."""
    out, length, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power if out is None else _joined(power, out, length)
            length += size
        if length == n:
            return scramble(out + np.uint64(n))
        power = _joined(power, power, size)
        size *= 2


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    if not len(values):
        return b""
    return _PACK.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack(data: bytes | None, dtype: type) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as packed gaps."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes | None) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_bytes(data: bytes) -> bytes:
    return _PACK.compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return _UNPACK.decompress(data)


def cut(sorted_hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of the 64-bit space begins, and the end."""
    edges = [(i << 64) // ranges for i in range(1, ranges)]
    inner = np.searchsorted(sorted_hashes, np.array(edges, np.uint64), "left") if edges else np.zeros(0, np.int64)
    return np.concatenate(([0], inner, [len(sorted_hashes)])).astype(np.int64)


def arrow(schema: pa.Schema, rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns or [[] for _ in schema], schema, strict=True)], schema=schema)


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
