"""The table of chunks with vectors: Parquet files in versions, so that a change is whole or not there.

A version is a table of files with what they hold: owner, rows, and the range of documents and sessions. A change writes new files
beside the old ones, then the new list of files, and last a marker that makes it the current version; the marker is created only if no one else has
created it, else the change starts anew from the version that came in between. What fails before leaves the version before it as it was, and who reads a
version keeps it until `vacuum`.

A file has one owner; rows lie in the order of their documents, and files have Bloom filters of documents and sessions. A read takes only the
files whose ranges can hold what is asked for. A point's id follows from its owner, document and place, so what is written twice is there once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators import relational as R
from quillstone.sources.versions import Versions

#: How often a change starts anew when others come in between.
ATTEMPTS = 10
#: A file's name below the table's data: random and hashed parts only, so that no owner's name means anything to a file system.
_NAME = "regexp_extract(_metadata.file_path, '.*/data/(.*)$', 1) AS file"
_FILES = "file string, user_id string, rows long, min_document string, max_document string, min_session string, max_session string"


def connect(spark: SparkSession, kind: str, place: str) -> ChunkTable:
    """A table by kind: "memory" names a place of this application, "local" and "remote" a path that Spark can write."""
    if kind not in ("memory", "local", "remote"):
        raise ValueError(f"unknown kind of table: {kind!r}")
    root = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = root.get() if root.isDefined() else spark.conf.get("spark.sql.warehouse.dir")
    return ChunkTable(spark, f"{base}/{spark.sparkContext.applicationId}-{place}" if kind == "memory" else place)


class ChunkTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = Versions(spark, self.path)

    # --- versions

    def versions(self) -> list[int]:
        """The numbers of all versions that are still there."""
        return self._versions.numbers()

    def _state(self, version: int | None = None) -> dict:
        """What a version says: its number, its list of files, the schema, and the last batch of each stream."""
        return self._versions.state(version) or {"version": 0, "files": None, "schema": None, "streams": {}}

    def _files(self, state: dict) -> DataFrame:
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/{state['files']}") if state["files"] else self.spark.createDataFrame([], _FILES)

    def _commit(self, state: dict) -> bool:
        return self._versions.commit(state["version"], state)

    def _change(self, change: Callable[[dict], tuple[list[str], DataFrame | None, int]], stream: tuple[str, int] | None = None) -> int:
        """Apply a change to the current version: the files that go, the rows that come, and a number to return.

        stream: name and number of a batch; one that was already applied changes nothing.
        """
        for _ in range(ATTEMPTS):
            state = self._state()
            if stream and state["streams"].get(stream[0], -1) >= stream[1]:
                return 0
            gone, rows, result = change(state)
            if not gone and rows is None and not stream:
                return result
            files = self._files(state)
            if gone:
                files = files.join(self.spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti")
            schema = state["schema"] or json.loads(rows.schema.json())
            if rows is not None:
                files = files.unionByName(self._write(rows))
            name = f"files/{uuid.uuid4().hex}"
            files.coalesce(1 if files.count() < 100_000 else 8).write.parquet(f"{self.path}/{name}")
            if self._commit({"version": state["version"] + 1, "files": name, "schema": schema, "streams": state["streams"] | (dict([stream]) if stream else {})}):
                return result
        raise RuntimeError("too many changes at the same time")

    def _write(self, rows: DataFrame) -> DataFrame:
        """Rows as files of one owner each, in the order of documents, and what each file holds."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        ordered = rows.withColumn("owner", F.sha1(F.coalesce("user_id", F.lit("")))).sortWithinPartitions("owner", "document_id", "session_id")
        ordered.write.option("parquet.bloom.filter.enabled#document_id", "true").option("parquet.bloom.filter.enabled#session_id", "true").partitionBy("owner").parquet(folder)
        fs, target = self._versions.at(folder)
        if not any(f.isDirectory() for f in fs.listStatus(target)):
            return self.spark.createDataFrame([], _FILES)
        held = self.spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder)
        text = lambda c: F.coalesce(c, F.lit(""))
        least, most = (lambda c: F.min(text(c)).alias(f"min_{c.removesuffix('_id')}")), (lambda c: F.max(text(c)).alias(f"max_{c.removesuffix('_id')}"))
        of_file = held.groupBy(F.expr(_NAME)).agg(F.first("user_id").alias("user_id"), F.count("*").alias("rows"), *(f(c) for c in ("document_id", "session_id") for f in (least, most)))
        return of_file.select("file", "user_id", "rows", "min_document", "max_document", "min_session", "max_session")

    def _read(self, state: dict, files: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(state["schema"]) if state["schema"] else None
        if schema is None:
            raise ValueError(f"there is no table at {self.path}")
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def _chosen(self, state: dict, where: Column | None = None) -> list[str]:
        """The files that can hold what is asked for."""
        files = self._files(state)
        return [r["file"] for r in (files if where is None else files.where(where)).select("file").toLocalIterator()]

    # --- writing

    def append(self, chunks: DataFrame, user_id: str, document_id: str, session_id: str | None = None) -> None:
        """Chunks of a document with their owner. Written twice they are there once; the first write makes the table, with the columns of its chunks."""
        if not user_id.strip():
            raise ValueError("an owner is required")
        self.upsert(chunks.withColumns({"user_id": F.lit(user_id), "document_id": F.lit(document_id), "session_id": F.lit(session_id).cast("string")}))

    def upsert(self, chunks: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """chunks (user_id, document_id, session_id, and what else) with point_id and upload_time; points that are there are replaced.

        A point's place in its document is chunk_index, without that column its text. Only files that hold a point that is replaced are written anew.
        """
        place = F.col("chunk_index" if "chunk_index" in chunks.columns else "text").cast("string")
        point = F.sha2(F.to_json(F.struct("user_id", "document_id", place.alias("place"))), 256)
        new = chunks.withColumns({c: F.col(c).cast("string") for c in ("user_id", "document_id", "session_id")})
        new = new.withColumns({"upload_time": F.unix_micros(F.current_timestamp()) / 1e6, "point_id": point}).dropDuplicates(["point_id"])

        def change(state: dict) -> tuple[list[str], DataFrame, int]:
            gone: list[str] = []
            rows = new
            if state["schema"]:
                near = F.col("f.user_id").eqNullSafe(F.col("k.user_id")) & F.coalesce("k.document_id", F.lit("")).between(F.col("f.min_document"), F.col("f.max_document"))
                keys = new.select("user_id", "document_id").distinct()
                touched = self._files(state).alias("f").join(keys.alias("k"), near, "left_semi").select("file")
                held = self._read(state, [r["file"] for r in touched.toLocalIterator()])
                gone = self._holding(held, new.select("point_id"), "point_id")
                if gone:
                    rows = self._read(state, gone).join(new.select("point_id"), "point_id", "left_anti").select(*held.columns).unionByName(new.select(*held.columns))
            return gone, rows, 0

        self._change(change, stream)

    def _holding(self, rows: DataFrame, keys: DataFrame, *on: str) -> list[str]:
        """The files of rows that hold one of the keys."""
        if not rows.inputFiles():
            return []
        return [r["file"] for r in rows.select(F.expr(_NAME), *on).join(keys, list(on), "left_semi").select("file").distinct().toLocalIterator()]

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of chunks: a batch that is delivered again changes nothing."""
        return lambda batch, number: self.upsert(batch, (name, number))

    # --- reading

    def read(self, user_id: str, document_ids: Sequence[str] | None = None, session_id: str | None = None, version: int | None = None) -> DataFrame:
        """What one owns, of the documents asked for if any are, and of one session. Only files that can hold it are opened."""
        state = self._state(version)
        where = F.col("user_id") == user_id
        if document_ids:
            ids = sorted(map(str, document_ids))
            some = F.exists(F.array(*map(F.lit, ids)), lambda i: (i >= F.col("min_document")) & (i <= F.col("max_document")))
            where = where & some
        if session_id is not None:
            where = where & (F.col("min_session") <= session_id) & (F.col("max_session") >= session_id)
        found = R.owned(self._read(state, self._chosen(state, where)), user_id, document_ids)
        return found if session_id is None else found.where(F.col("session_id") == session_id)

    def whole(self) -> DataFrame:
        state = self._state()
        return self._read(state, self._chosen(state))

    def count(self, user_id: str, document_id: str) -> int:
        return self.read(user_id, [document_id]).count()

    # --- deleting

    def _remove(self, where: Column, doomed: Callable[[DataFrame], DataFrame]) -> int:
        """Delete rows of the files that can hold them; files of which nothing is left go. doomed: of rows, those that go, with their points."""

        def change(state: dict) -> tuple[list[str], DataFrame | None, int]:
            files = self._chosen(state, where)
            if not files:
                return [], None, 0
            lost = doomed(self._read(state, files).select("*", F.expr(_NAME)))
            gone = {r["file"]: r["n"] for r in lost.groupBy("file").agg(F.count("*").alias("n")).toLocalIterator()}
            if not gone:
                return [], None, 0
            rows = self._read(state, list(gone))
            left = rows.join(doomed(rows.select("*", F.lit("").alias("file"))).select("point_id"), "point_id", "left_anti").select(*rows.columns)
            return list(gone), left, sum(gone.values())

        return self._change(change)

    def delete_document(self, user_id: str, document_id: str) -> int:
        """Delete and count again; an error if any chunk is left. Returns how many went."""
        if not self.versions():
            return 0
        in_range = (F.col("user_id") == user_id) & (F.col("min_document") <= document_id) & (F.col("max_document") >= document_id)
        n = self._remove(in_range, lambda rows: R.owned(rows, user_id, [document_id]))
        if left := self.count(user_id, document_id):
            raise RuntimeError(f"{left} chunks of the document are left")
        return n

    def delete_user(self, user_id: str) -> int:
        """Delete all that one owns, from the disk too: whole files, without reading them."""

        def change(state: dict) -> tuple[list[str], DataFrame | None, int]:
            own = self._files(state).where(F.col("user_id") == user_id).select("file", "rows").collect()
            return [r["file"] for r in own], None, sum(r["rows"] for r in own)

        n = self._change(change)
        if n:
            self.vacuum()
        return n

    def purge_orphans(self, registry: DataFrame) -> int:
        """Delete chunks whose document isn't in the registry (document_id) and those without an owner, and count again. Returns how many went."""
        if not self.versions():
            return 0
        n = self._remove(F.lit(True), lambda rows: R.orphans(rows, registry))
        if left := R.orphans(self.whole(), registry).count():
            raise RuntimeError(f"{left} orphans are left")
        return n

    def compact(self, user_id: str, rows_per_file: int = 100_000) -> None:
        """One owner's files anew, each with a range of documents of its own."""

        def change(state: dict) -> tuple[list[str], DataFrame | None, int]:
            files = self._chosen(state, F.col("user_id") == user_id)
            if not files:
                return [], None, 0
            rows = self._read(state, files)
            return files, rows.repartitionByRange(max(1, -(-rows.count() // rows_per_file)), "document_id", "session_id"), 0

        self._change(change)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the latest ones, and the files that none of these has."""
        versions = self.versions()
        states = [self._state(v) for v in versions[-keep:]]
        held = {f for s in states for f in self._chosen(s)}
        for v in versions[:-keep]:
            self._versions.drop(v)
        fs, folder = self._versions.at(f"{self.path}/files")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            if f"files/{f.getPath().getName()}" not in {s["files"] for s in states}:
                fs.delete(f.getPath(), True)
        fs, folder = self._versions.at(f"{self.path}/data")
        found = fs.listFiles(folder, True) if fs.exists(folder) else None
        while found is not None and found.hasNext():
            at = found.next().getPath()
            name = at.toUri().getRawPath().rpartition("/data/")[2]
            if at.getName().endswith(".parquet") and name not in held:
                fs.delete(at, False)
