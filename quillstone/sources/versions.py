"""Numbered markers that make a change of several files whole: the last marker is the current state.

A marker is a small JSON text. It is written aside and renamed without leave to overwrite: of two changes that start from the same
state one is first, and the other starts anew. A change that fails before leaves the state as it was.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path.rstrip('/')}/versions"

    def at(self, path: str):
        """The file system of a path, and the path as it takes it."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def numbers(self) -> list[int]:
        fs, folder = self.at(self.path)
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def state(self, number: int | None = None) -> dict | None:
        """A version's state, by default the current one; null before the first."""
        found = self.numbers()
        if not found:
            return None
        fs, target = self.at(f"{self.path}/{found[-1] if number is None else number:012d}")
        stream = fs.open(target)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> bool:
        """Make this the current state; false if another change was first."""
        jvm = self.spark.sparkContext._jvm
        fs, target = self.at(f"{self.path}/{number:012d}")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(files.makeQualified(aside), files.makeQualified(target), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            fs.delete(aside, False)
            return False
        return True

    def drop(self, number: int) -> None:
        fs, target = self.at(f"{self.path}/{number:012d}")
        fs.delete(target, False)
