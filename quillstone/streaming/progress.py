"""Progress of streaming jobs as rows of a table."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

_ROWS = "name string, run_id string, batch_id long, rows long, done long, total long, percent int, at double"


class JobProgress(StreamingQueryListener):
    """A listener that appends a row a batch: how many rows a query has done of those that it will have, in percent that never fall.

    totals: the rows that each query, by name, is to read; others are left out. A query that ends without an error is at 100.
    """

    def __init__(self, spark: SparkSession, path: str, totals: dict[str, int]) -> None:
        self.spark, self.path, self.totals = spark, path, totals
        self.done: dict[str, int] = {}
        self.names: dict[str, str] = {}
        self.lock = threading.Lock()

    def _note(self, name: str, run_id: str, batch_id: int, rows: int, ended: bool = False) -> None:
        with self.lock:
            done = self.done[run_id] = self.done.get(run_id, 0) + rows
            total = self.totals[name]
            percent = 100 if ended else min(100, 100 * done // total) if total else 100
            self.spark.createDataFrame([(name, run_id, batch_id, rows, done, total, percent, time.time())], _ROWS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        if event.name in self.totals:
            self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.totals and p.numInputRows:
            self._note(p.name, str(p.runId), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        if name is not None and event.exception is None:
            self._note(name, str(event.runId), -1, 0, True)

    def table(self) -> DataFrame:
        """name, run_id, batch_id (-1 at the end), rows, done, total, percent, at."""
        return self.spark.read.schema(_ROWS).parquet(self.path)
