"""What runs share: tables that are written once, and calls of models by the hash of what they were asked.

A model call is kept under its kind, the model's name with its settings, and the hash of its inputs. Before a plan reads an
answer, the distinct inputs that have none yet are found by an anti-join, asked, and appended; the append of a portion is one atomic commit, so a
killed run loses the portion at hand and the next one asks only what is missing. An answer that is an error is asked again by
the next run. Vectors of texts are kept in the same way, so a text is embedded once, however many rows, runs and corpora have it.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.session import shared_dir

#: Calls that are committed together, about; of very many, at most so many portions are made. A portion's inputs lie in so many files, at least.
PORTION, PORTIONS, PORTION_FILES = 20_000, 100, 16


def content_key(*inputs: Column) -> Column:
    """The hash of some texts, their lengths told apart; null isn't the empty text."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in inputs]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Store:
    """A folder that all tasks can write, such as one in object storage; without one a new folder beside the checkpoints."""

    def __init__(self, spark: SparkSession, path: str | None = None, portion: int = PORTION) -> None:
        self.spark, self.portion = spark, portion
        self.path = (path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:12]}").rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def once(self, df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
        """df as a table of its own: what several plans read is computed once. rows_a_file: at most, if it isn't 0."""
        path = f"{self.path}/tables/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def timed(self, df: DataFrame, name: str) -> tuple[DataFrame, float]:
        """once(), and how many milliseconds it took."""
        began = time.perf_counter()
        return self.once(df, name), 1000 * (time.perf_counter() - began)

    def folder(self, kind: str, model: str) -> str:
        return f"{self.path}/{kind}/{hashlib.sha256(model.encode()).hexdigest()[:16]}"

    def _held(self, kind: str, model: str, schema: StructType) -> DataFrame:
        path = self.folder(kind, model)
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def portions(self, df: DataFrame) -> list[DataFrame]:
        """df in portions that each read files of their own, so that all together read it once."""
        held = self.once(df, "portions", max(1, self.portion // PORTION_FILES))
        n, files = held.count(), sorted(map(unquote, held.inputFiles()))
        k = min(-(-n // self.portion), PORTIONS, len(files))
        return [self.spark.read.schema(held.schema).parquet(*files[i::k]) for i in range(k)]

    def ask(self, kind: str, model: str, rows: DataFrame, inputs: Sequence[Column], call: Callable[..., Column], out: str) -> DataFrame:
        """rows with `out`, what the model's call (columns to a column) gives for their inputs. Each distinct input is asked once.

        A result with a field `error` that isn't null counts as not answered for the next run, not for this one.
        """
        keyed = self.once(rows.withColumn("_key", content_key(*inputs)).withColumns({f"_in{k}": c for k, c in enumerate(inputs)}), kind)
        names = [f"_in{k}" for k in range(len(inputs))]
        asked = keyed.select("_key", *names).dropDuplicates(["_key"])
        result = asked.select("_key", call(*map(F.col, names)).alias("result"), F.unix_micros(F.current_timestamp()).alias("asked_at"))
        kinds = result.schema["result"].dataType
        failed = F.col("result.error").isNotNull() if isinstance(kinds, StructType) and "error" in kinds.names else F.lit(False)
        for part in self.portions(asked.join(self._held(kind, model, result.schema).where(~failed).select("_key"), "_key", "left_anti")):
            part.select("_key", call(*map(F.col, names)).alias("result"), F.unix_micros(F.current_timestamp()).alias("asked_at")).write.mode("append").parquet(self.folder(kind, model))
        held = self._held(kind, model, result.schema).groupBy("_key").agg(F.max_by("result", F.struct(~failed, F.col("asked_at"))).alias(out))
        return keyed.join(held, "_key").drop("_key", *names)
