"""A stored inverted index for BM25 over a whole corpus: built once, extended by segments, read by terms.

A segment is made in one pass: each task cuts its chunks into ranges of some hundred, and of each term in a range it makes
one block: the chunks, how often each has the term, how long each is, and the bounds of the two. A block without a term has all chunks of the range. Blocks are dealt to buckets by their
term and sorted by it, so a query opens its terms' buckets alone; document frequencies are sums over
blocks. Statistics of the corpus are kept with the version, so no query reads a chunk.

A query's blocks meet by range. A task goes through its ranges from the most promising one on; a question for which the bounds of a range stay below
the k-th score that the task has found for it skips that range.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import retrieval as R
from quillstone.sources.versions import Versions

#: Chunks of a range, buckets of terms, and ranges that one task scores, about.
RANGE_CHUNKS, BUCKETS, TASK_RANGES = 256, 32, 16
#: Tasks that write an index, for each piece that its chunks are read in, at least.
TASKS_A_PART = 4

_TERM = re.compile(T.TERM)
_BLOCKS = pa.schema([("range", pa.int64()), ("term", pa.string()), ("chunk_ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_length", pa.int32())])
BLOCK_SCHEMA = "range long, term string, chunk_ids array<long>, tfs array<int>, lengths array<int>, n int, max_tf int, min_length int"


def _blocks(range_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the ranges of one task; a range's number holds the task's."""
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple[int, str]] = []

        def made(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            postings: defaultdict[str, dict[int, int]] = defaultdict(dict)
            lengths = []
            for at, (_, text) in enumerate(rows):
                words = _TERM.findall(text.lower()) if text else []
                lengths.append(len(words))
                for w in words:
                    own = postings[w]
                    own[at] = own.get(at, 0) + 1
            ids = [i for i, _ in rows]
            columns = (
                [(task << 24) + number] * (len(postings) + 1), [None, *postings], [ids, *([ids[a] for a in own] for own in postings.values())], [[0] * len(ids), *(list(own.values()) for own in postings.values())],
                [lengths, *([lengths[a] for a in own] for own in postings.values())], [len(ids), *map(len, postings.values())], [0, *(max(own.values()) for own in postings.values())], [0, *(min(lengths[a] for a in own) for own in postings.values())],
            )
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)

        for data in batches:
            held += zip(data.column("chunk_id").to_pylist(), data.column("text").to_pylist(), strict=True)
            while len(held) >= range_chunks:
                yield made(held[:range_chunks])
                held = held[range_chunks:]
        if held:
            yield made(held)

    return run


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / mean))


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, range_chunks: int = RANGE_CHUNKS) -> None:
        self.spark, self.path, self.buckets, self.range_chunks = spark, path.rstrip("/"), buckets, range_chunks
        self._versions = Versions(spark, self.path)

    def state(self) -> dict:
        """Segments and statistics: n (chunks), n_full (those with terms), length (terms of all), and the mean idf over all terms by either count."""
        return self._versions.state() or {"version": 0, "segments": [], "n": 0, "n_full": 0, "length": 0, "mean_n": 0.0, "mean_n_full": 0.0}

    def blocks(self, state: dict | None = None) -> DataFrame:
        """All blocks, with segment and bucket."""
        segments = (state or self.state())["segments"]
        schema = f"{BLOCK_SCHEMA}, bucket int"
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.path}/blocks/{s}").parquet(f"{self.path}/blocks/{s}").withColumn("segment", F.lit(s)) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment string")

    def _write(self, blocks: DataFrame, parts: int) -> str:
        """A new segment. parts: the pieces that the blocks come from; a bucket is cut by ranges into more files as they grow, so no task or frequent term has more than so many pieces' share."""
        segment = uuid.uuid4().hex
        cuts = max(1, -(-TASKS_A_PART * parts // self.buckets))
        cut = F.pmod(F.xxhash64("range"), F.lit(cuts))
        placed = blocks.withColumn("bucket", _bucket(F.col("term"), self.buckets)).repartition(self.buckets * cuts, "bucket", cut).sortWithinPartitions("bucket", "term")
        placed.write.option("parquet.block.size", str(8 << 20)).partitionBy("bucket").parquet(f"{self.path}/blocks/{segment}")
        return segment

    def _means(self, segments: list[str], n: int, n_full: int) -> dict[str, float]:
        """The mean over all terms of their idf, from how many terms have each document frequency."""
        blocks = self.blocks({"segments": segments}).where("term IS NOT NULL")
        df = blocks.groupBy("term").agg(F.sum("n").alias("df")).groupBy("df").agg(F.count("*").alias("terms"))
        of = lambda total: F.sum(F.col("terms") * (F.log(F.lit(total) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))) / F.sum("terms")
        found = df.agg(of(n).alias("n"), of(n_full).alias("n_full")).first()
        return {"mean_n": found["n"] or 0.0, "mean_n_full": found["n_full"] or 0.0}

    def append(self, chunks: DataFrame) -> None:
        """A segment of chunks (chunk_id, text), which must not be in the index yet. A failed append leaves the index as it was."""
        rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("text").cast("string").alias("text"))
        segment = self._write(rows.mapInArrow(_blocks(self.range_chunks), BLOCK_SCHEMA), rows.rdd.getNumPartitions())
        whole = self.blocks({"segments": [segment]}).where((F.col("bucket") == _bucket(F.lit(None).cast("string"), self.buckets)) & F.col("term").isNull())
        lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
        size = whole.agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("lengths", lambda x: x > 0))).alias("n_full"), F.sum(lengths).alias("length")).first()
        n, n_full, length = (size[c] or 0 for c in ("n", "n_full", "length"))
        while True:
            state = self.state()
            new = {"version": state["version"] + 1, "segments": [*state["segments"], segment], "n": state["n"] + n, "n_full": state["n_full"] + n_full, "length": state["length"] + length}
            if self._versions.commit(new["version"], new | self._means(new["segments"], new["n"], new["n_full"])):
                return

    def merge(self) -> None:
        """All segments as one: a query opens as many files for a term as there are segments."""
        state = self.state()
        if len(state["segments"]) > 1:
            blocks = self.blocks(state).withColumn("range", F.xxhash64("segment", "range")).drop("segment", "bucket")
            segment = self._write(blocks, blocks.rdd.getNumPartitions())
            if not self._versions.commit(state["version"] + 1, state | {"version": state["version"] + 1, "segments": [segment]}):
                self.merge()

    def statistics(self, n: str = "n_full") -> DataFrame:
        """term, df, idf, mean_length of all terms."""
        state = self.state()
        raw = F.log(F.lit(state[n]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        df = self.blocks(state).where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
        return df.select("term", "df", F.when(raw < 0, R.EPSILON * state[f"mean_{n}"]).otherwise(raw).alias("idf"), F.lit(state["length"] / max(1, state["n"])).alias("mean_length"))

    def top_k(self, questions: DataFrame, k: int) -> DataFrame:
        """qid, chunk_id, bm25_score, rank of questions (qid, question), a stated set taken in slices of a bounded size; scores that aren't above 0 are left out."""
        state = self.state()
        asked = R.question_terms(questions).groupBy("qid").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
        parts = [self._scored(own, k, state) for own in R.in_slices(asked) if own]
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "qid long, chunk_id long, bm25_score double")
        return R._top(found, "bm25_score", k, "chunk_id")

    def _scored(self, asked: list[Row], k: int, state: dict) -> DataFrame:
        terms = sorted({t["term"] for q in asked for t in q["terms"]})
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", _bucket(F.col("term"), self.buckets))
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        blocks = self.blocks(state).where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted.select("term")), "term")  # the terms of one slice of questions
        mean = state["length"] / max(1, state["n"])
        counts = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        idf = {t: math.log(state["n"] - df + 0.5) - math.log(df + 0.5) for t, df in counts.items()}
        idf = {t: x if x >= 0 else R.EPSILON * state["mean_n"] for t, x in idf.items()}
        asking: defaultdict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, q in enumerate(asked):
            for t in q["terms"]:
                if t["term"] in idf:
                    asking[t["term"]].append((at, t["times"] * idf[t["term"]]))
        run = _best_of_ranges(np.array([q["qid"] for q in asked], np.int64), {t: (np.array([a for a, _ in x]), np.array([w for _, w in x])) for t, x in asking.items()}, mean, k)
        tasks = max(1, -(-state["n"] // (self.range_chunks * TASK_RANGES)))
        shard = F.pmod(F.xxhash64("segment", "range"), F.lit(tasks)).cast("int").alias("shard")
        rows = blocks.select(shard, F.xxhash64("segment", "range").alias("range"), "term", "chunk_ids", "tfs", "lengths", "max_tf", "min_length")
        return rows.groupBy("shard").applyInArrow(run, "qid long, chunk_id long, bm25_score double")


_HITS = pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), ("bm25_score", pa.float64())])


def _best_of_ranges(qids: np.ndarray, asking: dict[str, tuple[np.ndarray, np.ndarray]], mean: float, k: int):
    """The best k chunks of a task's ranges for each question. A range is scored only for questions that its bounds leave open."""

    def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column(name).combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False), flat.offsets.to_numpy()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        terms, ranges = table.column("term").to_pylist(), table.column("range").to_numpy()
        (ids, edge), (tfs, _), (lengths, _) = (lists(table, c) for c in ("chunk_ids", "tfs", "lengths"))
        edge = edge - edge[0] if len(edge) else edge
        bounds = _impact(table.column("max_tf").to_numpy(), table.column("min_length").to_numpy(), mean)
        impacts = _impact(tfs, lengths, mean)
        starts = np.flatnonzero(np.diff(ranges, prepend=ranges[0] - 1)) if len(ranges) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(ranges))
        # What each range can give to each question.
        most = np.zeros((len(starts), len(qids)))
        for r, (a, b) in enumerate(zip(starts, stops, strict=True)):
            for i in range(a, b):
                q, w = asking[terms[i]]
                most[r, q] += np.maximum(w, 0) * bounds[i]
        least = np.zeros(len(qids))  # the k-th score found so far
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in qids]
        for r in np.argsort(-most.sum(1), kind="stable"):
            open_ = np.flatnonzero((most[r] > 0) & (most[r] + 1e-8 >= least))
            if not len(open_):
                continue
            at = np.full(len(qids), -1)
            at[open_] = np.arange(len(open_))
            a, b = starts[r], stops[r]
            chunk, place = np.unique(ids[edge[a] : edge[b]], return_inverse=True)
            scores = np.zeros((len(open_), len(chunk)))
            for i in range(a, b):
                q, w = asking[terms[i]]
                q, w = at[q], w[at[q] >= 0]
                q = q[q >= 0]
                if len(q):
                    scores[np.ix_(q, place[edge[i] - edge[a] : edge[i + 1] - edge[a]])] += np.outer(w, impacts[edge[i] : edge[i + 1]])
            for row, q in zip(scores, open_, strict=True):
                some = np.flatnonzero(row > 0)
                c, s = np.concatenate((best[q][0], chunk[some])), np.concatenate((best[q][1], row[some]))
                if len(s) > k:
                    keep = np.lexsort([c, -np.round(s, 9)])[:k]
                    c, s = c[keep], s[keep]
                    least[q] = s.min()
                best[q] = c, s
        sizes = [len(c) for c, _ in best]
        return pa.table([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([c for c, _ in best])), pa.array(np.concatenate([s for _, s in best]))], schema=_HITS)

    return run
