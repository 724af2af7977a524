"""Quality rules, and an isolation forest over their statistics.

The rules reject a document outright. The forest judges the others by the statistics as they are. Its trees hold
documents labelled good; their random splits range over all labelled documents. A document like few good ones is set
apart from them by few splits: it has a short mean path and a high anomaly score. Of all labelled documents one half, dealt
by a hash, grows the trees (each draws its own 256 of all good ones there, as the method has it) and the other, left out there,
calibrates: the threshold is the highest one that rejects as many of its documents labelled bad as any that rejects no more
than a given share of its good ones. All statistics are taken over whole texts of all documents, in one pass
without moving rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Share of the documents labelled good that the forest may reject.
MOST_GOOD_REJECTED = 0.005
TREES, SUBSAMPLE, DEPTH = 100, 256, 16
#: Bins of a pass that looks for a score by its rank, and scores that are sorted at once, at most.
BINS, SORTED = 1024, 10_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "distinct")
_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in STATISTICS), ("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())])
RESULT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


def statistics(texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rules' counts of each text, and its features for the forest."""
    n = len(texts)
    texts = [t or b"" for t in texts]
    whole = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.cumsum([0, *map(len, texts)])
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[edges])
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    dup_lines, n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        n_lines[k], dup_lines[k] = len(lines), len(lines) - len(set(lines))
    vocabulary = C.Vocabulary()
    ids = np.concatenate([np.zeros(0, np.int32), *(vocabulary.encode(w) for w in words)])
    doc = np.repeat(np.arange(n), n_words)
    repeated = np.zeros(len(ids), bool)
    distinct = np.zeros(n)
    if len(ids):
        h = vocabulary.hashes()[ids]
        own = C.scramble(doc.astype(np.uint64) + np.uint64(1))
        distinct = np.bincount((np.unique(doc.astype(np.int64) << 32 | ids)) >> 32, minlength=n).astype(float)
        inside = np.flatnonzero(doc[2:] == doc[:-2]) + 2  # last words of windows
        if len(inside):
            _, index, counts = np.unique((C.grams(h, 3) ^ own)[inside], return_inverse=True, return_counts=True)
            last = inside[counts[index] > 1]
            for back in range(3):
                repeated[last - back] = True
    counts = {
        "n_words": n_words,
        "word_chars": total(~_SPACE[whole] & ~_CONTINUES[whole]),
        "n_symbols": total(_SYMBOL[whole]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(doc, repeated, n).astype(np.int64),
    }
    per = lambda x, by: x / np.maximum(by, 1)
    features = np.stack([
        per(counts["word_chars"], n_words), per(counts["n_symbols"], n_words), per(dup_lines, n_lines), per(counts["n_repeat_words"], n_words),
        per(distinct, n_words),
    ], axis=1)
    return counts, features


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _usual_path(n: float) -> float:
    """Mean path of an unsuccessful search in a random tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation forest; all trees as arrays of nodes, so that a batch descends all of them together."""

    def __init__(self, points: np.ndarray | list[np.ndarray], low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = 0) -> None:
        """points: what others are set apart from, or a list of each tree's own; low, high: the ranges in which random splits fall."""
        rng = np.random.default_rng(seed)
        drawn = points if isinstance(points, list) else None
        size = len(drawn[0]) if drawn else min(subsample, len(points))
        self.depth = depth
        self.usual = _usual_path(size) or 1.0
        nodes: list[list[float]] = []  # feature (-1: leaf), split, left, right, path
        self.roots = []
        for tree in range(len(drawn) if drawn else trees):
            self.roots.append(len(nodes))
            todo = [(len(nodes), drawn[tree] if drawn else points[rng.choice(len(points), size, replace=False)], low, high, 0)]
            nodes.append([])
            while todo:
                at, own, a, b, level = todo.pop()
                wide = np.flatnonzero(b > a)
                if len(own) <= 1 or level >= depth or not len(wide):
                    nodes[at] = [-1, 0, at, at, level + _usual_path(len(own))]
                    continue
                f = int(rng.choice(wide))
                split = float(rng.uniform(a[f], b[f]))
                below = own[:, f] <= split
                nodes[at] = [f, split, len(nodes), len(nodes) + 1, 0]
                at_f = np.arange(len(a)) == f
                todo += [(len(nodes), own[below], a, np.where(at_f, split, b), level + 1), (len(nodes) + 1, own[~below], np.where(at_f, split, a), b, level + 1)]
                nodes += [[], []]
        table = np.array(nodes)
        self.feature, self.left, self.right = (table[:, k].astype(np.int32) for k in (0, 2, 3))
        self.split, self.path = table[:, 1], table[:, 4]

    def scores(self, points: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over the usual one: near 1 if set apart at once, low if usual."""
        at = np.tile(np.array(self.roots, np.int32), (len(points), 1))
        row = np.arange(len(points))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(f < 0, at, np.where(points[row, f] <= self.split[at], self.left[at], self.right[at]))
        return 2.0 ** (-self.path[at].mean(axis=1) / self.usual)


def threshold(scores: np.ndarray, good: np.ndarray, most_good_rejected: float) -> float:
    """The score above which documents are rejected, halfway from the lowest bad one that is down to what is kept below it."""
    kept = np.sort(scores[good])
    lowest = kept[len(kept) - 1 - int(most_good_rejected * len(kept))]
    rejected = np.sort(scores[~good][scores[~good] > lowest])
    return float(lowest) if not len(rejected) else float((rejected[0] + kept[kept < rejected[0]].max(initial=lowest)) / 2)


class Judge:
    """A forest and the score above which it rejects; without a forest it rejects nothing."""

    def __init__(self, forest: Forest | None = None, threshold: float = math.inf) -> None:
        self.forest, self.threshold = forest, threshold

    def scores(self, points: np.ndarray) -> np.ndarray:
        return self.forest.scores(points) if self.forest and len(points) else np.zeros(len(points))


_MEASURED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in STATISTICS), ("base_failed", pa.bool_()), ("features", pa.list_(pa.float64()))])
_MEASURED_SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in STATISTICS)}, base_failed boolean, features array<double>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data in batches:
        counts, features = statistics(data.column("text").to_pylist())
        yield C.batch(_MEASURED, data.column("doc_id"), *(counts[c] for c in STATISTICS), base_failed(counts), features.tolist())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, STATISTICS, base_failed and features of every row, in one pass over the texts."""
    return C.documents(docs).mapInArrow(_measure, _MEASURED_SCHEMA)


def _points(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_FEATURES))


def _drawn(trees: int, size: int):
    """A task's first rows for each tree, in an order of the tree's own."""
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, keys = np.zeros(0, np.int64), np.zeros((0, len(_FEATURES))), np.zeros((trees, 0), np.int64)
        firsts = [(keys[0], ids, points) for _ in range(trees)]
        for data in batches:
            ids, points = data.column("doc_id").to_numpy(), _points(data.column("features"))
            for t in range(trees):
                key = (C.scramble(ids.astype(np.uint64) ^ C.scramble(np.full(len(ids), t + 1, np.uint64))) >> np.uint64(1)).astype(np.int64)
                k, i, p = firsts[t]
                k, i, p = np.concatenate((k, key)), np.concatenate((i, ids)), np.concatenate((p, points))
                first = np.lexsort([i, k])[:size]
                firsts[t] = k[first], i[first], p[first]
        for t, (k, i, p) in enumerate(firsts):
            yield C.batch(schema, np.full(len(k), t, np.int32), k, i, p.tolist())

    return run


def _scored(judge: Judge):
    schema = pa.schema([("good", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            yield C.batch(schema, data.column("good"), judge.scores(_points(data.column("features"))))

    return run


def nth_largest(scores: DataFrame, n: int, bins: int = BINS, most: int = SORTED) -> float:
    """The score (not null) that n others precede from the largest on, exactly: bins are counted, and the one that holds it is cut again until it is small."""
    low, high, count = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    while low < high and count > most:
        at = F.floor((F.col("score") - low) * (bins / (high - low)))
        found = scores.where(F.col("score").between(low, high)).groupBy(at.alias("at")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
        for r in sorted(found.collect(), key=lambda r: -r["at"]):  # one row a bin
            if n < r["n"]:
                low, high, count = r["low"], r["high"], r["n"]
                break
            n -= r["n"]
    if low == high:
        return low
    return sorted((r["score"] for r in scores.where(F.col("score").between(low, high)).collect()), reverse=True)[n]


def threshold_of(scores: DataFrame, most_good_rejected: float, bins: int = BINS, most: int = SORTED) -> float:
    """threshold() of a table (good, score): no list of scores is collected."""
    good, bad = scores.where("good"), scores.where("NOT good")
    n = good.count()
    lowest = nth_largest(good, int(most_good_rejected * n), bins, most)
    rejected = bad.where(F.col("score") > lowest).agg(F.min("score")).first()[0]
    if rejected is None:
        return lowest
    below = good.where((F.col("score") < rejected) & (F.col("score") > lowest)).agg(F.max("score")).first()[0]
    return (rejected + (lowest if below is None else below)) / 2


def fit(docs: DataFrame, labels: DataFrame, most_good_rejected: float = MOST_GOOD_REJECTED) -> Judge:
    """A judge from all labelled documents. Without labelled documents of both kinds in each half it rejects nothing.

    A document is good if every label of it has quality 1; labels without id or quality are left out. Of several rows
    with one id that with the smallest statistics counts. Documents that the rules reject aren't used: the forest never judges them.
    What reaches the driver is 256 rows a tree and a few sums, however many labels there are.
    """
    scratch = C.Scratch(docs.sparkSession)
    try:
        return _fit(scratch.keep(measured(docs), "measured"), labels, most_good_rejected, scratch)
    finally:
        scratch.drop_but()


def _fit(rows: DataFrame, labels: DataFrame, most_good_rejected: float, scratch: C.Scratch) -> Judge:
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    marks = marks.withColumn("left_out", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 1)
    own = rows.where("NOT base_failed").select("doc_id", "features").join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("features", "good", "left_out")).alias("r"))
    own = scratch.keep(own.select("doc_id", "r.*"), "labelled")
    if own.select("good", "left_out").distinct().count() < 4:
        return Judge()
    grown = own.where("NOT left_out")
    ends = grown.agg(*(f(F.col("features")[k]) for f in (F.min, F.max) for k in range(len(_FEATURES)))).first()
    low, high = np.array(ends[: len(_FEATURES)], float), np.array(ends[len(_FEATURES) :], float)
    drawn = grown.where("good").select("doc_id", "features").mapInArrow(_drawn(TREES, SUBSAMPLE), "tree int, key long, doc_id long, features array<double>")
    first = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("tree").orderBy("key", "doc_id"))).where(F.col("nth") <= SUBSAMPLE)
    of_tree = first.orderBy("tree", "nth").select("tree", "features").toPandas()  # 256 rows a tree
    judge = Judge(Forest([np.array(x.tolist(), float) for _, x in of_tree.groupby("tree")["features"]], low, high))
    scores = scratch.keep(own.where("left_out").select("good", "features").mapInArrow(_scored(judge), "good boolean, score double"), "calibration")
    judge.threshold = threshold_of(scores, most_good_rejected)
    return judge


def _judge(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            failed, scores = data.column("base_failed").to_numpy(zero_copy_only=False), judge.scores(_points(data.column("features")))
            yield C.batch(_RESULT, data.column("doc_id"), *(data.column(c) for c in STATISTICS), failed, scores, ~failed & (scores <= judge.threshold))

    return run


def judge_documents(docs: DataFrame, labels: DataFrame, most_good_rejected: float = MOST_GOOD_REJECTED) -> DataFrame:
    """Statistics, anomaly score and verdict of every row.

    A null or empty text has no words and fails the rules. A null id stays null; equal rows and repeated
    ids are judged each on their own; an empty table gives no rows; without labels of both kinds the
    rules alone decide; a score equal to the threshold is kept. Texts of any length are judged whole. Columns other than doc_id, text and the labels' doc_id and quality are not read.
    """
    C.bounded_batches(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession)
    rows = scratch.keep(measured(docs), "measured")
    judge = _fit(rows, labels, most_good_rejected, scratch)
    scratch.drop_but(rows)
    return rows.mapInArrow(_judge(judge), RESULT_SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, most_good_rejected: float = MOST_GOOD_REJECTED) -> DataFrame:
    """The rows of docs that judge_documents keeps, with all their columns, whatever their names.

    Null and empty texts fail the rules and go; rows with a null id, equal rows and repeated ids are judged each on their
    own; an empty table gives no rows.
    """
    C.bounded_batches(docs.sparkSession)
    judge = fit(docs, labels, most_good_rejected)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            counts, features = statistics(data.column(at).cast(pa.binary()).to_pylist())
            yield data.filter(pa.array(~base_failed(counts) & (judge.scores(features) <= judge.threshold)))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
