"""Hard negatives by exact integer scores: matrix products modulo small primes.

Vectors become integers, floor(256 x). A product of two integer matrices is computed modulo a few primes below 256, each as
one float32 product: residues lie around zero, so a sum over 1,024 components stays below 2^24, which float32 holds exactly
in whatever order it is summed. Residues are put together by Chinese remaindering in mixed radix with digits around
zero, which gives signed scores. How many primes a product needs follows from the norms in it: a score is at most their product.

Anchors are a stated query set. Anchors are cut into slices, rows into groups, both by hash and of a bounded size; each pair of slice and
group is one cell, computed by one task, and returns a few best rows an anchor. A window over what the cells return
selects: first the positives, then, with their scores known, the negatives below each. The anchors and
rows that a cell gets are bounded, whatever the label of a row or how often a vector occurs.

Rows with a null label, a null vector, a null or non-finite component take no part, nor do those whose integer norm is 2^31 or more (their scores need not
fit a long). A vector that is shorter than another counts as filled with zeros. A null vec_id is never an anchor and comes last among ties; rows
that share an id are rows of their own, and only an anchor's own row is no positive of it. Between rows
equal in score and id no order is defined, nor needed: what is returned is the same. An empty table or one without anchors gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
#: Positives of an anchor, negatives of each, at most.
POSITIVES, NEGATIVES = 5, 5
#: A negative has at least 4 / 5 of the positive's score.
LEAST = (4, 5)
#: Bytes of vectors in a slice of anchors and in a group of rows, about.
SLICE_BYTES, GROUP_BYTES = 2 << 20, 8 << 20
#: Scores that are computed at once, at most.
TILE = 1 << 21

#: The largest primes below 256.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
#: Components whose products float32 sums exactly: 1,024 * 125^2 < 2^24.
_EXACT = 1024
#: Norm from which a row takes no part.
_NORM = 2.0**31


# --- exact products --------------------------------------------------------------------------


def primes_for(bound: float) -> tuple[int, ...]:
    """So many primes that numbers from -bound to bound have residues of their own."""
    product = 1
    for k, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound + 2:
            return PRIMES[: k + 1]
    raise ValueError("scores of 2^62 and more")


def residues(vectors: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo p, around zero, as float32."""
    rest = np.mod(vectors, p)
    return np.where(rest > p // 2, rest - p, rest).astype(np.float32)


def _around_zero(values: np.ndarray, p: int) -> np.ndarray:
    values = np.mod(values, p)
    return values - p * (values > p // 2)


def remaindered(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed numbers of these residues: mixed radix with digits around zero (Garner)."""
    total, weight = parts[0].astype(np.int64), 1
    for k in range(1, len(primes)):
        weight *= primes[k - 1]
        p = primes[k]
        digit = _around_zero((parts[k].astype(np.int64) - np.mod(total, p)) * pow(weight, -1, p), p)
        total = total + digit * np.int64(weight)
    return total


class Residues:
    """Integer vectors by their residues modulo the primes."""

    def __init__(self, primes: tuple[int, ...], parts: list[np.ndarray]) -> None:
        self.primes, self.parts = primes, parts

    def some(self, which: np.ndarray | slice) -> Residues:
        return Residues(self.primes, [x[which] for x in self.parts])

    def scores(self, other: Residues, rows: slice) -> np.ndarray:
        """Inner products of all vectors with these rows of the other's."""
        found = []
        for p, a, b in zip(self.primes, self.parts, other.parts, strict=True):
            total = np.zeros((len(a), len(b[rows])), np.int32)
            for k in range(0, a.shape[1], _EXACT):
                product = a[:, k : k + _EXACT] @ b[rows, k : k + _EXACT].T
                total = _around_zero(total + product.astype(np.int32), p)
            found.append(total)
        return remaindered(found, self.primes)


def _norm(vectors: np.ndarray) -> float:
    return float(np.sqrt(np.square(vectors.astype(np.float64)).sum(1).max(initial=0))) * (1 + 1e-9)


def _both(anchors: np.ndarray, rows: np.ndarray) -> tuple[Residues, Residues]:
    primes = primes_for(_norm(anchors) * _norm(rows))
    return Residues(primes, [residues(anchors, p) for p in primes]), Residues(primes, [residues(rows, p) for p in primes])


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """Vectors of a table as a matrix, filled with zeros up to the width."""
    flat = table.column("vector").combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables), default=0)


def _sorted_rows(rows: pa.Table) -> pa.Table:
    """By label, then id, null ids last: the earlier of two equal scores is the one that comes first."""
    return rows.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])


# --- one cell --------------------------------------------------------------------------------

_FOUND = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SCHEMA = "anchor long, anchor_id long, nth int, vec_id long, score long"


def _best_positives(count: int):
    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The best rows of each anchor's label, its own row left out."""
        if not anchors.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        rows, width = _sorted_rows(rows), _width(anchors, rows)
        ids, numbers, labels = rows.column("vec_id"), rows.column("row").to_numpy(), rows.column("label").to_numpy()
        a, b = _both(_matrix(anchors, width), _matrix(rows, width))
        own, wanted, own_ids = anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), anchors.column("vec_id").to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for label in np.unique(wanted):
            first, last = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
            mine = np.flatnonzero(wanted == label)
            if first == last:
                continue
            step = max(1, TILE // int(last - first))
            for k in range(0, len(mine), step):
                some = mine[k : k + step]
                scores = a.some(some).scores(b, slice(first, last))
                scores[own[some][:, None] == numbers[first:last]] = np.iinfo(np.int64).min
                for _ in range(min(count, int(last - first))):
                    at = scores.argmax(1)
                    best = scores[np.arange(len(some)), at]
                    there = best > np.iinfo(np.int64).min
                    found.append((some[there], first + at[there], best[there]))
                    scores[np.arange(len(some)), at] = np.iinfo(np.int64).min
        if not found:
            return _FOUND.empty_table()
        who, where, best = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(own[who]), pa.array(own_ids[who]), pa.nulls(len(who), pa.int32()), ids.take(pa.array(where)).combine_chunks(), pa.array(best)], schema=_FOUND)

    return run


def _best_negatives(count: int, least: tuple[int, int]):
    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """For each anchor and positive the best rows of other labels from its least score up to the positive's."""
        if not anchors.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        rows, width = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")]), _width(anchors, rows)
        ids, labels = rows.column("vec_id"), rows.column("label").to_numpy()
        a, b = _both(_matrix(anchors, width), _matrix(rows, width))
        own, own_labels, own_ids = anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), anchors.column("vec_id").to_numpy()
        wanted = anchors.column("positives").to_pylist()
        lowest = [[-((-least[0] * p) // least[1]) for p in ps] for ps in wanted]
        top, bottom = np.array([max(ps) for ps in wanted]), np.array([min(ps) for ps in lowest])
        who, nth, where, best = [], [], [], []
        step = max(1, TILE // len(labels))
        for k in range(0, len(own), step):
            here = slice(k, k + step)
            scores = a.some(here).scores(b, slice(None))
            near = (scores <= top[here, None]) & (scores >= bottom[here, None]) & (own_labels[here, None] != labels)
            for i in range(len(scores)):
                at = np.flatnonzero(near[i])
                at = at[np.argsort(-scores[i, at], kind="stable")]
                down = -scores[i, at]
                for j, (p, low) in enumerate(zip(wanted[k + i], lowest[k + i], strict=True)):
                    first = int(np.searchsorted(down, -p, "left"))
                    last = min(first + count, int(np.searchsorted(down, -low, "right")))
                    for x in range(first, last):
                        who.append(k + i)
                        nth.append(j + 1)
                        where.append(at[x])
                        best.append(-down[x])
        if not who:
            return _FOUND.empty_table()
        return pa.table([pa.array(own[who]), pa.array(own_ids[who]), pa.array(nth, pa.int32()), ids.take(pa.array(where)).combine_chunks(), pa.array(best, pa.int64())], schema=_FOUND)

    return run


# --- all cells -------------------------------------------------------------------------------


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (integers) of the rows that take part."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))
    bad = F.exists(F.col("embedding").cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**31 / SCALE))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector")).filter(norm < _NORM)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: tuple[int, int] = LEAST, slice_bytes: int = SLICE_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """rows (vec_id, label, vector of integers). For each anchor and positive: anchor_id, positive_id, nth (of the positive), rank, negative_id, positive_score, negative_score.

    least (a, b): a negative has a / b of the positive's score at least, compared as integers.
    """
    spark = rows.sparkSession
    scratch = C.Scratch(spark)
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    size = F.sum(F.size("vector").cast("long") * 8 + 32)
    total = rows.agg(size.alias("rows"), F.sum(F.when(is_anchor, F.size("vector").cast("long") * 8 + 32)).alias("anchors")).first()
    slices = C.block_count(total["anchors"], 0, slice_bytes)
    groups = max(C.block_count(total["rows"], 0, group_bytes), min(spark.sparkContext.defaultParallelism, C.block_count(total["rows"], 0, 1 << 20)))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    anchors = rows.filter(is_anchor)
    cells = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: s * groups + part(groups))))
    of_anchor = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: part(slices) * groups + g))

    def met(some: DataFrame, run) -> DataFrame:
        some = some.withColumn("cell", of_anchor)
        some = some.select(*(F.col(c).alias(c) for c in some.columns))  # columns of its own: both sides come from one table
        return some.groupBy("cell").cogroup(cells.groupBy("cell")).applyInArrow(run, FOUND_SCHEMA)

    best = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = met(anchors, _best_positives(positives)).drop("nth").withColumn("nth", F.row_number().over(best("anchor"))).filter(F.col("nth") <= positives)
    found = scratch.keep(found, "negatives-positives")
    scores = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("positives"))
    some = anchors.join(scores, F.col("row") == F.col("anchor")).drop("anchor").withColumn("positives", F.transform("positives", lambda p: p["score"]))
    ranked = met(some, _best_negatives(negatives, least)).withColumn("rank", F.row_number().over(best("anchor", "nth"))).filter(F.col("rank") <= negatives)
    ranked = ranked.select("anchor", "nth", "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = found.select("anchor", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(of, ["anchor", "nth"]).select("anchor_id", "positive_id", "nth", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
