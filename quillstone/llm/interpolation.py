"""Deleted interpolation: an n-gram model whose mixture weights come from held-out counts.

Maximum-likelihood estimates of orders 1 to n and the uniform one are mixed. The weights depend on
the bucket of the longest context that was seen: its order and the power of two of its count. A tenth
of the training documents is deleted from the counts, and expectation-maximisation fits the weights
of each bucket to it; the counts of all training documents then go into the scores.

Documents are packed into blocks where they lie, once. A block sends its distinct n-grams by ranges of their hash
(common.py), a range adds the counts of all blocks, and the counts return to the block, where the
scores are made. So texts move once, compressed, and a frequent document or n-gram is nowhere a frequent key. Nothing that grows with the corpus is broadcast or collected: the driver sees sums
by bucket, a few hundred numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Kinds of blocks: training documents that stay in the counts, that are deleted for the weights, and others.
KEPT, DELETED, HELD_OUT = 0, 1, 2
#: Longer n-grams are named by the first 56 bits of their hash: a byte less to send of each.
_LONGER = ~np.uint64(0xFF)
#: Bytes of text in a block: a worker holds some twenty times as much while it counts.
BLOCK_BYTES = 6 << 20
#: Tokens whose weights are laid out at once.
STRETCH = 1 << 17
_END, _BEGIN = b"\n", b"\n\n"  # no word holds a line break

_CELLS = pa.schema([("range_id", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_COUNTED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range_id", pa.int32()), ("total", pa.binary()), ("deleted", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_kept", pa.int64())])
_ROWS = pa.schema([("buckets", pa.binary()), ("parts", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Block:
    """The n-grams of a block's documents; the same for the same set of documents in any order."""

    def __init__(self, row: dict, order: int) -> None:
        self.doc_ids, self.null_ids, texts = C.block_rows(row)
        self.kind = row["kind"]
        vocabulary = C.Vocabulary(_END, _BEGIN)
        pad = max(1, order - 1)
        flat: list[np.ndarray] = []
        begin, end = np.full(pad, 1, np.int32), np.zeros(1, np.int32)
        self.lengths = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            ids = vocabulary.encode(C.words_of(text, lower=True))
            self.lengths[k] = len(ids) + 1
            flat += (begin, ids, end)
        ids = np.concatenate(flat)
        del texts, flat
        hashes = vocabulary.hashes()[ids]
        self.places = np.flatnonzero(ids != 1)
        del vocabulary, ids
        #: For each order: its distinct hashes, and the index of each place's n-gram in them.
        self.distinct: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        for n in range(1, order + 1):
            own = C.grams(hashes, n)[self.places]
            if n > 1:
                own &= _LONGER
            distinct, index = np.unique(own, return_inverse=True)
            del own
            self.distinct.append(distinct)
            self.index.append(index.astype(np.uint32))
        #: Whether the token before belongs to the text: else the context is the text's begin.
        first = np.cumsum(self.lengths) - self.lengths
        self.inner = np.ones(len(self.places), bool)
        self.inner[first] = False

    def parts(self, counts: list[np.ndarray], n_tokens: int, n_words: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's bucket, and its estimates from the uniform one up to the highest order.

        counts: by order, those of the distinct n-grams. n_docs: how often a begin is followed by a token.
        """
        parts = np.zeros((len(self.places), len(counts) + 1), np.float64)
        parts[:, 0] = 1.0 / (n_words + 1)
        buckets = np.zeros(len(self.places), np.int64)
        if n_tokens:
            parts[:, 1] = counts[0][self.index[0]] / n_tokens
            buckets[:] = 1
        for n in range(2, len(counts) + 1):
            before = np.full(len(self.places), n_docs, np.float64)
            shorter = counts[n - 2][self.index[n - 2]]
            before[1:][self.inner[1:]] = shorter[:-1][self.inner[1:]]
            seen = before > 0
            parts[seen, n] = counts[n - 1][self.index[n - 1]][seen] / before[seen]
            buckets[seen] = 64 * (n - 1) + np.log2(before[seen]).astype(np.int64)
        return buckets, parts


def _send(order: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            for row in data.to_pylist():
                block = _Block(row, order)
                for n, (distinct, index) in enumerate(zip(block.distinct, block.index, strict=True)):
                    counts = np.bincount(index, minlength=len(distinct)).astype(np.uint64)
                    at = C.cut(distinct, ranges)
                    parts = [(int(r), slice(at[r], at[r + 1])) for r in np.flatnonzero(np.diff(at))]
                    yield from C.arrow(_CELLS, [(n * ranges + r, row["block"], block.kind, C.pack_sorted(distinct[part]), b"" if block.kind == HELD_OUT else C.pack(counts[part])) for r, part in parts]).to_batches()

    return run


def _count(ranges: int):
    def run(group: pa.Table) -> pa.Table:
        cells = list(zip(*(group.column(c).to_pylist() for c in ("block", "kind", "hashes", "counts")), strict=True))
        hashes = [C.unpack_sorted(h) for _, _, h, _ in cells]
        at = np.cumsum([0, *map(len, hashes)])
        distinct, index = np.unique(np.concatenate(hashes), return_inverse=True)
        total, deleted = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
        for k, (_, kind, _, counts) in enumerate(cells):
            if kind != HELD_OUT:
                own, add = index[at[k] : at[k + 1]], C.unpack(counts, np.uint64)
                total[own] += add  # a cell's hashes are distinct
                if kind == DELETED:
                    deleted[own] += add
        range_id = group.column("range_id")[0].as_py()
        rows = [(block, kind, range_id, C.pack(total[own]), C.pack(deleted[own]) if kind == DELETED else b"", None, None, None) for k, (block, kind, _, _) in enumerate(cells) for own in [index[at[k] : at[k + 1]]]]
        if range_id < ranges:
            rows.append((None, None, range_id, b"", b"", int(total.sum()), int((total > 0).sum()), int((total - deleted).sum())))
        return C.arrow(_COUNTED, rows)

    return run


def _returned(cells: pa.Table, order: int, ranges: int, column: str) -> list[np.ndarray]:
    """The counts by order, as they lie in the block's distinct n-grams."""
    found = sorted(zip(cells.column("range_id").to_pylist(), cells.column(column).to_pylist(), strict=True))
    return [np.concatenate([np.zeros(0, np.uint64), *(C.unpack(data, np.uint64) for r, data in found if r // ranges == n)]).astype(np.float64) for n in range(order)]


def _held_out_rows(order: int, ranges: int, n_tokens: int, n_words: int, n_docs: int):
    def run(blocks: pa.Table, cells: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            block = _Block(row, order)
            total, deleted = (_returned(cells, order, ranges, c) for c in ("total", "deleted"))
            buckets, parts = block.parts([t - d for t, d in zip(total, deleted, strict=True)], n_tokens, n_words, n_docs)
            rows.append((C.pack(buckets.astype(np.uint16)), C.pack_bytes(parts.astype(np.float32).tobytes())))
        return C.arrow(_ROWS, rows)

    return run


class Weights:
    """Mixture weights by bucket; a bucket without held-out tokens takes those of the next lower one of its order."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.known: dict[int, np.ndarray] = {}

    def usable(self, bucket: int) -> int:
        """How many estimates a bucket has: the uniform one, the words', and one more for each longer context."""
        return min(self.order, bucket // 64 + 1) + 1 if bucket else 1

    def of(self, bucket: int) -> np.ndarray:
        for b in range(bucket, bucket // 64 * 64 - 1, -1):
            if b in self.known:
                return self.known[b]
        out = np.zeros(self.order + 1)
        out[: self.usable(bucket)] = 1 / self.usable(bucket)
        return out

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        distinct, index = np.unique(buckets, return_inverse=True)
        return np.array([self.of(int(b)) for b in distinct]).reshape(-1, self.order + 1)[index]


def _shares(weights: Weights):
    """One step of expectation: what each estimate of each bucket has done for the held-out tokens."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("share", pa.float64()), ("log", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((64 * weights.order, weights.order + 1))
        logs = 0.0
        for data in batches:
            for b, p in zip(data.column("buckets").to_pylist(), data.column("parts").to_pylist(), strict=True):
                buckets = C.unpack(b, np.uint16).astype(np.int64)
                each = weights.rows(buckets) * np.frombuffer(C.unpack_bytes(p), np.float32).reshape(len(buckets), -1)
                whole = each.sum(axis=1)
                logs += float(np.log(whole).sum())
                for k in range(weights.order + 1):
                    sums[:, k] += np.bincount(buckets, each[:, k] / whole, len(sums))
        rows = [(int(b), k, float(sums[b, k]), 0.0) for b in np.flatnonzero(sums.sum(axis=1)) for k in range(weights.order + 1)]
        yield from C.arrow(schema, [*rows, (-1, 0, 0.0, logs)]).to_batches()

    return run


def fit(rows: DataFrame, order: int, most_steps: int = 15, enough: float = 1e-4) -> Weights:
    """Weights by expectation-maximisation over the held-out rows, until a step gains less than enough a token."""
    weights, before = Weights(order), -math.inf
    for _ in range(most_steps):
        found = rows.mapInArrow(_shares(weights), "bucket int, part int, share double, log double").groupBy("bucket", "part").agg(F.sum("share").alias("share"), F.sum("log").alias("log")).collect()
        shares: dict[int, np.ndarray] = {}
        for r in found:
            if r["bucket"] >= 0:
                shares.setdefault(r["bucket"], np.zeros(order + 1))[r["part"]] = r["share"]
        log, n = sum(r["log"] for r in found), sum(s.sum() for s in shares.values())
        for b, s in shares.items():
            s = s.copy()
            s[: weights.usable(b)] += 0.5  # no estimate is ruled out
            weights.known[b] = s / s.sum()
        if not n or (log - before) / n < enough:
            break
        before = log
    return weights


def _score(order: int, ranges: int, n_tokens: int, n_words: int, n_docs: int, weights: Weights):
    def run(blocks: pa.Table, cells: pa.Table) -> pa.Table:
        tables = [_SCORES.empty_table()]
        for row in blocks.to_pylist():
            block = _Block(row, order)
            del block.distinct
            counts = _returned(cells, order, ranges, "total")
            buckets, parts = block.parts(counts, n_tokens, n_words, n_docs)
            logs = np.concatenate([np.log10((weights.rows(buckets[k : k + STRETCH]) * parts[k : k + STRETCH]).sum(axis=1)) for k in range(0, len(buckets), STRETCH)])
            del buckets, parts
            words = counts[0][block.index[0]]
            base = np.log10((words + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
            first = np.cumsum(block.lengths) - block.lengths
            add = lambda x, first=first: np.add.reduceat(x, first)  # noqa: E731  each text has its end at least
            n = len(first)
            ids = pa.array(block.doc_ids, mask=block.null_ids.astype(bool))
            tables.append(pa.table([ids, pa.array(np.full(n, block.kind == HELD_OUT)), pa.array(block.lengths), pa.array(add((words > 0).astype(np.int64))), pa.array(np.full(n, n_tokens)), pa.array(add(base)), pa.array(add(logs))], schema=_SCORES))
        return pa.concat_tables(tables)

    return run


def score_documents(docs: DataFrame, order: int = 3, block_bytes: int = BLOCK_BYTES, range_entries: int = C.RANGE_ENTRIES) -> DataFrame:
    """Log10 probability of every document under a model of those whose id hash is not 1 in 5.

    Tokens are the words of the text with A-Z in lower case, then one end. A null or empty text is the
    end alone; a null id counts as training; equal rows are documents of their own, and so are rows
    that share an id. Without training documents every token has the uniform probability 1. An empty
    table gives no rows. Texts of any length are scored whole; one longer than a block is a block. Columns other
    than doc_id and text are not read. Counts have 64 bits. Words are named by 64-bit hashes, longer n-grams by 56-bit ones.

    order: the longest n-gram. Disk for the exchange grows with it: about 8 bytes for each distinct n-gram of a block.
    """
    C.bounded_batches(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession)
    crc = C.id_bucket(F.col("doc_id"))
    kind = F.when(crc % 5 == 1, F.lit(HELD_OUT)).when(F.floor(crc / 5) % 10 == 0, F.lit(DELETED)).otherwise(F.lit(KEPT))
    rows = C.documents(docs).withColumn("kind", kind)
    blocks = scratch.keep(rows.mapInArrow(C.to_blocks(block_bytes), C.BLOCK_SCHEMA), "blocks")
    n_blocks = max(1, blocks.count())
    sizes = {r["kind"]: r for r in rows.groupBy("kind").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    n_docs = {k: sizes[k]["rows"] if k in sizes else 0 for k in range(3)}
    n_bytes = sum((r["bytes"] or 0) + 8 * r["rows"] for r in sizes.values())
    ranges = max(4, math.ceil(n_bytes / 6 / range_entries))

    cells = blocks.mapInArrow(_send(order, ranges), "range_id int, block long, kind int, hashes binary, counts binary").repartition(4 * order * ranges, "range_id")
    counted = scratch.keep(cells.groupBy("range_id").applyInArrow(_count(ranges), "block long, kind int, range_id int, total binary, deleted binary, n long, v long, n_kept long"), "ngrams")
    sums = counted.where("block IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("n_kept").alias("n_kept")).first()
    n_tokens, n_words, n_kept = (int(sums[c] or 0) for c in ("n", "v", "n_kept"))

    def with_counts(which: str, run, schema: str) -> DataFrame:
        """run on each block together with its counts."""
        own, back = (t.where(f"block IS NOT NULL AND {which}").repartition(n_blocks, "block").groupBy("block") for t in (blocks, counted))
        return own.cogroup(back).applyInArrow(run, schema)

    held_out = scratch.keep(with_counts(f"kind = {DELETED}", _held_out_rows(order, ranges, n_kept, n_words, n_docs[KEPT]), "buckets binary, parts binary"), "held-out")
    weights = fit(held_out, order)
    scratch.drop(held_out)
    scores = scratch.keep(with_counts("true", _score(order, ranges, n_tokens, n_words, n_docs[KEPT] + n_docs[DELETED], weights), SCORE_SCHEMA), "scores")
    scratch.drop_but(scores)
    return scores
