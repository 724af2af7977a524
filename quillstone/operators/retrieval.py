"""Ranking of chunks for questions: dense, BM25, fusions, diversification, noise, rerank.

Questions are a stated, bounded set: they are sent to all tasks after a check of their size, and beyond it
they are joined in slices. Chunks are partitioned and scored where they lie; each task keeps its
best k for each question, so that only those are exchanged. All of it is keyed by question, and all
questions are ranked in one plan. Ties go to the smaller chunk id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.relational import owned
from quillstone.sources.store import Store

#: Questions that are sent to every task at once, and their bytes.
QUESTIONS, QUESTION_BYTES = 10_000, 32 << 20
#: Hits that a task holds for a slice of questions, scores that it makes at once, and chunks of a block, at most.
KEPT, TILE, BLOCK = 1 << 20, 1 << 20, 4096
#: Bytes of text that are cut into terms at once, about.
PIECE_BYTES = 1 << 20
K1, B, EPSILON = 1.5, 0.75, 0.25


def _top(scored: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The best k rows of each question with their rank. Each task keeps no more than k before the exchange."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bytes_of(value: object) -> int:
    return len(value) if isinstance(value, (str, bytes)) else 8 if not isinstance(value, (list, tuple)) else 8 * len(value) if value and isinstance(value[0], float) else sum(map(_bytes_of, value))


def in_slices(questions: DataFrame, size: int = QUESTIONS, most_bytes: int = QUESTION_BYTES) -> Iterator[list[Row]]:
    """The rows of a stated question set in slices of a bounded number and size. The set is computed once, and passes by partition by partition."""
    rows: list[Row] = []
    held = 0
    for r in questions.toLocalIterator():
        rows.append(r)
        held += sum(map(_bytes_of, r))
        if len(rows) >= size or held >= most_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to a block of chunks, so that what is done once a block is done seldom."""
    held: list[pa.RecordBatch] = []
    for data in batches:
        held.append(data)
        if sum(map(len, held)) >= BLOCK:
            yield pa.Table.from_batches(held)
            held = []
    if any(map(len, held)):
        yield pa.Table.from_batches(held)


class _Best:
    """The best k chunks of each question that a task has found so far."""

    schema = {name: pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), (name, pa.float64())]) for name in ("dense_score", "bm25_score")}

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.keys, self.found, self.scores = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))

    def add(self, b: int, tile: np.ndarray, chunk: np.ndarray, above: float = -np.inf) -> None:
        """Scores of the questions from b on and of some chunks. Only those above a bound that reach the k-th one found so far are looked at."""
        keys, found, scores, k = self.keys, self.found, self.scores, self.k
        floor = keys[b : b + len(tile), -1]
        if len(chunk) > k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(tile, len(chunk) - k, axis=1)[:, len(chunk) - k])
        q, c = np.nonzero((tile > above) & (tile >= (floor - 2e-9)[:, None]))  # what rounding may lift is kept
        if not len(q):
            return
        own = b + np.unique(q)
        held = np.isfinite(keys[own])
        who = np.concatenate((b + q, np.repeat(own, held.sum(1))))
        key, at, score = (np.concatenate(x) for x in ((np.round(tile[q, c], 9), keys[own][held]), (chunk[c], found[own][held]), (tile[q, c], scores[own][held])))
        order = np.lexsort([at, -key, who])
        who = who[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who, "left")
        best, who, nth = order[nth < k], who[nth < k], nth[nth < k]
        keys[who, nth], found[who, nth], scores[who, nth] = key[best], at[best], score[best]

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        for b in range(0, len(self.ids), max(1, BLOCK // self.k)):
            part = slice(b, b + max(1, BLOCK // self.k))
            held = np.isfinite(self.keys[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[part], held.sum(1))), pa.array(self.found[part][held]), pa.array(self.scores[part][held])], schema=self.schema[name])


def _best_of_task(ids: np.ndarray, matrix: np.ndarray, k: int):
    """A task's best k chunks for each question. Scores are made in tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, k)
        for data in _gathered(batches):
            chunks = data.column("chunk_id").to_numpy()
            vectors = data.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(chunks), -1)
            for a in range(0, len(chunks), BLOCK):
                block, chunk = vectors[a : a + BLOCK].astype(np.float64), chunks[a : a + BLOCK]
                step = max(1, TILE // len(chunk))
                for b in range(0, len(ids), step):
                    best.add(b, matrix[b : b + step] @ block.T, chunk)
        yield from best.rows("dense_score")

    return run


def dense_top_k(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, dense_score, rank: the k chunks with the largest product for each question.

    chunks: chunk_id, vector; questions: qid, vector, of one length, finite and without nulls. A task holds the vectors of a slice of questions,
    k hits of each and one tile of scores, however many chunks and questions there are.
    """
    parts = []
    for own in in_slices(questions.select("qid", "vector"), max(1, min(QUESTIONS, KEPT // k))):
        ids, matrix = np.array([r["qid"] for r in own], np.int64), np.array([r["vector"] for r in own], np.float64)
        parts.append(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector").mapInArrow(_best_of_task(ids, matrix, k), "qid long, chunk_id long, dense_score double"))
    found = reduce(DataFrame.unionByName, parts) if parts else chunks.sparkSession.createDataFrame([], "qid long, chunk_id long, dense_score double")
    return _top(found, "dense_score", k, "chunk_id")


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


_TERM = re.compile(T.TERM)
#: What has a letter of a term in lower case without being one.
_FOREIGN = re.compile("[\u0130\u212a]")


def terms_of(text: str | None) -> list[str]:
    """The terms of a text as T.terms has them: first cut, then in lower case."""
    return _TERM.findall((_FOREIGN.sub("\n", text) if _FOREIGN.search(text) else text).lower()) if text else []


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts reach a bound: what Python makes of a batch is many times its size. A longer text is a piece of its own."""
    for data in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(data.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_BYTES, "right")))
            yield data.slice(start, stop - start)
            start = stop


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk_id", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("length", pa.int32())])
    for data in pieces(batches):
        own = [Counter(_TERM.findall(t.lower())) if t else Counter() for t in data.column("text").to_pylist()]
        sizes, lengths = np.array([len(c) for c in own], np.int64), np.array([c.total() for c in own], np.int32)
        terms, counts = pa.array(list(chain.from_iterable(own)), pa.string()), pa.array(list(chain.from_iterable(c.values() for c in own)), pa.int64())
        yield pa.RecordBatch.from_arrays([data.column("chunk_id").take(pa.array(np.repeat(np.arange(len(own)), sizes))), terms, counts, pa.array(np.repeat(lengths, sizes))], schema=schema)


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, length of chunks (chunk_id, text). A chunk's terms are counted where it lies, over Arrow batches; no row moves."""
    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").mapInArrow(_posted, "chunk_id long, term string, tf long, length int")


def lengths(chunks: DataFrame) -> DataFrame:
    """One row: the number of chunks (chunk_id, text), of those that have terms, and the mean number of terms."""
    size = F.coalesce(F.regexp_count("text", F.lit(T.TERM)), F.lit(0))
    return chunks.agg(F.count("*").alias("n"), F.count_if(size > 0).alias("n_full"), F.avg(size).alias("mean_length"))


def term_statistics(chunks: DataFrame, n: str = "n_full") -> DataFrame:
    """term, df, idf, mean_length over chunks (chunk_id, text): idf below 0 becomes a share of the mean, as usual.

    A chunk's terms are counted where it lies; what is exchanged is a sum for each term and task. n: which of
    the counts of `lengths` is the number of chunks.
    """
    df = postings(chunks).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(lengths(chunks))).withColumn("raw", _idf(F.col(n), F.col("df")))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "mean_length")  # one row


def _piece_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, how many chunks hold each term; in a row without a term how many chunks and terms there are."""
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("length", pa.int64())])
    for data in pieces(batches):
        df: Counter[str] = Counter()
        length = 0
        for text in data.column("text").to_pylist():
            own = terms_of(text)
            length += len(own)
            df.update(set(own))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([len(data), *df.values()], pa.int64()), pa.array([length] + [0] * len(df), pa.int64())], schema=schema)


def _frequencies(chunks: DataFrame, terms: set[str]) -> tuple[int, int, dict[str, int], list[tuple[int, int]]]:
    """Chunks (chunk_id, text) and their terms, the document frequencies of some terms, a stated set, and how many terms have each frequency: no longer than the root of all."""
    wanted = F.broadcast(chunks.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string").withColumn("asked", F.col("term")))  # the terms of one slice of questions
    df = chunks.select("text").mapInArrow(_piece_frequencies, "term string, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    found = df.join(wanted, "term", "left").groupBy(F.col("term").isNull().alias("whole"), "asked", "df", "length").agg(F.count("*").alias("terms")).collect()
    n, length = next(((r["df"], r["length"]) for r in found if r["whole"]), (0, 0))
    return n, length, {r["asked"]: r["df"] for r in found if r["asked"] is not None}, [(r["df"], r["terms"]) for r in found if not r["whole"]]


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term, times: a repeated term counts as often."""
    return questions.select("qid", F.explode(T.terms(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def _best_sparse(questions: list[Row], idf: dict[str, float], mean: float, k: int):
    """A task's best k chunks for each question, by the weights of the terms that questions have. Scores are made in tiles."""
    ids = np.array([q["qid"] for q in questions], np.int64)
    asking: dict[str, list[tuple[int, float]]] = {}
    for at, q in enumerate(questions):
        for t in q["terms"]:
            if t["term"] in idf:
                asking.setdefault(t["term"], []).append((at, t["times"] * idf[t["term"]]))
    place = {t: i for i, t in enumerate(asking)}
    asked = np.array([a for x in asking.values() for a, _ in x], np.int64)
    weight = np.array([w for x in asking.values() for _, w in x])
    sizes = np.array([len(x) for x in asking.values()], np.int64)
    starts = np.cumsum(sizes) - sizes
    step = max(1, TILE // len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, k)
        for data in pieces(batches):
            chunks = data.column("chunk_id").to_numpy()
            hits, totals = [], []
            for at, text in enumerate(data.column("text").to_pylist()):
                own = Counter(terms_of(text))
                totals.append(own.total())
                hits += [(at, place[t], tf) for t, tf in own.items() if t in place]
            chunk, term, tf = np.array(hits, np.int64).reshape(-1, 3).T
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array(totals)[chunk] / mean))
            for a in range(0, len(chunks), step):
                own = slice(*np.searchsorted(chunk, (a, a + step)))
                n = sizes[term[own]]
                each = np.repeat(starts[term[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                width = len(chunks[a : a + step])
                sums = np.bincount(asked[each] * width + np.repeat(chunk[own] - a, n), weight[each] * np.repeat(impact[own], n), len(ids) * width)
                best.add(0, sums.reshape(len(ids), width), chunks[a : a + step], 0.0)
        yield from best.rows("bm25_score")

    return run


def sparse_top_k(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, bm25_score, rank over the whole corpus; scores that aren't above 0 are left out.

    The questions' terms, a stated set, are sent to the chunks in slices of a bounded size: after a pass for their statistics, a chunk is
    scored where it lies for all questions at once, and each task keeps its best k. No posting is exchanged, only the frequencies of pieces.
    """
    asked = question_terms(questions).groupBy("qid").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    parts = []
    for own in in_slices(asked, max(1, min(QUESTIONS, KEPT // k))):
        n, length, df, histogram = _frequencies(rows, {t["term"] for q in own for t in q["terms"]})
        raw = lambda x: math.log(n - x + 0.5) - math.log(x + 0.5)  # noqa: B023, E731
        floor = EPSILON * math.fsum(raw(x) * terms for x, terms in histogram) / max(1, sum(terms for _, terms in histogram))
        idf = {t: raw(x) if raw(x) >= 0 else floor for t, x in df.items()}
        if idf:
            parts.append(rows.mapInArrow(_best_sparse(own, idf, length / n, k), "qid long, chunk_id long, bm25_score double"))
    found = reduce(DataFrame.unionByName, parts) if parts else chunks.sparkSession.createDataFrame([], "qid long, chunk_id long, bm25_score double")
    return _top(found, "bm25_score", k, "chunk_id")


def _candidate_scores(group: pa.Table) -> pa.Table:
    """One question's candidates with their BM25 scores; null where no term of the question is held."""
    own = [Counter(terms_of(t)) for t in group.column("text").to_pylist()]
    df = Counter(chain.from_iterable(own))
    idf = {t: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = EPSILON * sum(idf.values()) / max(1, len(idf))
    mean = sum(c.total() for c in own) / len(own)
    asked = Counter(terms_of(group.column("question")[0].as_py()))
    scores = []
    for c in own:
        held = [(n, idf[t] if idf[t] >= 0 else floor, c[t]) for t, n in asked.items() if t in c]
        scores.append(sum(n * x * tf * (K1 + 1) / (tf + K1 * (1 - B + B * c.total() / mean)) for n, x, tf in held) if held else None)
    return group.drop_columns(["text", "question"]).append_column("bm25_score", pa.array(scores, pa.float64()))


def bm25_over_candidates(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """candidates (qid, chunk_id, dense_score, rank) with bm25_score and sparse_rank, null beyond the best k above 0.

    Statistics are those of each question's candidates alone. Their number is bounded by k for a question, so a
    question's texts are one bounded group; texts that are nobody's candidates aren't cut into terms.
    """
    rows = candidates.join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    rows = rows.select(F.col("qid").cast("long").alias("qid"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("rank").cast("int").alias("rank"), "dense_score", "text", "question")
    joined = rows.groupBy("qid").applyInArrow(_candidate_scores, "qid long, chunk_id long, rank int, dense_score double, bm25_score double")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(F.coalesce("bm25_score", F.lit(0.0)), 9)), "rank")
    joined = joined.withColumn("sparse_rank", F.row_number().over(order))
    counted = (F.coalesce("bm25_score", F.lit(0.0)) > 0) & (F.col("sparse_rank") <= k)
    return joined.withColumn("sparse_rank", F.when(counted, F.col("sparse_rank"))).withColumn("bm25_score", F.when(counted, F.col("bm25_score")))


def _annotated(ranked: DataFrame, label: Column, *keys: str) -> DataFrame:
    return ranked.select(
        *keys, "qid", "chunk_id", F.col("rank").cast("int").alias("rank"), T.rounded(F.col("fused"), 5).alias("fused_score"), T.rounded(F.coalesce("dense_score", F.lit(0.0)), 4).alias("dense_score"),
        T.rounded(F.coalesce("bm25_score", F.lit(0.0)), 4).alias("bm25_score"), label.alias("matched_by"), F.lit(False).alias("injected_noise"),
    )


def _candidates(chunks: DataFrame, questions: DataFrame, k: int, columns: Sequence[str], vector: Column | None) -> tuple[DataFrame, DataFrame]:
    """dense_top_k, and chunk_id and some columns of the chunks that are anyone's candidates, each written once.

    Both are bounded by the questions: the corpus is passed over once for either, and by its size the list of candidates is
    broadcast to the texts, which don't move. vector: what makes the vectors, if chunks have none; it is made anew for candidates only.
    """
    store = Store(questions.sparkSession)
    embed = lambda rows: rows if vector is None else rows.withColumn("vector", vector)
    found = store.once(dense_top_k(embed(chunks), questions, k), "candidates")
    return found, store.once(embed(chunks.join(found.select("chunk_id"), "chunk_id", "left_semi")).select("chunk_id", *columns), "candidate-chunks") if columns else chunks


def search(chunks: DataFrame, questions: DataFrame, mode: str = "hybrid_rrf", dense_k: int = 25, sparse_k: int = 25, final_k: int = 8, rrf_k: int = 60, dense_weight: float = 1.0, sparse_weight: float = 1.0, mmr_lambda: float = 0.5, index=None, vector: Column | None = None) -> DataFrame:
    """Ranked hits of every question: qid, chunk_id, rank, scores, matched_by, injected_noise. `retrieve` does it for one owner.

    chunks: chunk_id, text, vector (or a column that makes it of them); questions: qid, question, vector. An unknown mode is hybrid_rrf.
    index: the chunks' stored index (inverted_index); the sparse mode then reads no chunk.
    """
    if mode == "dense":
        return _annotated(dense_top_k(chunks if vector is None else chunks.withColumn("vector", vector), questions, final_k).withColumns({"fused": F.col("dense_score"), "bm25_score": F.lit(0.0)}), F.lit("semantic"))
    if mode == "sparse":
        found = index.top_k(questions, final_k) if index is not None else sparse_top_k(chunks, questions, final_k)
        return _annotated(found.withColumns({"fused": F.col("bm25_score"), "dense_score": F.lit(0.0)}), F.lit("keyword"))
    candidates, held = _candidates(chunks, questions, dense_k, ["vector" if mode == "mmr" else "text"], vector)
    if mode == "mmr":
        return mmr(candidates, held, final_k, mmr_lambda)
    both = bm25_over_candidates(candidates, held, questions, sparse_k)
    if mode == "hybrid_weighted":
        own = Window.partitionBy("qid")

        def scaled(c: Column) -> Column:
            low, high = F.min(c).over(own), F.max(c).over(own)
            return F.when(high - low < 1e-9, 1.0).otherwise((c - low) / (high - low))

        fused = dense_weight * scaled(F.col("dense_score")) + sparse_weight * scaled(F.coalesce("bm25_score", F.lit(0.0)))
    else:
        fused = dense_weight / (rrf_k + F.col("rank")) + F.coalesce(sparse_weight / (rrf_k + F.col("sparse_rank")), F.lit(0.0))
    ranked = both.withColumn("fused", fused).withColumnRenamed("rank", "dense_rank")
    label = F.when(F.col("sparse_rank").isNotNull(), "both").otherwise("semantic")
    return _annotated(_top(ranked, "fused", final_k, "dense_rank"), label)


#: What a run sets of a search, with the defaults of `search`.
SETTINGS = {"mode": "hybrid_rrf", "dense_k": 25, "sparse_k": 25, "final_k": 8, "rrf_k": 60, "dense_weight": 1.0, "sparse_weight": 1.0, "mmr_lambda": 0.5}
_RUN = "run_id string, mode string, dense_k int, sparse_k int, final_k int, rrf_k int, dense_weight double, sparse_weight double, mmr_lambda double"


def search_all(chunks: DataFrame, questions: DataFrame, runs: dict[str, dict], index=None, vector: Column | None = None) -> DataFrame:
    """search() of many runs (SETTINGS by run_id, a short list) as one plan: the same columns with run_id in front.

    Runs are rows that candidates are joined with. Chunks are ranked once for the largest k, and written; candidates are scored once for each
    dense_k; weights, constants and k are columns of what follows.
    """
    spark = questions.sparkSession
    rows = [(name, *(type(default)((SETTINGS | own)[c]) for c, default in SETTINGS.items())) for name, own in runs.items()]
    at = {c: k + 1 for k, c in enumerate(SETTINGS)}
    of = lambda *modes: [r for r in rows if r[at["mode"]] in modes]
    fused = [r for r in rows if r[at["mode"]] not in ("sparse", "mmr")]
    limit = lambda r: r[at["final_k"] if r[at["mode"]] == "dense" else at["dense_k"]]
    parts = []
    ranked = [*fused, *of("mmr")]
    scored = any(r[at["mode"]] != "dense" for r in fused)
    if ranked:
        candidates, held = _candidates(chunks, questions, max(map(limit, ranked)), [*(["text"] if scored else []), *(["vector"] if of("mmr") else [])], vector)
    if fused:
        sizes = F.broadcast(spark.createDataFrame(sorted({(limit(r),) for r in fused}), "size int"))  # a short list
        own = candidates.join(sizes, F.col("rank") <= F.col("size"))
        kept = [F.col("qid").cast("long").alias("qid"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("rank").cast("int").alias("rank"), "dense_score", "size"]
        if scored:
            own = own.join(held.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid").select(*kept, "text", "question")
            own = own.groupBy("qid", "size").applyInArrow(_candidate_scores, "qid long, chunk_id long, rank int, dense_score double, size int, bm25_score double")
        else:
            own = own.select(*kept, F.lit(None).cast("double").alias("bm25_score"))
        order = Window.partitionBy("qid", "size").orderBy(F.desc(F.round(F.coalesce("bm25_score", F.lit(0.0)), 9)), "rank")
        own = own.withColumn("sparse_rank", F.row_number().over(order))
        settings = F.broadcast(spark.createDataFrame([(*r, limit(r)) for r in fused], f"{_RUN}, size int"))  # a short list
        own = own.join(settings, "size")
        dense = F.col("mode") == "dense"
        counted = ~dense & (F.coalesce("bm25_score", F.lit(0.0)) > 0) & (F.col("sparse_rank") <= F.col("sparse_k"))
        own = own.withColumns({"bm25_score": F.when(counted, F.col("bm25_score")), "sparse_rank": F.when(counted, F.col("sparse_rank"))})
        of_question = Window.partitionBy("run_id", "qid")

        def scaled(c: Column) -> Column:
            low, high = F.min(c).over(of_question), F.max(c).over(of_question)
            return F.when(high - low < 1e-9, 1.0).otherwise((c - low) / (high - low))

        weighted = F.col("dense_weight") * scaled(F.col("dense_score")) + F.col("sparse_weight") * scaled(F.coalesce("bm25_score", F.lit(0.0)))
        by_rank = F.col("dense_weight") / (F.col("rrf_k") + F.col("rank")) + F.coalesce(F.col("sparse_weight") / (F.col("rrf_k") + F.col("sparse_rank")), F.lit(0.0))
        own = own.withColumn("fused", F.when(dense, F.col("dense_score")).when(F.col("mode") == "hybrid_weighted", weighted).otherwise(by_rank)).withColumnRenamed("rank", "dense_rank")
        best = Window.partitionBy("run_id", "qid").orderBy(F.desc(F.round("fused", 9)), "dense_rank")
        own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("final_k"))
        label = F.when(F.col("sparse_rank").isNotNull(), "both").otherwise("semantic")
        parts.append(_annotated(own, label, "run_id"))
    for settings in sorted({(limit(r), r[at["final_k"]], r[at["mmr_lambda"]]) for r in of("mmr")}):
        names = spark.createDataFrame([(r[0],) for r in of("mmr") if (limit(r), r[at["final_k"]], r[at["mmr_lambda"]]) == settings], "run_id string")
        found = mmr(candidates.where(F.col("rank") <= settings[0]), held, settings[1], settings[2])
        parts.append(found.join(F.broadcast(names)).select("run_id", *found.columns))  # a short list
    if sparse := of("sparse"):
        most = max(r[at["final_k"]] for r in sparse)
        names = F.broadcast(spark.createDataFrame([(r[0], r[at["final_k"]]) for r in sparse], "run_id string, final_k int"))  # a short list
        found = search(chunks, questions, "sparse", final_k=most, index=index)
        parts.append(found.join(names, F.col("rank") <= F.col("final_k")).select("run_id", *found.columns))
    return reduce(DataFrame.unionByName, parts)


def retrieve(points: DataFrame, questions: DataFrame, user_id: str, document_ids: Sequence[object] | DataFrame | None = None, **settings: float) -> DataFrame:
    """search() over what one owner has, of the documents asked for if any are: the filter lies below the ranking.

    points: chunk_id, text, vector, user_id, document_id. Nobody's chunks and those of others take part in nothing, statistics included.
    """
    return search(owned(points, user_id, document_ids), questions, **settings)  # type: ignore[arg-type]


def _spread(final_k: int, mmr_lambda: float):
    schema = pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), ("rank", pa.int32()), ("dense_score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        matrix = np.array(group.column("vector").to_pylist(), np.float64)
        relevance = group.column("dense_score").to_numpy()
        like, left, chosen = np.zeros(len(relevance)), np.ones(len(relevance), bool), []
        while left.any() and len(chosen) < final_k:
            value = np.where(left, np.round(mmr_lambda * relevance - (1 - mmr_lambda) * like, 12), -np.inf)
            best = int(value.argmax())  # the first of equal ones
            own = matrix @ matrix[best]
            like = np.maximum(like, own) if chosen else own
            left[best] = False
            chosen.append(best)
        picked = group.take(chosen)
        return pa.table([picked.column("qid"), picked.column("chunk_id"), pa.array(range(1, len(chosen) + 1), pa.int32()), picked.column("dense_score")], schema=schema)

    return run


def mmr(candidates: DataFrame, chunks: DataFrame, final_k: int, mmr_lambda: float = 0.5) -> DataFrame:
    """Greedy choice of final_k of each question's candidates, relevance against likeness to those chosen.

    A question's candidates are a bounded matrix; each step takes one product with it.
    """
    rows = candidates.select("qid", "chunk_id", "rank", "dense_score").join(chunks.select("chunk_id", "vector"), "chunk_id")
    picked = rows.select(F.col("qid").cast("long").alias("qid"), F.col("chunk_id").cast("long").alias("chunk_id"), "rank", "dense_score", "vector").groupBy("qid").applyInArrow(_spread(final_k, mmr_lambda), "qid long, chunk_id long, rank int, dense_score double")
    return _annotated(picked.withColumns({"fused": F.col("dense_score"), "bm25_score": F.lit(0.0)}), F.lit("semantic+mmr"))


def inject_noise(hits: DataFrame, chunks: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The last hits of each question replaced by chunks that it hasn't found, drawn at random as hashes of the seed decide.

    Each question swaps max(1, share of its hits) of them, rounded half to even; without more chunks than hits it keeps them.
    All questions draw from one sample of the chunks: the first ones in the order of md5(seed:chunk), twice as many as the
    longest list of hits has, so enough are left when a question's own are taken out. The sample is a handful of rows.
    """
    if share <= 0:
        return hits
    sizes = hits.groupBy("qid").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("swap", F.least(F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("int")), F.col("n")))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    sample = chunks.select("chunk_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "chunk_id")), "chunk_id").limit(2 * longest)
    pool = sizes.join(F.broadcast(sample)).join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")  # 2 * longest rows
    order = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "qid", "chunk_id")), "chunk_id")
    drawn = pool.withColumn("draw", F.row_number().over(order)).where("draw <= swap").select("qid", F.col("chunk_id").alias("noise_id"), (F.col("n") - F.col("draw") + 1).alias("rank"))
    both = hits.join(drawn, ["qid", "rank"], "left")
    is_noise = F.col("noise_id").isNotNull()
    zero = lambda c: F.when(is_noise, 0.0).otherwise(F.col(c)).alias(c)
    return both.select("qid", F.coalesce("noise_id", "chunk_id").alias("chunk_id"), "rank", zero("fused_score"), zero("dense_score"), zero("bm25_score"), F.when(is_noise, "noise").otherwise(F.col("matched_by")).alias("matched_by"), is_noise.alias("injected_noise"))


def rerank(hits: DataFrame, score: Column, top_n: int) -> DataFrame:
    """hits in the order of another model's score (a column, such as a pandas UDF of question and text), the best top_n."""
    scored = hits.withColumn("rerank_score", T.rounded(score, 5))
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_n).drop("rank").withColumnRenamed("new_rank", "rank")
