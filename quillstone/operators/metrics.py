"""Measures of retrieval and of answers, for all questions of all runs in one plan.

Null stands for "can't be computed" and is left out of every mean. Hits are (keys.., rank, chunk_id), relevant
chunks are (qid, chunk_id). Nothing but ranks and ids is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators.retrieval import in_slices

#: Cosine from which a sentence of the expected answer counts as found.
FOUND = 0.55
#: The parts of the composite score.
COMPOSITE = ("context_precision", "recall_at_k", "faithfulness", "answer_relevance")


def _ideal(n: Column) -> Column:
    """Sum of 1/log2(i+1) for i up to n."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))).otherwise(0.0)


def ranking_metrics(runs: DataFrame, hits: DataFrame, relevant: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """recall_at_k, precision_at_k, ndcg_at_k, mrr, context_precision of every row of runs (keys).

    Nothing relevant: all null but precision, which is 0. Nothing retrieved: recall and mrr are 0, the others null.
    """
    of = relevant.select("qid", "chunk_id").distinct()
    sizes = of.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    marked = hits.select(*keys, "rank", "chunk_id").join(of.withColumn("rel", F.lit(1)), ["qid", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return _measured(runs, marked, sizes, keys)


def label_metrics(runs: DataFrame, hits: DataFrame, questions: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """The same where the chunks (chunk_id, label) of the question's (qid, label) own label are relevant: hits are marked by their label and labels are counted, no pair is made."""
    sizes = questions.select("qid", "label").join(chunks.groupBy("label").agg(F.count("*").alias("n_relevant")), "label").select("qid", "n_relevant")
    of = chunks.select("chunk_id", F.col("label").alias("own"))
    marked = hits.select(*keys, "rank", "chunk_id").join(of, "chunk_id").join(questions.select("qid", "label"), "qid")
    return _measured(runs, marked.withColumn("rel", F.coalesce((F.col("own") == F.col("label")).cast("int"), F.lit(0))), sizes, keys)


def _measured(runs: DataFrame, marked: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """marked: keys.., rank, rel (1 or 0); sizes: qid, n_relevant."""
    seen = F.sum("rel").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("seen", seen)
    found = marked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("rel").alias("hits"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.avg(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank"))).alias("mean_precision")
    )
    rows = runs.select(*keys).join(found, list(keys), "left").join(sizes, "qid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "hits", "n_relevant")})
    some, any_hit = F.col("n_relevant") > 0, F.col("n") > 0
    return rows.select(
        *keys,
        F.when(some, F.col("hits") / F.col("n_relevant")).alias("recall_at_k"),
        F.when(any_hit, F.col("hits") / F.col("n")).alias("precision_at_k"),
        F.when(some & any_hit, F.col("dcg") / _ideal(F.least("n_relevant", "n"))).alias("ndcg_at_k"),
        F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some & any_hit, F.coalesce("mean_precision", F.lit(0.0))).alias("context_precision"),
    )


def _holding(hints: list[tuple[int, list[str]]]):
    """Chunks with the questions whose hint they hold. The automaton of all hints passes over a text once."""
    schema = pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64())])
    asking: dict[str, list[int]] = {}
    for qid, own in hints:
        for h in own:
            asking.setdefault(h, []).append(qid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        automaton = Automaton()
        for h in asking:
            automaton.add_word(h, h)
        automaton.make_automaton()
        held = lambda text: {h for _, h in automaton.iter(text)}
        for data in batches:
            rows = [(q, i) for i, text in zip(data.column("chunk_id").to_pylist(), data.column("hay").to_pylist(), strict=True) if text for q in sorted({q for h in held(text) for q in asking[h]})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], schema=schema)

    return run


def gold_relevant(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_id where the section or text holds one of the question's hints, whatever the case; blank hints are dropped.

    questions: qid, hints array<string>, a stated set that is sent to the chunks in slices of a bounded size.
    """
    hints = questions.select("qid", F.filter(F.transform("hints", lambda h: F.lower(T.strip(h))), lambda h: h != "").alias("hints"))
    hay = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower(F.concat(F.coalesce("section", F.lit("")), F.lit(" "), F.col("text"))).alias("hay"))
    slices = [[(r["qid"], r["hints"]) for r in own if r["hints"]] for own in in_slices(hints)]
    parts = [hay.mapInArrow(_holding(own), "qid long, chunk_id long") for own in slices if own]
    return reduce(DataFrame.unionByName, parts, chunks.sparkSession.createDataFrame([], "qid long, chunk_id long")) if len(parts) != 1 else parts[0]


def source_of(questions: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """qid, relevance_source: gold where a question has hints, even if they match nothing; else llm_judge where the judge gave any verdict; else silver."""
    gold = F.coalesce(F.exists("hints", lambda h: ~T.is_blank(h)), F.lit(False))
    if verdicts is None:
        return questions.select("qid", F.when(gold, "gold").otherwise("silver").alias("relevance_source"))
    said = verdicts.groupBy("qid").agg(F.count("verdict").alias("n"))
    return questions.join(said, "qid", "left").select("qid", F.when(gold, "gold").when(F.col("n") > 0, "llm_judge").otherwise("silver").alias("relevance_source"))


def relevance_source(questions: DataFrame, gold: DataFrame, silver: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, source: the relevant chunks of each question by the first of gold, judge and silver that it has."""
    sources = source_of(questions, verdicts)
    sets = [(gold, "gold"), (silver, "silver")] + ([(verdicts.where("verdict"), "llm_judge")] if verdicts is not None else [])
    parts = [found.select("qid", "chunk_id").join(sources.where(F.col("relevance_source") == name), "qid").select("qid", "chunk_id", F.lit(name).alias("source")) for found, name in sets]
    return reduce(DataFrame.unionByName, parts)


def diversity(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, diversity: 1 less the mean cosine of all pairs of hits, null below two. A question's hits are a bounded array."""
    own = hits.join(chunks.select("chunk_id", "vector"), "chunk_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("own"))
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b["rank"] > a["rank"]), lambda b: V.dot(a["vector"], b["vector"]))))
    return own.select("qid", F.when(F.size("own") >= 2, 1 - F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).alias("diversity"))


def best_support(sentences: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, sid, best: the largest cosine of each sentence (qid, sid, vector) with the contexts (qid, vector) of its question."""
    own = contexts.groupBy("qid").agg(F.collect_list("vector").alias("contexts"))
    return sentences.join(own, "qid").select("qid", "sid", F.array_max(F.transform("contexts", lambda c: V.dot(c, F.col("vector")))).alias("best"))


def context_recall(support: DataFrame) -> DataFrame:
    return support.groupBy("qid").agg(F.avg((F.col("best") >= FOUND).cast("int")).alias("context_recall"))


def faithfulness(support: DataFrame, mode: str = "cosine") -> DataFrame:
    """qid, faithfulness, supported_frac: mean support of the sentences, and the share from 0.5 on. Cosines are scaled to 0..1, probabilities of entailment ("nli") aren't."""
    scaled = F.col("best") if mode == "nli" else (F.col("best") + 1) / 2
    return support.groupBy("qid").agg(F.avg(scaled).alias("faithfulness"), F.avg((scaled >= 0.5).cast("int")).alias("supported_frac"))


def answer_relevance(question: Column, answer: Column) -> Column:
    return (V.dot(question, answer) + 1) / 2


def keyword_f1(pairs: DataFrame) -> DataFrame:
    """qid, keyword_f1 of answers against what is expected: overlap of terms with their counts; null without an expected answer."""
    terms = lambda c: pairs.select("qid", F.explode(T.answer_terms(F.col(c))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias(c))
    both = terms("answer").join(terms("expected"), ["qid", "term"], "full").groupBy("qid").agg(F.sum(F.least(F.coalesce("answer", F.lit(0)), F.coalesce("expected", F.lit(0)))).alias("common"), F.sum("answer").alias("n_answer"), F.sum("expected").alias("n_expected"))
    rows = pairs.select("qid", (~T.is_blank(F.col("expected"))).alias("has_gold")).join(both, "qid", "left")
    precision, recall = F.col("common") / F.col("n_answer"), F.col("common") / F.col("n_expected")
    f1 = F.when(F.coalesce("common", F.lit(0)) == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return rows.select("qid", F.when(F.col("has_gold"), f1).alias("keyword_f1"))


def composite(*parts: Column) -> Column:
    """Mean of the parts that aren't null."""
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))


def run_summary(items: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """run_id, metric, mean, median, std, n over items (run_id, metrics..); std of the population, all to 4 digits."""
    long = items.unpivot(["run_id"], list(metrics), "metric", "value")
    value = F.nullif(F.col("value"), F.lit(float("nan")))
    stats = long.select("run_id", "metric", value.alias("value")).groupBy("run_id", "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    return stats.select("run_id", "metric", *(T.rounded(F.col(c), 4).alias(c) for c in ("mean", "median", "std")), "n")
