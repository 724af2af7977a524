"""A sweep with models, of which stubs stand for those that would be downloaded."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.models import Models
from quillstone.operators import experiment as E
from quillstone.plans.tables import table


def letters() -> object:
    """An embedder: counts of letters."""
    return lambda texts: np.array([[1.0, *(t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz")] for t in texts])


def overlap() -> object:
    """A scorer of pairs: the share of the right text's words that the left one has."""
    return lambda left, right: [len(set(a.split()) & set(b.split())) / max(1, len(set(b.split()))) for a, b in zip(left, right, strict=True)]


def echo(temperature: float, most_tokens: int) -> object:
    """A generator: the first words after the first passage's head; asked for a verdict, whether question and passage share words."""

    def answer(prompt: str) -> str:
        question, _, passage = prompt.rpartition("Passage:")
        if question:
            return "YES" if len(set(question.split()) & set(passage.split())) > 8 else "NO"
        body = prompt.partition("[1] ")[2].partition("\n")[2]
        return " ".join(body.split()[:most_tokens])

    return lambda prompts: [answer(p) for p in prompts]


MODELS = Models({"letters": letters}, {"overlap": overlap}, {"echo": echo}, overlap)


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of five configurations over all documents and test items: each model axis once, and one that names no model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("number"), F.col("text").alias("text"))).alias("pages"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("expected_answer"), F.lit(None).cast("array<string>").alias("relevant_sections"))
    base = E.RunConfig(chunking_strategy="recursive", chunk_min_tokens=5, llm_model_id="echo", max_tokens=40)
    configs = [replace(base, label="base"), replace(base, embed_model="letters", label="letters"), replace(base, reranker_model="overlap", label="reranked"), replace(base, faithfulness_mode="nli", use_llm_judge=True, label="judged"), replace(base, embed_model="org/unknown", label="refused")]
    found = E.aggregate(E.run_all(configs, docs, asked, MODELS))
    return found.select("run_id", "metric", F.when(~F.col("metric").isin(*E.TIMINGS), F.col("mean")).alias("mean"), "n", "errors", "n_questions", "corpus_size")


QUERIES = {"experiment_runs": experiment_runs}
