"""Configurations of retrieval, run and swept over shared chunks.

Configurations are a short list on the driver that shapes the plan; documents and questions stay in it. Configurations with
the same chunking and embedding share chunks and vectors, which are written once, and every row carries its run, so all
runs are one plan. A configuration that names a model which isn't given is refused: it becomes a row with its error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.functions import text as T
from quillstone.operators import chunking as K
from quillstone.operators import metrics as M
from quillstone.operators import relational as L
from quillstone.operators import retrieval as R
from quillstone.sources.store import Store

# What can be swept.
AXES = ("chunking_strategy", "chunk_target_tokens", "chunk_overlap_tokens", "embed_model", "retrieval_mode", "reranker_model", "final_k", "dense_weight", "sparse_weight", "llm_model_id", "noise_pct")
# The measures of a question, and its timings.
METRICS = ("recall_at_k", "precision_at_k", "ndcg_at_k", "mrr", "context_precision", "context_recall", "diversity", "faithfulness", "faithfulness_supported_frac", "answer_relevance", "keyword_f1", "composite_score")
TIMINGS = ("retrieval_ms", "rerank_ms", "generation_ms", "total_ms")


@dataclass(frozen=True)
class RunConfig:
    """The fields of a configuration and their defaults, which are fixed values."""

    chunking_strategy: str = "fixed"
    chunk_target_tokens: int = 750
    chunk_overlap_tokens: int = 150
    chunk_min_tokens: int = 80
    embed_model: str = "hash-64"
    retrieval_mode: str = "hybrid_rrf"
    dense_k: int = 25
    sparse_k: int = 25
    final_k: int = 8
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    mmr_lambda: float = 0.5
    reranker_model: str = "none"
    rerank_pool: int = 20
    llm_model_id: str = "auto"
    temperature: float = 0.0
    max_tokens: int = 700
    noise_pct: float = 0.0
    faithfulness_mode: str = "cosine"
    silver_relevance_k: int = 5
    use_llm_judge: bool = False
    label: str = ""
    sweep_id: str = ""
    sweep_axis: str = "none"

    def with_axis(self, axis: str, value: object) -> RunConfig:
        if axis not in AXES:
            raise ValueError(f"no axis to sweep: {axis!r}")
        return replace(self, **{axis: value, "sweep_axis": axis, "label": f"{axis}={value}"})

    def auto_label(self) -> str:
        last = lambda s, sep: s.rpartition(sep)[2]
        parts = (f"{self.chunking_strategy}{self.chunk_target_tokens}", f"emb-{last(self.embed_model, '/')}", self.retrieval_mode, f"rr-{last(self.reranker_model, '/')}", f"k{self.final_k}", f"llm-{last(self.llm_model_id, ':')}", f"noise{int(self.noise_pct * 100)}")
        return "_".join(parts)


def sweep(base: RunConfig, axis: str, values: Sequence[object]) -> list[RunConfig]:
    """A configuration for each value of an axis; without values the base alone."""
    return [base] if axis == "none" or not values else [base.with_axis(axis, v) for v in values]


_KINDS = {"str": "string", "int": "int", "float": "double", "bool": "boolean"}
#: The schema of a configuration as a row.
CONFIG = ", ".join(f"{f.name} {_KINDS[str(f.type)]}" for f in fields(RunConfig))
_NAMES = ("label", "sweep_id", "sweep_axis")


def configs_from_json(text: Column) -> Column:
    """A configuration struct of each JSON text: unknown keys are ignored, and what is missing or null has its default."""
    read = F.from_json(text, CONFIG)
    return F.struct(*(F.coalesce(read[f.name], F.lit(f.default)).alias(f.name) for f in fields(RunConfig)))


def fingerprint(config: Column) -> Column:
    """A short hash of all that changes a configuration's result."""
    return F.left(F.sha1(F.to_json(F.struct(*(config[f.name] for f in sorted(fields(RunConfig), key=lambda f: f.name) if f.name not in _NAMES)))), F.lit(10))


def as_rows(spark: SparkSession, configs: Sequence[RunConfig]) -> DataFrame:
    """run_id (label or fingerprint) and config of configurations, in their order."""
    rows = spark.createDataFrame([(k, asdict(c)) for k, c in enumerate(configs)], f"at int, config struct<{CONFIG.replace(' ', ':').replace(',:', ',')}>")
    return rows.select("at", F.coalesce(F.nullif("config.label", F.lit("")), fingerprint(F.col("config"))).alias("run_id"), "config")


def from_row(config) -> RunConfig:
    """The configuration of a row that configs_from_json made."""
    return RunConfig(**config.asDict())


def embedded(rows: DataFrame, text: Column, model: str, known: models.Models, store: Store, out: str = "vector", query: bool = False) -> DataFrame:
    """rows with the vectors of a text column. A model's are kept by the text's hash: what any run has embedded isn't embedded again."""
    if model == "hash-64":
        return rows.withColumn(out, known.embed(text, model))
    return store.ask("vectors", model, rows, [F.coalesce(models.embed_text(text, model, query), F.lit(""))], lambda t: models.embed(t, model, known.embedders[model]), out)


def _cut(docs: DataFrame, config: RunConfig, known: models.Models) -> DataFrame:
    own = K.chunk(docs, config.chunking_strategy, config.chunk_target_tokens, config.chunk_overlap_tokens, config.chunk_min_tokens, known.embedder(config.embed_model))
    key = F.concat_ws("::", "doc_id", "chunk_index").alias("name")
    return own.select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), key, "doc_id", "text", "section", "page_start", "page_end")


def chunks_of(docs: DataFrame, config: RunConfig, known: models.Models | None = None, store: Store | None = None) -> DataFrame:
    """chunk_id (doc_id::chunk_index), doc_id, text, section, place and vector of docs (doc_id, pages). Semantic chunks are those of the run's own model."""
    known, store = known or models.Models(), store or Store(docs.sparkSession)
    return embedded(_cut(docs, config, known), F.col("text"), config.embed_model, known, store)


def corpus_chunks(
    documents: DataFrame, pages: DataFrame, user_id: str, config: RunConfig, document_ids: Sequence[object] | None = None, known: models.Models | None = None, store: Store | None = None
) -> tuple[DataFrame, DataFrame]:
    """The chunks of what one owns, and (document_id, error) of owned documents that are missing or broken, which are passed over.

    documents: document_id, user_id, stored_path; pages: path, pages, error as sources.files reads them.
    """
    mine = L.owned(documents, user_id, document_ids).join(pages.withColumnRenamed("path", "stored_path"), "stored_path", "left")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("pages").isNull(), "the stored file is missing")
    good = mine.where(error.isNull()).select(F.col("document_id").alias("doc_id"), "pages")
    return chunks_of(good, config, known, store), mine.where(error.isNotNull()).select("document_id", error.alias("error"))


def resolve_questions(saved: DataFrame, inline: DataFrame | None, user_id: str, dataset_id: object = None) -> DataFrame:
    """question, expected_answer, relevant_sections: of the owner's saved set if one is named, else those given inline."""
    if dataset_id is not None:
        return L.owned(saved, user_id, [dataset_id], "dataset_id").select("question", "expected_answer", "relevant_sections")
    if inline is None:
        raise ValueError("neither a saved set nor questions are given")
    return inline


def answered(config: RunConfig, hits: DataFrame, chunks: DataFrame, questions: DataFrame, known: models.Models, store: Store) -> DataFrame:
    """qid, answer, generation_error, generation_ms of each question with hits, asked once and written."""
    rows = hits.select("qid", "rank", "chunk_id").join(chunks.select("chunk_id", "text", "page_start", "page_end", F.col("doc_id").cast("string").alias("filename")), "chunk_id")
    name = known.generator(config.llm_model_id)
    if name == "extract":
        return rows.where("rank = 1").select("qid", models.extract(F.col("text")).alias("answer"), F.lit(None).cast("string").alias("generation_error"), F.lit(0.0).alias("generation_ms"))
    contexts = L.prompt(rows.withColumn("section", F.lit(None).cast("string")), "eval")
    prompts = L.eval_messages(contexts, questions.select("qid", "question")).join(contexts.select("qid"), "qid", "left_semi")
    prompts = prompts.select("qid", F.concat("system", F.lit("\n\n"), "user").alias("prompt"))
    make, temperature, most = known.generators[name], config.temperature, config.max_tokens
    said = _generated("answers", name, temperature, most, prompts, F.col("prompt"), lambda: make(temperature, most), store)
    return store.once(said.select("qid", "g.answer", F.col("g.error").alias("generation_error"), F.col("g.ms").alias("generation_ms")), "answered")


def _generated(kind: str, name: str, temperature: float, most: int, rows: DataFrame, prompt: Column, factory, store: Store) -> DataFrame:
    model = f"{name} {temperature} {most}"
    return store.ask(kind, model, rows, [prompt], lambda p: models.generate(p, model, factory), "g")


def judged(config: RunConfig, hits: DataFrame, chunks: DataFrame, questions: DataFrame, known: models.Models, store: Store) -> DataFrame:
    """qid, chunk_id, verdict of the hits of questions by a generating model; null where it gave none."""
    name = known.generator(config.llm_model_id)
    make, most = known.generators[name], config.max_tokens
    pairs = hits.select("qid", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    said = _generated("verdicts", name, 0.0, most, pairs, models.judge_prompt(F.col("question"), F.col("text")), lambda: make(0.0, most), store)
    return store.once(said.select("qid", "chunk_id", T.verdict(F.col("g.answer")).alias("verdict")), "judged")


def reranked(config: RunConfig, hits: DataFrame, chunks: DataFrame, questions: DataFrame, known: models.Models, store: Store) -> tuple[DataFrame, DataFrame]:
    """hits in the order of the reranking model, and per question rerank_ms and rerank_error. A question of which a pair has no score keeps no hits."""
    pairs = hits.join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    name = config.reranker_model
    if name == "terms":
        stand_in = F.struct(models.shared_terms(F.col("question"), F.col("text")).alias("score"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("ms"))
        pairs = pairs.withColumn("s", stand_in)
    else:
        pairs = store.ask("scores", name, pairs, [F.col("question"), F.col("text")], lambda q, p: models.score(q, p, name, known.scorers[name]), "s")
    pairs = store.once(pairs.withColumns({"model_score": F.col("s.score"), "ms": F.col("s.ms"), "error": F.col("s.error")}).drop("s", "text", "question"), "scored")
    of_question = pairs.groupBy("qid").agg(F.sum("ms").alias("rerank_ms"), F.max(F.concat(F.lit("reranking failed: "), "error")).alias("rerank_error"))
    good = pairs.join(of_question.where("rerank_error IS NULL").select("qid"), "qid", "left_semi").drop("ms", "error")
    return R.rerank(good, F.col("model_score"), config.final_k).drop("model_score", "rerank_score"), of_question


def pool_of(config: RunConfig) -> int:
    """How many hits a question keeps before reranking, if there is any."""
    return max(config.rerank_pool, config.final_k) if config.reranker_model != "none" else config.final_k


def found_by(configs: dict[str, RunConfig], chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """The hits of configurations that share chunks, by run_id, as one plan."""
    return R.search_all(chunks, questions, {name: {s: getattr(c, {"mode": "retrieval_mode"}.get(s, s)) for s in R.SETTINGS} | {"final_k": pool_of(c)} for name, c in configs.items()})


@dataclass(frozen=True)
class Ranked:
    """What runs that share chunks read of the whole corpus, in tables that the questions bound: hits (run_id) and the milliseconds that they took, the chunks
    that are a hit of any run, gold (qid, chunk_id), silver (qid, chunk_id, rank)."""

    hits: DataFrame
    ms: float
    chunks: DataFrame
    gold: DataFrame
    silver: DataFrame


def _hinted(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.coalesce("relevant_sections", F.array().cast("array<string>")).alias("hints"))


def _hit_chunks(hits: DataFrame, chunks: DataFrame, store: Store) -> DataFrame:
    return store.once(chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi"), "hit-chunks")


def ranked(configs: dict[str, RunConfig], chunks: DataFrame, questions: DataFrame, store: Store) -> Ranked:
    """The passes over the corpus that configurations which share chunks have in common, each made once."""
    hits, ms = store.timed(found_by(configs, chunks, questions), "found")
    silver = R.dense_top_k(chunks, questions, max(c.silver_relevance_k for c in configs.values())).select("qid", "chunk_id", "rank")
    return Ranked(hits, ms, _hit_chunks(hits, chunks, store), store.once(M.gold_relevant(_hinted(questions), chunks), "gold"), store.once(silver, "silver"))


def run(
    config: RunConfig, chunks: DataFrame, questions: DataFrame, known: models.Models | None = None, store: Store | None = None, found: Ranked | None = None
) -> DataFrame:
    """qid, answer, relevance_source, generation_error, METRICS and TIMINGS of all questions (qid, question, expected_answer, relevant_sections, vector).

    Each stage that asks a model is written before it is used, so what branches of the plan read is asked once and the same for all.
    found: what was ranked, with the run's own hits and its share of the time, where runs are ranked together. Questions are, too: retrieval_ms is an equal share of what ranking took, the others are what the models took for a question's rows.
    Texts and vectors are read of the chunks that are hits, not of the corpus.
    A question whose reranking failed, or of which nothing was retrieved, has that as its error and no measures.
    """
    known, store = known or models.Models(), store or Store(chunks.sparkSession)
    found = found or ranked({"": config}, chunks, questions, store)
    hits, held, reranking = found.hits.drop("run_id"), found.chunks, None
    if config.reranker_model != "none":
        hits, reranking = reranked(config, hits, held, questions, known, store)
    hits = store.once(R.inject_noise(hits, chunks, config.noise_pct), "hits")
    if config.noise_pct > 0:
        held = _hit_chunks(hits, chunks, store)

    said = answered(config, hits, held, questions, known, store)
    hinted = _hinted(questions)
    silver = found.silver.where(F.col("rank") <= config.silver_relevance_k).select("qid", "chunk_id")
    verdicts = None
    if config.use_llm_judge:  # where no section decides and an answer was given
        open_ = questions.join(M.source_of(hinted).where("relevance_source <> 'gold'"), "qid", "left_semi").join(said.where("generation_error IS NULL"), "qid", "left_semi")
        verdicts = judged(config, hits, held, open_, known, store)
    relevant = M.relevance_source(hinted, found.gold, silver, verdicts)
    out = M.ranking_metrics(questions, hits, relevant).join(M.diversity(hits, held), "qid", "left")

    contexts = hits.select("qid", "chunk_id").join(held.select("chunk_id", "text", "vector"), "chunk_id")
    support = _entailed(said, contexts, known, store) if config.faithfulness_mode == "nli" else _support(said, "answer", contexts, config, known, store)
    faithful = M.faithfulness(support, config.faithfulness_mode).withColumnRenamed("supported_frac", "faithfulness_supported_frac")
    out = out.join(faithful, "qid", "left")
    expected = _support(questions.select("qid", "expected_answer"), "expected_answer", contexts, config, known, store)
    out = out.join(M.context_recall(expected).withColumnRenamed("context_recall", "recalled"), "qid", "left")
    answers = embedded(said.where(~T.is_blank(F.col("answer"))), F.col("answer"), config.embed_model, known, store, "answer_vector", True).select("qid", "answer_vector")
    out = out.join(said, "qid", "left").join(answers, "qid", "left").join(questions.select("qid", "vector", "expected_answer"), "qid")
    out = out.join(M.keyword_f1(questions.select("qid", F.col("expected_answer").alias("expected")).join(said.select("qid", "answer"), "qid", "left")), "qid", "left")
    out = out.join(M.source_of(hinted, verdicts), "qid")
    none = {"rerank_ms": F.lit(0.0), "rerank_error": F.lit(None).cast("string")}
    out = out.join(reranking, "qid", "left") if reranking is not None else out.withColumns(none)
    out = out.join(hits.groupBy("qid").agg(F.count("*").alias("n_hits")), "qid", "left")
    failed = F.when(F.col("rerank_error").isNotNull(), F.col("rerank_error")).when(F.col("n_hits").isNull(), "no passages retrieved")
    out = out.withColumn("generation_error", F.coalesce(failed, "generation_error"))
    out = out.withColumn("context_recall", F.when(T.is_blank(F.col("expected_answer")), F.col("recall_at_k")).otherwise(F.col("recalled")))
    out = out.withColumn("answer_relevance", F.when(F.col("answer_vector").isNotNull(), M.answer_relevance(F.col("vector"), F.col("answer_vector"))))
    out = out.withColumn("composite_score", M.composite(*(F.col(c) for c in M.COMPOSITE)))
    out = out.withColumns({m: F.when(F.col("n_hits").isNotNull(), F.col(m)) for m in METRICS})
    out = out.withColumn("retrieval_ms", F.lit(found.ms / max(1, questions.count())))
    out = out.withColumn("total_ms", F.col("retrieval_ms") + F.coalesce("rerank_ms", F.lit(0.0)) + F.coalesce("generation_ms", F.lit(0.0)))
    out = out.join(F.broadcast(chunks.agg(F.count("*").alias("corpus_size"))))  # one row
    return out.select("qid", "answer", "relevance_source", "generation_error", *METRICS, *TIMINGS, "corpus_size")


def _sentences(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("qid", F.posexplode(T.sentences(F.col(column), "metric")).alias("sid", "sentence"))


def _support(rows: DataFrame, column: str, contexts: DataFrame, config: RunConfig, known: models.Models, store: Store) -> DataFrame:
    """qid, sid, best cosine of the sentences of a text column with the contexts of their question."""
    parts = embedded(_sentences(rows, column), F.col("sentence"), config.embed_model, known, store)
    return M.best_support(parts.select("qid", "sid", "vector"), contexts)


def _entailed(said: DataFrame, contexts: DataFrame, known: models.Models, store: Store) -> DataFrame:
    """qid, sid, best probability that a context entails a sentence of the answer. Pairs without a score count for nothing."""
    pairs = _sentences(said, "answer").join(contexts.select("qid", "text"), "qid")
    scored = store.ask("scores", "entailment", pairs, [F.col("text"), F.col("sentence")], lambda c, s: models.score(c, s, "entailment", known.entailment), "s")
    return scored.groupBy("qid", "sid").agg(F.max(F.when(F.col("s.error").isNull(), F.col("s.score"))).alias("best"))


def run_all(configs: Iterable[RunConfig], docs: DataFrame, questions: DataFrame, known: models.Models | None = None, store: str | None = None) -> DataFrame:
    """run_id (label or fingerprint), qid, error and the columns of `run` of all configurations. One that can't be planned is a row with its error.

    store: a folder that all tasks can write; runs with the same one share the answers, scores and vectors of models. Chunks with
    their vectors are written once for all configurations that have them in common, and their texts for all models if chunks aren't cut by one.
    """
    known, configs = known or models.Models(), list(configs)
    spark = docs.sparkSession
    kept = Store(spark, store)
    names = {r["at"]: r["run_id"] for r in as_rows(spark, configs).collect()} if configs else {}
    shared: dict[tuple, dict[int, RunConfig]] = {}
    parts, failed = [], []
    for k, c in enumerate(configs):
        key = (c.chunking_strategy, c.chunk_target_tokens, c.chunk_overlap_tokens, c.chunk_min_tokens, c.embed_model)
        try:
            known.refuse_unknown(c.embed_model, c.reranker_model, c.llm_model_id, c.faithfulness_mode == "nli", c.use_llm_judge)
            shared.setdefault(key, {})[k] = c
        except ValueError as e:
            failed.append((names[k], str(e)))
    cut: dict[tuple, DataFrame] = {}
    several = Counter(key[:4] for key in shared if key[0] != "semantic")
    for key, own in shared.items():
        c = next(iter(own.values()))
        try:
            if several[key[:4]] > 1 and key[:4] not in cut:
                cut[key[:4]] = kept.once(_cut(docs, c, known), "cut")
            rows = cut[key[:4]] if key[:4] in cut else _cut(docs, c, known)
            chunks = kept.once(embedded(rows, F.col("text"), c.embed_model, known, kept), "chunks")
        except ValueError as e:
            failed += [(names[k], str(e)) for k in own]
            continue
        asked = kept.once(embedded(questions, F.col("question"), c.embed_model, known, kept, query=True), "questions")
        found = ranked({str(k): c for k, c in own.items()}, chunks, asked, kept)
        for k, c in own.items():
            mine = replace(found, hits=found.hits.where(F.col("run_id") == str(k)), ms=found.ms / len(own))
            parts.append(run(c, chunks, asked, known, kept, mine).select(F.lit(names[k]).alias("run_id"), "*", F.lit(None).cast("string").alias("error")))
    errors = spark.createDataFrame(failed, "run_id string, error string")
    if not parts:
        return errors
    out = reduce(DataFrame.unionByName, parts)
    return out.unionByName(errors, allowMissingColumns=True) if failed else out


# What can be chosen besides models and documents.
CHOICES = {
    "chunking_strategy": ("fixed", "sentence", "recursive", "semantic"),
    "retrieval_mode": ("hybrid_rrf", "hybrid_weighted", "dense", "sparse", "mmr"),
    "faithfulness_mode": ("cosine", "nli"),
    "axis": AXES,
}


def options(documents: DataFrame, user_id: str, known: models.Models | None = None) -> DataFrame:
    """kind, at, value: all that a run can be made of, and the documents that one owns, the latest upload first."""
    known = known or models.Models()
    choices = CHOICES | {"embed_model": ("hash-64", *known.embedders), "reranker_model": ("none", "terms", *known.scorers), "llm_model_id": ("auto", *known.generators)}
    rows = documents.sparkSession.createDataFrame([(kind, at, v) for kind, values in choices.items() for at, v in enumerate(values)], "kind string, at int, value string")
    mine = L.owned(documents, user_id).withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("upload_time"), "document_id")) - 1)
    return rows.unionByName(mine.select(F.lit("document").alias("kind"), "at", F.col("document_id").cast("string").alias("value")))


def aggregate(items: DataFrame) -> DataFrame:
    """run_id, metric, mean, median, std, n of all measures and timings of run_all's rows, with the run's errors, n_questions and corpus_size."""
    items = Store(items.sparkSession).once(items, "items")  # read twice
    counts = items.groupBy("run_id").agg(F.count_if(F.coalesce("error", "generation_error").isNotNull()).alias("errors"), F.count("qid").alias("n_questions"), F.max("corpus_size").alias("corpus_size"))
    return M.run_summary(items, [*METRICS, *TIMINGS]).join(counts, "run_id")
