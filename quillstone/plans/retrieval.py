"""Queries over documents, benchmark questions and embeddings, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators import metrics as M
from quillstone.operators import retrieval as R
from quillstone.operators.inverted_index import InvertedIndex
from quillstone.plans.tables import table
from quillstone.session import shared_dir
from quillstone.sources.store import Store
from quillstone.sources.versions import Versions


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with hashed vectors."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section"), V.hashed_vector(F.col("text")).alias("vector"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), V.hashed_vector(F.col("text")).alias("vector"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, sf_dir).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "vector", "label")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.postings(docs).select(F.col("chunk_id").alias("doc_id"), "term", "tf")


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))


def metric_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.sentences(F.col("text"), "metric")).alias("n_metric"), F.size(T.sentences(F.col("text"), "chunk")).alias("n_chunk"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", V.hashed_vector(F.col("text")).alias("vector"))
    return found.select("doc_id", F.posexplode("vector").alias("bucket", "x")).where("x > 0").select("doc_id", "bucket", T.rounded(F.col("x"), 6).alias("x"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.dense_top_k(_vectors(spark, sf_dir), _vector_questions(spark, sf_dir), 25)
    return found.select("qid", "chunk_id", "rank", T.rounded(F.col("dense_score"), 4).alias("dense_score"))


def dense_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chunks of one owner, here a label, are ranked: the filter lies below the ranking."""
    own = _vectors(spark, sf_dir).where("label = 3")
    found = R.dense_top_k(own, _vector_questions(spark, sf_dir), 10)
    return found.select("qid", "chunk_id", "rank", T.rounded(F.col("dense_score"), 4).alias("dense_score"))


def dense_topk_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one owner, here a label, has in the documents asked for, here even ids, ranked by the production path."""
    points = _vectors(spark, sf_dir).select("chunk_id", "vector", F.lit("").alias("text"), F.concat(F.lit("u"), F.col("label")).alias("user_id"), (F.col("chunk_id") % 2).alias("document_id"))
    questions = _vector_questions(spark, sf_dir).withColumn("question", F.lit(""))
    return R.retrieve(points, questions, "u3", [0], mode="dense").select("qid", "chunk_id", "rank", "fused_score")


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).statistics().select("term", "df", T.rounded(F.col("idf"), 6).alias("idf"))


def _index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The stored index of the documents, built once an application for each state of the table's files."""
    fs, at = Versions(spark, sf_dir).at(f"{sf_dir}/documents.parquet")
    files = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(at))
    index = InvertedIndex(spark, f"{shared_dir(spark)}/index-{hashlib.sha256(' '.join(files).encode()).hexdigest()[:16]}")
    if not index.state()["segments"]:
        index.append(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return index


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the whole corpus from the stored index: the documents themselves aren't read."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return R.search(None, questions, "sparse", index=_index(spark, sf_dir)).drop("injected_noise")


def _hits(mode: str, **settings: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.search(_chunks(spark, sf_dir), _questions(spark, sf_dir), mode, **settings).drop("injected_noise")

    return run


def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _vectors(spark, sf_dir)
    return R.mmr(R.dense_top_k(chunks, _vector_questions(spark, sf_dir), 25), chunks, 8, 0.5).drop("injected_noise")


def noise_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.search(_vectors(spark, sf_dir), _vector_questions(spark, sf_dir), "dense")
    return R.inject_noise(hits, _vectors(spark, sf_dir), 0.5)


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused hits again by a stand-in for a model: the share of the question's terms that the text has."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits = R.search(chunks, questions, final_k=20).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    asked = F.array_distinct(T.terms(F.col("question")))
    score = F.try_divide(F.size(F.array_intersect(asked, T.terms(F.col("text")))), F.size(asked))
    return R.rerank(hits, score, 8).select("qid", "chunk_id", F.col("rank").cast("int").alias("rank"), "rerank_score")


def gold_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.col("text")).alias("hints"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section"))
    return M.gold_relevant(hints, docs)


def silver_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_top_k(_vectors(spark, sf_dir), _vector_questions(spark, sf_dir), 5).select("qid", "chunk_id")


def relevance_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold where the text of an even item is its hint, silver for the others, which give none."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hints = questions.select("qid", F.when(F.col("qid") % 2 == 0, F.array("question")).otherwise(F.array().cast("array<string>")).alias("hints"))
    silver = R.dense_top_k(chunks, questions, 5).select("qid", "chunk_id")
    return M.relevance_source(hints, M.gold_relevant(hints, chunks), silver)


def _label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the question's own label are relevant."""
    chunks, questions = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    return M.label_metrics(questions, R.dense_top_k(chunks, questions, 10), questions, chunks)


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _label_metrics(spark, sf_dir)
    return found.select("qid", *(T.rounded(F.col(c), 4).alias(c) for c in found.columns[1:]))


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _vectors(spark, sf_dir)
    found = M.diversity(R.dense_top_k(chunks, _vector_questions(spark, sf_dir), 8), chunks)
    return found.select("qid", T.rounded(F.col("diversity"), 4).alias("diversity"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _label_metrics(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run"), (F.col("qid") / 20 % 2).cast("int")))
    return M.run_summary(items, ["recall_at_k", "precision_at_k", "ndcg_at_k", "mrr", "context_precision"])


def sweep_final_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision for each k, from one ranking: a smaller k is a prefix of it."""
    chunks, questions = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    ks = spark.createDataFrame([(k,) for k in (1, 3, 5, 8, 10, 15, 20)], "final_k int")
    hits = R.dense_top_k(chunks, questions, 20).join(F.broadcast(ks), F.col("rank") <= F.col("final_k"))
    runs = questions.select("qid").join(F.broadcast(ks))
    found = M.label_metrics(runs, hits, questions, chunks, ("final_k", "qid"))
    return found.groupBy("final_k").agg(*(T.rounded(F.avg(c), 4).alias(c) for c in ("recall_at_k", "precision_at_k", "ndcg_at_k", "mrr", "context_precision")))


def _gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that hold a question's text, written once: metrics read them for hits and for their number."""
    return Store(chunks.sparkSession).once(M.gold_relevant(questions.select("qid", F.array("question").alias("hints")), chunks), "gold")


def sweep_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold recall of each mode over shared chunks and questions: chunks are ranked once for all. One set of questions doesn't pay for a stored index."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    modes = ("hybrid_rrf", "hybrid_weighted", "dense", "sparse", "mmr")
    hits = R.search_all(chunks.drop("vector"), questions, {m: {"mode": m} for m in modes}, vector=V.hashed_vector(F.col("text"))).withColumnRenamed("run_id", "mode")
    runs = questions.select("qid").join(F.broadcast(spark.createDataFrame([(m,) for m in modes], "mode string")))
    gold = _gold(questions, chunks)
    found = M.ranking_metrics(runs, hits, gold, ("mode", "qid"))
    return found.groupBy("mode").agg(F.count("recall_at_k").alias("n"), *(T.rounded(F.avg(c), 4).alias(c) for c in ("recall_at_k", "mrr")))


def sweep_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold recall of twenty weights of the dense part in either fusion: chunks are ranked and scored once for all."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    settings = {f"{mode}:{w}": {"mode": mode, "dense_weight": w / 10} for mode in ("hybrid_rrf", "hybrid_weighted") for w in range(1, 21, 2)}
    hits = R.search_all(chunks, questions, settings)
    runs = questions.select("qid").join(F.broadcast(spark.createDataFrame([(s,) for s in settings], "run_id string")))
    gold = _gold(questions, chunks)
    found = M.ranking_metrics(runs, hits, gold, ("run_id", "qid"))
    return found.groupBy("run_id").agg(F.count("recall_at_k").alias("n"), *(T.rounded(F.avg(c), 4).alias(c) for c in ("recall_at_k", "mrr")))


def keyword_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best dense hit as an answer, the question's own text as what is expected."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    best = R.dense_top_k(chunks, questions, 1).join(chunks.select("chunk_id", "text"), "chunk_id")
    pairs = best.join(questions.select("qid", "question"), "qid").select("qid", F.col("text").alias("answer"), F.col("question").alias("expected"))
    return M.keyword_f1(pairs).select("qid", T.rounded(F.col("keyword_f1"), 4).alias("keyword_f1"))


def _support(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of the questions against the vectors of their five best chunks."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    parts = questions.select("qid", F.posexplode(T.sentences(F.col("question"), "metric")).alias("sid", "sentence"))
    parts = parts.select("qid", "sid", V.hashed_vector(F.col("sentence")).alias("vector"))
    contexts = R.dense_top_k(chunks, questions, 5).join(chunks.select("chunk_id", "vector"), "chunk_id").select("qid", "vector")
    return M.best_support(parts, contexts), questions


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    support, _ = _support(spark, sf_dir)
    found = M.faithfulness(support).join(M.context_recall(support), "qid")
    return found.select("qid", *(T.rounded(F.col(c), 4).alias(c) for c in ("faithfulness", "supported_frac", "context_recall")))


def answer_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector question against its best other vector."""
    chunks, questions = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    best = R.dense_top_k(chunks, questions, 2).where("rank = 2").join(chunks.select("chunk_id", F.col("vector").alias("answer")), "chunk_id").join(questions.select("qid", "vector"), "qid")
    return best.select("qid", T.rounded(M.answer_relevance(F.col("vector"), F.col("answer")), 4).alias("answer_relevance"))


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four parts: chunks of the own label are relevant, the best other vector is the answer, and the five after it are what supports it."""
    chunks, questions = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    hits = R.dense_top_k(chunks, questions, 7).join(chunks.select("chunk_id", "vector"), "chunk_id")
    answers = hits.where("rank = 2").select("qid", F.lit(0).alias("sid"), "vector")
    faithful = M.faithfulness(M.best_support(answers, hits.where("rank > 2").select("qid", "vector")))
    rows = _label_metrics(spark, sf_dir).join(faithful, "qid").join(questions.select("qid", F.col("vector").alias("asked")), "qid").join(answers.select("qid", "vector"), "qid")
    return rows.select("qid", T.rounded(M.composite(F.col("context_precision"), F.col("recall_at_k"), F.col("faithfulness"), M.answer_relevance(F.col("asked"), F.col("vector"))), 4).alias("composite"))


# --- SQL ---------------------------------------------------------------------------------------

_R = lambda x, n: f"CAST(round(CAST({x} AS DECIMAL(20,10)), {n}) AS DOUBLE)"


def _embed(name: str, source: str, id_: str, text: str) -> str:
    return f"""{name}_w AS (SELECT {id_} AS id, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')) AS w FROM {source}),
        {name}_c AS (SELECT id, CAST('0x' || right(md5(w), 2) AS INT) % 64 AS b, count(*) AS n FROM {name}_w GROUP BY id, b),
        {name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM {name}_c)"""


def _dense(k: int, docs: str = "dv", asked: str = "qv") -> str:
    return f"""dense_all AS (SELECT q.id AS qid, d.id AS chunk_id, sum(q.x * d.x) AS dense_score FROM {asked} q JOIN {docs} d ON q.b = d.b GROUP BY q.id, d.id),
        dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dense_score, 9) DESC, chunk_id) AS rank FROM dense_all) WHERE rank <= {k})"""


_TEXT_VECTORS = f"{_embed('dv', 'documents', 'doc_id', 'text')}, {_embed('qv', 'benchmark', 'item_id', 'text')}"
_E = """dv AS (SELECT vec_id AS id, unnest(range(1, 65)) AS b, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        qv AS (SELECT * FROM dv WHERE id % 20 = 0)"""
_TERMS = r"list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9]+(?:[.\-/][A-Za-z0-9]+)*'), lambda x: lower(x))"
_DOC_TERMS = f"dt AS (SELECT doc_id AS chunk_id, {_TERMS.format('text')} AS terms FROM documents), qt AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY item_id, term)"
_BM25 = "sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length)))"
_CANDIDATES = f"""{_TEXT_VECTORS}, {_dense(25)}, {_DOC_TERMS},
        ct AS (SELECT d.qid, d.chunk_id, len(terms) AS length, avg(len(terms)) OVER (PARTITION BY qid) AS mean_length, count(*) OVER (PARTITION BY qid) AS n, terms FROM dense d JOIN dt USING (chunk_id)),
        tf AS (SELECT qid, chunk_id, length, mean_length, n, term, count(*) AS tf FROM (SELECT qid, chunk_id, length, mean_length, n, unnest(terms) AS term FROM ct) GROUP BY ALL),
        raw AS (SELECT qid, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY qid, term, n),
        idf AS (SELECT qid, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY qid) ELSE raw END AS idf FROM raw),
        bm AS (SELECT tf.qid, tf.chunk_id, {_BM25} AS bm25_score FROM tf JOIN qt USING (qid, term) JOIN idf USING (qid, term) GROUP BY tf.qid, tf.chunk_id),
        sp AS (SELECT d.*, coalesce(bm25_score, 0) AS bm, row_number() OVER (PARTITION BY d.qid ORDER BY round(coalesce(bm25_score, 0), 9) DESC, rank) AS sparse_rank FROM dense d LEFT JOIN bm ON bm.qid = d.qid AND bm.chunk_id = d.chunk_id),
        fused AS (SELECT *, bm > 0 AND sparse_rank <= 25 AS counted FROM sp)"""


def _fused(expression: str, k: int = 8) -> str:
    return f"""WITH {_CANDIDATES}, f AS (SELECT *, {expression} AS fused FROM fused),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, rank) AS final_rank FROM f)
        SELECT qid, chunk_id, CAST(final_rank AS INT) AS rank, {_R('fused', 5)} AS fused_score, {_R('dense_score', 4)} AS dense_score,
               {_R('CASE WHEN counted THEN bm ELSE 0 END', 4)} AS bm25_score, CASE WHEN counted THEN 'both' ELSE 'semantic' END AS matched_by FROM r WHERE final_rank <= {k}"""


_RRF = "1.0 / (60 + rank) + CASE WHEN counted THEN 1.0 / (60 + sparse_rank) ELSE 0 END"
_SCALE = "CASE WHEN max({0}) OVER (PARTITION BY qid) - min({0}) OVER (PARTITION BY qid) < 1e-9 THEN 1.0 ELSE ({0} - min({0}) OVER (PARTITION BY qid)) / (max({0}) OVER (PARTITION BY qid) - min({0}) OVER (PARTITION BY qid)) END"
_WEIGHTED = f"{_SCALE.format('dense_score')} + {_SCALE.format('CASE WHEN counted THEN bm ELSE 0 END')}"
_LABELS = f"""{_E}, {_dense(20)},
        rel AS (SELECT q.vec_id AS qid, d.vec_id AS chunk_id FROM embeddings q JOIN embeddings d USING (label) WHERE q.vec_id % 20 = 0)"""


def _ranking(hits: str, keys: str = "qid", runs: str = "(SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0)") -> str:
    """CTE m: the ranking metrics of hits."""
    on = " AND ".join(f"r.{k} = f.{k}" for k in keys.split(", "))
    return f"""mk AS (SELECT h.*, CASE WHEN rel.chunk_id IS NULL THEN 0 ELSE 1 END AS is_rel FROM {hits} h LEFT JOIN rel ON rel.qid = h.qid AND rel.chunk_id = h.chunk_id),
        sn AS (SELECT *, sum(is_rel) OVER (PARTITION BY {keys} ORDER BY rank) AS seen FROM mk),
        fd AS (SELECT {keys}, count(*) AS n, sum(is_rel) AS hits, sum(is_rel / log2(rank + 1)) AS dcg, min(CASE WHEN is_rel = 1 THEN rank END) AS first_hit, avg(CASE WHEN is_rel = 1 THEN seen / rank END) AS mean_precision FROM sn GROUP BY {keys}),
        sz AS (SELECT qid, count(*) AS n_relevant FROM rel GROUP BY qid),
        al AS (SELECT r.*, coalesce(f.n, 0) AS n, coalesce(hits, 0) AS hits, dcg, first_hit, mean_precision, coalesce(n_relevant, 0) AS n_relevant FROM {runs} r LEFT JOIN fd f ON {on} LEFT JOIN sz ON sz.qid = r.qid),
        m AS (SELECT {keys}, CASE WHEN n_relevant > 0 THEN hits / n_relevant END AS recall_at_k, CASE WHEN n > 0 THEN hits / n END AS precision_at_k,
              CASE WHEN n_relevant > 0 AND n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(n_relevant, n) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_at_k,
              CASE WHEN n_relevant > 0 THEN coalesce(1 / first_hit, 0) END AS mrr, CASE WHEN n_relevant > 0 AND n > 0 THEN coalesce(mean_precision, 0) END AS context_precision FROM al)"""


_METRICS = ("recall_at_k", "precision_at_k", "ndcg_at_k", "mrr", "context_precision")
_SPLIT = r"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+([{open}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
_INGEST = _SPLIT.format(text=r"regexp_replace(text, '[ \t]+', ' ', 'g')", open="A-Z0-9(")

QUERIES = {
    "hybrid_rrf": _hits("hybrid_rrf"),
    "hybrid_weighted": _hits("hybrid_weighted"),
    "dense_documents": _hits("dense"),
    "sparse_topk": sparse_topk,
    "tokenize_terms": tokenize_terms,
    "token_count": token_count,
    "sentence_split": sentence_split,
    "metric_sentences": metric_sentences,
    "hash_embed": hash_embed,
    "dense_topk": dense_topk,
    "dense_topk_scoped": dense_topk_scoped,
    "dense_topk_owner": dense_topk_owner,
    "bm25_idf": bm25_idf,
    "mmr": mmr,
    "noise_injection": noise_injection,
    "rerank": rerank,
    "gold_relevant": gold_relevant,
    "silver_relevant": silver_relevant,
    "relevance_source": relevance_source,
    "ir_metrics": ir_metrics,
    "diversity": diversity,
    "run_summary": run_summary,
    "sweep_final_k": sweep_final_k,
    "sweep_mode": sweep_mode,
    "sweep_weights": sweep_weights,
    "keyword_f1": keyword_f1,
    "faithfulness": faithfulness,
    "answer_relevance": answer_relevance,
    "composite": composite,
}

_GOLD = "SELECT b.item_id AS qid, d.doc_id AS chunk_id FROM documents d, benchmark b WHERE contains(lower(d.source || ' ' || d.text), lower(trim(b.text, chr(32) || chr(9) || chr(10) || chr(13))))"
_SPARSE = f"""{_DOC_TERMS},
        tf AS (SELECT chunk_id, len(terms) AS length, term, count(*) AS tf FROM (SELECT chunk_id, terms, unnest(terms) AS term FROM dt) GROUP BY chunk_id, terms, term),
        tot AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM dt),
        raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(mean_length) AS mean_length FROM tf, tot GROUP BY term),
        idf AS (SELECT term, df, mean_length, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""



def _mmr(k: int, tag: str = "") -> str:
    """CTEs m1 .. mk: the candidates (dense) chosen so far, one more by each."""
    first = f"""sim{tag} AS (SELECT a.qid, a.chunk_id AS x, b.chunk_id AS y, coalesce(sum(p.x * r.x), 0) AS c FROM dense a JOIN dense b ON a.qid = b.qid JOIN dv p ON p.id = a.chunk_id JOIN dv r ON r.id = b.chunk_id AND r.b = p.b GROUP BY a.qid, a.chunk_id, b.chunk_id),
        m{tag}1 AS (SELECT qid, chunk_id, 1 AS nth, dense_score FROM dense QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * dense_score, 12) DESC, rank) = 1)"""
    steps = [
        f"""m{tag}{n} AS (SELECT * FROM m{tag}{n - 1} UNION ALL SELECT qid, chunk_id, {n}, dense_score FROM (
            SELECT d.qid, d.chunk_id, d.rank, d.dense_score, max(coalesce(s.c, 0)) AS l FROM dense d JOIN m{tag}{n - 1} o ON o.qid = d.qid LEFT JOIN sim{tag} s ON s.qid = d.qid AND s.x = d.chunk_id AND s.y = o.chunk_id
            WHERE NOT EXISTS (SELECT 1 FROM m{tag}{n - 1} z WHERE z.qid = d.qid AND z.chunk_id = d.chunk_id) GROUP BY d.qid, d.chunk_id, d.rank, d.dense_score)
            QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * dense_score - 0.5 * l, 12) DESC, rank) = 1)"""
        for n in range(2, k + 1)
    ]
    return ", ".join([first, *steps])


ORACLE_SQL = {
    "mmr": f"WITH {_E}, {_dense(25)}, {_mmr(8)} SELECT qid, chunk_id, CAST(nth AS INT) AS rank, {_R('dense_score', 5)} AS fused_score, {_R('dense_score', 4)} AS dense_score, CAST(0 AS DOUBLE) AS bm25_score, 'semantic+mmr' AS matched_by FROM m8",
    "noise_injection": f"""WITH {_E}, {_dense(8)}, sz AS (SELECT qid, count(*) AS n, least(greatest(1, CAST(round_even(count(*) * 0.5, 0) AS INT)), count(*)) AS swap FROM dense GROUP BY qid),
        sa AS (SELECT vec_id AS chunk_id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 16),
        dr AS (SELECT sz.qid, sa.chunk_id AS noise_id, n - row_number() OVER (PARTITION BY sz.qid ORDER BY md5('0:' || sz.qid || ':' || sa.chunk_id), sa.chunk_id) + 1 AS rank, n - swap AS kept FROM sz, sa WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.qid = sz.qid AND d.chunk_id = sa.chunk_id))
        SELECT d.qid, coalesce(noise_id, d.chunk_id) AS chunk_id, CAST(d.rank AS INT) AS rank, CASE WHEN noise_id IS NULL THEN {_R('dense_score', 5)} ELSE 0 END AS fused_score, CASE WHEN noise_id IS NULL THEN {_R('dense_score', 4)} ELSE 0 END AS dense_score,
               CAST(0 AS DOUBLE) AS bm25_score, CASE WHEN noise_id IS NULL THEN 'semantic' ELSE 'noise' END AS matched_by, noise_id IS NOT NULL AS injected_noise FROM dense d LEFT JOIN dr ON dr.qid = d.qid AND dr.rank = d.rank AND dr.rank > dr.kept""",
    "dense_topk_owner": f"WITH {_E}, ow AS (SELECT dv.* FROM dv JOIN embeddings ON vec_id = id WHERE label = 3 AND vec_id % 2 = 0), {_dense(8, 'ow')} SELECT qid, chunk_id, CAST(rank AS INT) AS rank, {_R('dense_score', 5)} AS fused_score FROM dense",
    "hybrid_rrf": _fused(_RRF),
    "hybrid_weighted": _fused(_WEIGHTED),
    "dense_documents": f"WITH {_TEXT_VECTORS}, {_dense(8)} SELECT qid, chunk_id, CAST(rank AS INT) AS rank, {_R('dense_score', 5)} AS fused_score, {_R('dense_score', 4)} AS dense_score, CAST(0 AS DOUBLE) AS bm25_score, 'semantic' AS matched_by FROM dense",
    "sparse_topk": f"""WITH {_SPARSE}, s AS (SELECT qid, chunk_id, {_BM25} AS bm FROM tf JOIN qt USING (term) JOIN idf USING (term) GROUP BY qid, chunk_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm, 9) DESC, chunk_id) AS rank FROM s WHERE bm > 0)
        SELECT qid, chunk_id, CAST(rank AS INT) AS rank, {_R('bm', 5)} AS fused_score, CAST(0 AS DOUBLE) AS dense_score, {_R('bm', 4)} AS bm25_score, 'keyword' AS matched_by FROM r WHERE rank <= 8""",
    "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term",
    "token_count": r"SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / 0.75) AS INT) + 1 AS tokens FROM documents",
    "sentence_split": f"SELECT doc_id, CAST(unnest(range(0, len(s))) AS INT) AS at, unnest(s) AS sentence FROM (SELECT doc_id, {_INGEST} AS s FROM documents)",
    "metric_sentences": f"SELECT doc_id, CAST(len({_SPLIT.format(text='text', open='A-Z0-9(' + chr(92) + '[')}) AS INT) AS n_metric, CAST(len({_SPLIT.format(text='text', open='A-Z0-9' + chr(34) + '(' + chr(92) + '[')}) AS INT) AS n_chunk FROM documents",
    "hash_embed": f"WITH {_embed('dv', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, b AS bucket, {_R('x', 6)} AS x FROM dv",
    "dense_topk": f"WITH {_E}, {_dense(25)} SELECT qid, chunk_id, CAST(rank AS INT) AS rank, {_R('dense_score', 4)} AS dense_score FROM dense",
    "dense_topk_scoped": f"WITH {_E}, ow AS (SELECT dv.* FROM dv JOIN embeddings ON vec_id = id WHERE label = 3), {_dense(10, 'ow')} SELECT qid, chunk_id, CAST(rank AS INT) AS rank, {_R('dense_score', 4)} AS dense_score FROM dense",
    "bm25_idf": f"""WITH tf AS (SELECT DISTINCT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
        raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term)
        SELECT term, df, {_R('CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END', 6)} AS idf FROM raw""",
    "rerank": f"""WITH {_CANDIDATES}, f AS (SELECT *, {_RRF} AS fused FROM fused), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, rank) AS final_rank FROM f),
        t AS (SELECT r.qid, r.chunk_id, r.final_rank, list_distinct({_TERMS.format('b.text')}) AS asked, dt.terms FROM r JOIN benchmark b ON b.item_id = r.qid JOIN dt ON dt.chunk_id = r.chunk_id WHERE final_rank <= 20),
        s AS (SELECT qid, chunk_id, final_rank, {_R('len(list_intersect(asked, terms)) / len(asked)', 5)} AS rerank_score FROM t)
        SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, final_rank) AS INT) AS rank, rerank_score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, final_rank) <= 8""",
    "gold_relevant": _GOLD,
    "silver_relevant": f"WITH {_E}, {_dense(5)} SELECT qid, chunk_id FROM dense",
    "relevance_source": f"WITH {_TEXT_VECTORS}, {_dense(5)}, g AS ({_GOLD}) SELECT qid, chunk_id, 'gold' AS source FROM g WHERE qid % 2 = 0 UNION ALL SELECT qid, chunk_id, 'silver' FROM dense WHERE qid % 2 = 1",
    "ir_metrics": f"WITH {_LABELS}, {_ranking('(SELECT * FROM dense WHERE rank <= 10)')} SELECT qid, {', '.join(f'{_R(c, 4)} AS {c}' for c in _METRICS)} FROM m",
    "diversity": f"""WITH {_E}, {_dense(8)}, p AS (SELECT a.qid, a.rank AS i, b.rank AS j, sum(x.x * y.x) AS s FROM dense a JOIN dense b ON a.qid = b.qid AND a.rank < b.rank JOIN dv x ON x.id = a.chunk_id JOIN dv y ON y.id = b.chunk_id AND x.b = y.b GROUP BY a.qid, a.rank, b.rank)
        SELECT qid, {_R('1 - avg(s)', 4)} AS diversity FROM p GROUP BY qid""",
    "run_summary": f"""WITH {_LABELS}, {_ranking('(SELECT * FROM dense WHERE rank <= 10)')}, l AS (UNPIVOT (SELECT 'run' || CAST(qid // 20 % 2 AS INT) AS run_id, {', '.join(_METRICS)} FROM m) ON {', '.join(_METRICS)} INTO NAME metric VALUE value)
        SELECT run_id, metric, {_R('avg(value)', 4)} AS mean, {_R('median(value)', 4)} AS median, {_R('stddev_pop(value)', 4)} AS std, count(value) AS n FROM l GROUP BY run_id, metric""",
    "sweep_final_k": f"""WITH {_LABELS}, ks AS (SELECT unnest([1, 3, 5, 8, 10, 15, 20]) AS final_k), hk AS (SELECT * FROM dense JOIN ks ON rank <= final_k),
        {_ranking('hk', 'final_k, qid', '(SELECT final_k, vec_id AS qid FROM embeddings, ks WHERE vec_id % 20 = 0)')}
        SELECT final_k, {', '.join(f'{_R(f"avg({c})", 4)} AS {c}' for c in _METRICS)} FROM m GROUP BY final_k""",
    "sweep_weights": f"""WITH {_CANDIDATES}, ws AS (SELECT unnest(range(1, 21, 2)) AS w),
        sc AS (SELECT *, {_SCALE.format('dense_score')} AS ds, {_SCALE.format('CASE WHEN counted THEN bm ELSE 0 END')} AS ss FROM fused),
        rf AS (SELECT 'hybrid_rrf:' || w AS run_id, qid, chunk_id, rank, (w / 10.0) / (60 + rank) + CASE WHEN counted THEN 1.0 / (60 + sparse_rank) ELSE 0 END AS f FROM fused, ws
               UNION ALL SELECT 'hybrid_weighted:' || w, qid, chunk_id, rank, CAST(w / 10.0 AS DOUBLE) * ds + ss FROM sc, ws),
        hits AS (SELECT run_id, qid, chunk_id, nth AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY round(f, 9) DESC, rank) AS nth FROM rf) WHERE nth <= 8), rel AS ({_GOLD}),
        {_ranking('hits', 'run_id, qid', "(SELECT DISTINCT run_id, item_id AS qid FROM benchmark, (SELECT DISTINCT run_id FROM rf))")}
        SELECT run_id, count(recall_at_k) AS n, {_R('avg(recall_at_k)', 4)} AS recall_at_k, {_R('avg(mrr)', 4)} AS mrr FROM m GROUP BY run_id""",
    "sweep_mode": f"""WITH {_CANDIDATES}, {_mmr(8)},
        h1 AS (SELECT 'hybrid_rrf' AS mode, qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(f, 9) DESC, rank) AS rank FROM (SELECT *, {_RRF} AS f FROM fused)),
        h2 AS (SELECT 'hybrid_weighted' AS mode, qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(f, 9) DESC, rank) AS rank FROM (SELECT *, {_WEIGHTED} AS f FROM fused)),
        h3 AS (SELECT 'dense' AS mode, qid, chunk_id, rank FROM dense),
        h4 AS (WITH {_SPARSE} SELECT 'sparse' AS mode, qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(bm, 9) DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, {_BM25} AS bm FROM tf JOIN qt USING (term) JOIN idf USING (term) GROUP BY qid, chunk_id) WHERE bm > 0),
        h5 AS (SELECT 'mmr' AS mode, qid, chunk_id, nth AS rank FROM m8),
        hits AS (SELECT * FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4 UNION ALL SELECT * FROM h5) WHERE rank <= 8), rel AS ({_GOLD}),
        {_ranking('hits', 'mode, qid', "(SELECT mode, item_id AS qid FROM benchmark, (SELECT unnest(['hybrid_rrf', 'hybrid_weighted', 'dense', 'sparse', 'mmr']) AS mode))")}
        SELECT mode, count(recall_at_k) AS n, {_R('avg(recall_at_k)', 4)} AS recall_at_k, {_R('avg(mrr)', 4)} AS mrr FROM m GROUP BY mode""",
    "keyword_f1": rf"""WITH {_TEXT_VECTORS}, {_dense(1)}, pr AS (SELECT qid, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS e FROM dense JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = qid),
        ac AS (SELECT qid, t, count(*) AS n FROM (SELECT qid, unnest(a) AS t FROM pr) GROUP BY qid, t), ec AS (SELECT qid, t, count(*) AS n FROM (SELECT qid, unnest(e) AS t FROM pr) GROUP BY qid, t),
        cm AS (SELECT qid, sum(least(ac.n, ec.n)) AS c FROM ac JOIN ec USING (qid, t) GROUP BY qid)
        SELECT qid, {_R('CASE WHEN coalesce(c, 0) = 0 THEN 0 ELSE 2 * (c / len(a)) * (c / len(e)) / (c / len(a) + c / len(e)) END', 4)} AS keyword_f1 FROM pr LEFT JOIN cm USING (qid)""",
    "faithfulness": f"""WITH {_TEXT_VECTORS}, {_dense(5)}, st AS (SELECT {{'q': item_id, 's': unnest(range(0, len(s)))}} AS key, unnest(s) AS sentence FROM (SELECT item_id, {_SPLIT.format(text='text', open='A-Z0-9(' + chr(92) + '[')} AS s FROM benchmark)),
        {_embed('sv', 'st', 'key', 'sentence')}, ps AS (SELECT key.q AS qid, key FROM st),
        pc AS (SELECT ps.qid, ps.key, d.chunk_id, coalesce((SELECT sum(a.x * b.x) FROM sv a JOIN dv b ON a.b = b.b WHERE a.id = ps.key AND b.id = d.chunk_id), 0) AS c FROM ps JOIN dense d ON d.qid = ps.qid),
        bs AS (SELECT qid, key, max(c) AS best FROM pc GROUP BY qid, key)
        SELECT qid, {_R('avg((best + 1) / 2)', 4)} AS faithfulness, {_R('avg(CASE WHEN (best + 1) / 2 >= 0.5 THEN 1 ELSE 0 END)', 4)} AS supported_frac, {_R('avg(CASE WHEN best >= 0.55 THEN 1 ELSE 0 END)', 4)} AS context_recall FROM bs GROUP BY qid""",
    "answer_relevance": f"WITH {_E}, {_dense(2)} SELECT qid, {_R('(dense_score + 1) / 2', 4)} AS answer_relevance FROM dense WHERE rank = 2",
    "composite": f"""WITH {_LABELS}, {_ranking('(SELECT * FROM dense WHERE rank <= 10)')},
        an AS (SELECT qid, chunk_id, dense_score FROM dense WHERE rank = 2),
        su AS (SELECT an.qid, d.chunk_id, sum(x.x * y.x) AS c FROM an JOIN dense d ON d.qid = an.qid AND d.rank BETWEEN 3 AND 7 JOIN dv x ON x.id = an.chunk_id JOIN dv y ON y.id = d.chunk_id AND y.b = x.b GROUP BY an.qid, d.chunk_id),
        be AS (SELECT qid, max(c) AS c FROM su GROUP BY qid)
        SELECT m.qid, {_R('(context_precision + recall_at_k + (be.c + 1) / 2 + (dense_score + 1) / 2) / 4', 4)} AS composite FROM m JOIN be ON be.qid = m.qid JOIN an ON an.qid = m.qid""",
}
