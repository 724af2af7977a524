"""Rules of the operators on small tables: text, ranking, measures, tenancy, sources, state."""

import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import metrics as M
from quillstone.operators import relational as R
from quillstone.operators import retrieval as Q
from quillstone.sources import files
from quillstone.sources.chunk_table import ChunkTable
from quillstone.sources.sinks import EXPORT_COLUMNS, export_csv, json_safe
from quillstone.streaming import stateful as S


def one(spark, value, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(f(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, ["FAR 52.219-14, a/b c", "Schöpf", "", None], T.terms) == [["far", "52.219-14", "a/b", "c"], ["sch", "pf"], [], []]
    assert one(spark, ["a b c", "", " x "], T.token_count) == [5, 1, 2]
    assert one(spark, ["One.  Two! three? (Four) \t five"], T.sentences) == [["One.", "Two! three?", "(Four) five"]]
    assert one(spark, ["x" * 61, "word " * 30, " a \n b ", "", None, "y" * 60], T.title) == ["x" * 60 + "…", ("word " * 12).strip() + "…", "a b", "New chat", "New chat", "y" * 60]
    assert one(spark, ["itâ€™s", "plain"], T.repair) == ["it’s", "plain"]
    assert one(spark, [" yes", "No.", "maybe", ""], T.verdict) == [True, False, None, None]
    assert one(spark, ["hf:a/b:c", "model", "a/b:fast", "openrouter:x"], lambda c: T.model_ref(c)["model"]) == ["a/b:c", "model", "a/b:fast", "x"]
    assert one(spark, ["abcdefghi1", "abcdefghij", "short1"], T.password_ok) == [True, False, False]
    assert one(spark, ["  \n", "x", None], T.is_blank) == [True, False, True]
    assert one(spark, [2.675, 1.005, -0.00005], lambda c: T.rounded(c, 2), "double") == [2.68, 1.01, 0.0]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "far", "52.219-14", "omega"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 12))) for _ in range(60)]

    def vector(t):
        v = [0.0] * 64
        for w in t.lower().split():
            v[int(hashlib.md5(w.encode()).hexdigest(), 16) % 64] += 1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    chunks = [(i, t, vector(t)) for i, t in enumerate(texts)]
    questions = [(100 + i, t, vector(t)) for i, t in enumerate(("alpha beta 52.219-14", "gamma gamma omega", "unheard words"))]
    return chunks, questions, spark.createDataFrame(chunks, "chunk_id long, text string, vector array<double>"), spark.createDataFrame(questions, "qid long, question string, vector array<double>")


def bm25(query, texts):
    docs = [t.lower().split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    vocabulary = {w for d in docs for w in d}
    raw = {w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in vocabulary}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query.lower().split()) for d in docs]


def dense(chunks, vector, k):
    score = {i: sum(x * y for x, y in zip(v, vector, strict=True)) for i, _, v in chunks}
    return sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("mode", ["hybrid_rrf", "hybrid_weighted", "dense", "sparse", "mmr", "unknown"])
def test_search(corpus, mode):
    chunks, questions, chunk_table, question_table = corpus
    got = {}
    for r in Q.search(chunk_table, question_table, mode, dense_k=20, sparse_k=10, final_k=6, mmr_lambda=0.3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.chunk_id, r.fused_score))
    for qid, question, vector in questions:
        pool = dense(chunks, vector, 20)
        scores = bm25(question, [chunks[i][1] for i, _ in pool])
        ranked = [j for j in sorted(range(len(pool)), key=lambda j: (-round(scores[j], 9), j))[:10] if scores[j] > 0]
        if mode == "dense":
            want = dense(chunks, vector, 6)
        elif mode == "sparse":
            full = bm25(question, [t for _, t, _ in chunks])
            want = [x for x in sorted(enumerate(full), key=lambda x: (-round(x[1], 9), x[0]))[:6] if x[1] > 0]
        elif mode == "mmr":
            left, want = list(pool), []
            while left and len(want) < 6:
                like = lambda i: max((sum(x * y for x, y in zip(chunks[i][2], chunks[j][2], strict=True)) for j, _ in want), default=0.0)
                best = max(left, key=lambda x: (round(0.3 * x[1] - 0.7 * like(x[0]), 12), -left.index(x)))
                want.append(best)
                left.remove(best)
        elif mode == "hybrid_weighted":
            kept = [scores[j] if j in ranked else 0.0 for j in range(len(pool))]
            scale = lambda xs: [1.0] * len(xs) if max(xs) - min(xs) < 1e-9 else [(x - min(xs)) / (max(xs) - min(xs)) for x in xs]
            fused = [a + b for a, b in zip(scale([s for _, s in pool]), scale(kept), strict=True)]
            want = [(pool[j][0], fused[j]) for j in sorted(range(len(pool)), key=lambda j: (-round(fused[j], 9), j))[:6]]
        else:
            fused = [1 / (61 + j) + (1 / (61 + ranked.index(j)) if j in ranked else 0) for j in range(len(pool))]
            want = [(pool[j][0], fused[j]) for j in sorted(range(len(pool)), key=lambda j: (-round(fused[j], 9), j))[:6]]
        assert [(k + 1, i) for k, (i, _) in enumerate(want)] == [x[:2] for x in sorted(got.get(qid, []))]
        assert all(abs(a[2] - b[1]) < 1e-5 for a, b in zip(sorted(got.get(qid, [])), want, strict=True))


@pytest.mark.parametrize("k", [1, 8, 1000])
def test_stored_index(spark, tmp_path, k):
    """Segments, merged or not, give what a scan gives, and what is skipped changes nothing."""
    from quillstone.operators.inverted_index import InvertedIndex

    rng = random.Random(k)
    words = [f"w{n}" for n in range(120)] + ["a.b", "x-1"]
    pick = lambda n: " ".join(words[min(121, int(rng.expovariate(0.05)))] for _ in range(n))
    rows = [(i, pick(rng.randint(0, 60))) for i in range(700)] + [(900, None), (901, ""), (902, pick(20_000)), (903, "only here"), (904, pick(5)), (905, "only here")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(5)
    questions = spark.createDataFrame([(1, "w1 w2 w90"), (2, pick(30)), (3, "unknown terms"), (4, ""), (5, "only here w3 W3"), (6, None)], "qid long, question string")
    index = InvertedIndex(spark, str(tmp_path / "index"), 4, 50)
    assert index.top_k(questions, k).count() == 0
    for part in range(3):
        index.append(chunks.where(F.pmod("chunk_id", F.lit(3)) == part))
    want = sorted((r.qid, r["rank"], r.chunk_id, round(r.bm25_score, 9)) for r in Q.sparse_top_k(chunks, questions, k).collect())
    found = lambda: sorted((r.qid, r["rank"], r.chunk_id, round(r.bm25_score, 9)) for r in index.top_k(questions, k).collect())
    assert found() == want and len(want) > 2
    stats = lambda df: sorted((r.term, r.df, round(r.idf, 9), round(r.mean_length, 6)) for r in df.collect())
    assert stats(index.statistics()) == stats(Q.term_statistics(chunks)) and stats(index.statistics("n")) == stats(Q.term_statistics(chunks, "n"))
    index.merge()
    assert found() == want and len(index.state()["segments"]) == 1


def test_buckets_are_cut_as_chunks_grow(spark, tmp_path):
    """A term that all chunks have lies in several files, so that the task of its bucket doesn't grow with the table."""
    from quillstone.operators.inverted_index import InvertedIndex

    index = InvertedIndex(spark, str(tmp_path / "index"), 4, 10)
    index.append(spark.range(0, 1000, 1, 8).selectExpr("id AS chunk_id", "concat('all w', id % 7) AS text"))
    files = index.blocks().where("term = 'all'").select(F.input_file_name()).distinct().count()
    assert files > 4 and index.statistics().where("term = 'all'").first().df == 1000


def test_many_searches_as_one_plan(corpus):
    """Each run of search_all is what search gives by itself."""
    chunks, questions = corpus[2:]
    runs = {"a": {}, "b": {"mode": "dense", "final_k": 3}, "c": {"mode": "hybrid_weighted", "dense_k": 4, "sparse_weight": 0.3}, "d": {"mode": "mmr", "mmr_lambda": 0.7, "final_k": 2}, "e": {"mode": "sparse", "final_k": 2}, "f": {"rrf_k": 5, "sparse_k": 1, "dense_weight": 2}, "g": {"mode": "sparse"}, "h": {"mode": "other"}}
    got = {}
    for r in Q.search_all(chunks, questions, runs).collect():
        got.setdefault(r.run_id, set()).add(tuple(r)[1:])
    for name, settings in runs.items():
        assert got.get(name, set()) == {tuple(r) for r in Q.search(chunks, questions, **settings).collect()}, name


def test_modes_are_swept_with_one_ranking(corpus, monkeypatch):
    """All modes together rank the chunks once, and a vector that is made of a text is made for all chunks once and for candidates once more."""
    spark, chunks, questions = corpus[2].sparkSession, corpus[2].select("chunk_id", "text", F.col("vector").alias("own")), corpus[3]
    made, ranked = spark.sparkContext.accumulator(0), []

    @F.pandas_udf("array<double>")
    def vector(own: pd.Series) -> pd.Series:
        made.add(len(own))
        return own

    real = Q.dense_top_k
    monkeypatch.setattr(Q, "dense_top_k", lambda *a: ranked.append(a[2]) or real(*a))
    runs = {m: {"mode": m, "dense_k": 5, "final_k": 3} for m in ("hybrid_rrf", "hybrid_weighted", "dense", "sparse", "mmr")}
    got = {tuple(r) for r in Q.search_all(chunks, questions, runs, vector=vector("own")).collect()}
    n, asked = chunks.count(), questions.count()
    assert ranked == [5] and n < made.value <= n + 5 * asked
    want = {(m, *r) for m, own in runs.items() for r in Q.search(corpus[2], questions, **own).collect()}
    assert got == want and {r[0] for r in got} == set(runs)


def test_sweep_mode_builds_no_index(spark, sf_dir, monkeypatch):
    from quillstone.plans import retrieval as P

    ranked, real = [], Q.dense_top_k
    monkeypatch.setattr(Q, "dense_top_k", lambda *a: ranked.append(a[2]) or real(*a))
    monkeypatch.setattr(P, "_index", lambda *a: pytest.fail("one set of questions doesn't pay for an index"))
    assert P.sweep_mode(spark, sf_dir).count() == 5 and ranked == [25]


def test_sparse_terms_are_cut_before_lower_case(spark):
    """A Kelvin sign or a dotted capital I is no letter of a term, though its lower case is or holds one; as in SQL."""
    chunks = spark.createDataFrame([(1, "unit \u212a"), (2, "unit k"), (3, "\u0130x i"), (4, None), (5, "other"), (6, "other words"), (7, "")], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "k"), (2, "i"), (3, "x")], "qid long, question string")
    assert sorted((r.qid, r.chunk_id) for r in Q.sparse_top_k(chunks, questions, 5).collect()) == [(1, 2), (2, 3), (3, 3)]
    assert Q.terms_of("\u212aB \u0130C") == ["b", "c"]


@pytest.mark.parametrize("k", [1, 7, 40])
def test_dense_in_tiles(spark, monkeypatch, k):
    """Blocks, tiles and slices of any size give the k best, ties to the smaller id, and no tile holds all scores."""
    rng = np.random.default_rng(k)
    x = rng.integers(-3, 4, (900, 6)) / 4.0
    x[300:600] = x[:300]
    for name, size in (("TILE", 500), ("BLOCK", 60), ("KEPT", 30 * k)):
        monkeypatch.setattr(Q, name, size)
    ids = rng.permutation(900)
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(ids[a : a + 37]), pa.array(x[a : a + 37].tolist())], ["chunk_id", "vector"]) for a in range(0, 900, 37)])
    got = pa.Table.from_batches(Q._best_of_task(ids[:90], x[:90], k)(batches())).to_pylist()
    assert len(got) == 90 * k
    for j in range(90):
        want = sorted(zip(-np.round(x @ x[j], 9), ids.tolist(), strict=True))[:k]
        assert sorted((-round(r["dense_score"], 9), r["chunk_id"]) for r in got if r["qid"] == ids[j]) == want
    chunks = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "chunk_id long, vector array<double>").repartition(3)
    found = Q.dense_top_k(chunks, chunks.where("chunk_id < 70").withColumnRenamed("chunk_id", "qid"), k)
    assert found.count() == 70 * k and found.selectExpr("sum(chunk_id)").first()[0] == sum(i for j in np.flatnonzero(ids < 70) for _, i in sorted(zip(-np.round(x @ x[j], 9), ids.tolist(), strict=True))[:k])


def test_dense_scores_are_bounded():
    """A batch of 10,000 chunks for 5,000 questions makes 400 MB of scores if they are made at once."""
    import tracemalloc

    x = np.random.default_rng(0).random((10_000, 4))
    data = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(x.tolist())], ["chunk_id", "vector"])
    tracemalloc.start()
    n = sum(len(b) for b in Q._best_of_task(np.arange(5000), x[:5000], 5)(iter([data])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 25_000 and most < 100 << 20


def test_terms_are_counted_in_pieces():
    texts = ["a b " * 200_000, None, "", *["c d c " * 1000] * 600]
    data = pa.RecordBatch.from_arrays([pa.array(range(603)), pa.array(texts)], ["chunk_id", "text"])
    cut = list(Q.pieces(iter([data])))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([data])) and len(cut) > 4 and max(map(len, cut)) < 200
    found = list(Q._posted(iter([data])))
    assert len(found) == len(cut) and [tuple(r.values()) for r in pa.Table.from_batches(found).slice(0, 4).to_pylist()] == [(0, "a", 200_000, 400_000), (0, "b", 200_000, 400_000), (3, "c", 2000, 3000), (3, "d", 1000, 3000)]


def test_noise(corpus):
    _, _, chunks, questions = corpus
    hits = Q.search(chunks, questions, "dense")
    noisy = Q.inject_noise(hits, chunks, 0.67).collect()
    assert sum(r.injected_noise for r in noisy) == 3 * 5 and all(r.rank > 3 for r in noisy if r.injected_noise)
    assert len({(r.qid, r.chunk_id) for r in noisy}) == 24
    assert sorted(map(tuple, Q.inject_noise(hits, chunks, 0.0).collect())) == sorted(map(tuple, hits.collect()))


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (3, 1, 10)], "qid long, rank int, chunk_id long")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (3, 50), (4, 1)], "qid long, chunk_id long")
    runs = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "qid long")
    got = {r.qid: tuple(r)[1:] for r in M.ranking_metrics(runs, hits, relevant).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    assert got[1] == pytest.approx((2 / 3, 2 / 3, dcg / (1 + 1 / math.log2(3) + 0.5), 0.5, (1 / 2 + 2 / 3) / 2))
    assert got[2] == (None, 0.0, None, None, None)  # nothing is relevant
    assert got[3] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[4] == (0.0, None, None, 0.0, None)  # nothing is retrieved


def test_answer_metrics(spark):
    pairs = spark.createDataFrame([(1, "a b b c", "b b d"), (2, "x", None), (3, "", "y"), (4, "same", "SAME")], "qid long, answer string, expected string")
    got = {r.qid: r.keyword_f1 for r in M.keyword_f1(pairs).collect()}
    assert got == {1: pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)), 2: None, 3: 0.0, 4: 1.0}
    items = spark.createDataFrame([("r", 1.0, None), ("r", 3.0, float("nan")), ("r", None, 2.0)], "run_id string, a double, b double")
    stats = {r.metric: tuple(r)[2:] for r in M.run_summary(items, ["a", "b"]).collect()}
    assert stats == {"a": (2.0, 2.0, 1.0, 2), "b": (2.0, 2.0, 0.0, 1)}
    row = spark.range(1).select(M.composite(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5)), M.composite(F.lit(None).cast("double"))).first()
    assert row[0] == 0.75 and row[1] is None
    hints = spark.createDataFrame([(1, ["  Section L ", ""]), (2, []), (3, ["nowhere"])], "qid long, hints array<string>")
    chunks = spark.createDataFrame([(7, "SECTION L", "text"), (8, None, "see section l here")], "chunk_id long, section string, text string")
    gold = M.gold_relevant(hints, chunks)
    assert sorted(map(tuple, gold.collect())) == [(1, 7), (1, 8)]
    silver = spark.createDataFrame([(1, 5), (2, 6), (3, 9)], "qid long, chunk_id long")
    assert sorted(map(tuple, M.relevance_source(hints, gold, silver).collect())) == [(1, 7, "gold"), (1, 8, "gold"), (2, 6, "silver")]


def test_tenancy(spark):
    docs = spark.createDataFrame([("d1", "u1"), ("d2", "u1"), ("d3", "u2"), ("d4", None), ("d5", "")], "document_id string, user_id string")
    ids = lambda df: sorted(r.document_id for r in df.collect())
    assert ids(R.owned(docs, "u1")) == ["d1", "d2"] and ids(R.owned(docs, "u1", ["d2", "d3"])) == ["d2"] and ids(R.owned(docs, "u1", [])) == ["d1", "d2"]
    assert ids(R.owned(docs, "u1", docs.limit(0))) == ["d1", "d2"] and ids(R.owned(docs, "u1", docs.where("document_id = 'd2'"))) == ["d2"]
    assert ids(R.owned(docs, "stranger", [])) == []
    assert ids(R.owned(docs, "stranger")) == []
    with pytest.raises(ValueError):
        R.owned(docs, " ")
    registry = spark.createDataFrame([("d1",), ("d3",), ("d4",)], "document_id string")
    lost = R.orphans(docs, registry)
    assert ids(lost) == ["d2", "d4", "d5"]
    assert ids(R.orphans(docs.join(lost.select("document_id"), "document_id", "left_anti"), registry)) == []
    turns = spark.createDataFrame([(1, 1, "system", "s"), (1, 2, "user", " q "), (1, 3, "assistant", "a"), (1, 4, "user", "again"), (1, 5, "assistant", "  "), (2, 1, "user", "q")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in R.clean_turns(turns).collect()) == [(1, 2, "user", "q"), (1, 3, "assistant", "a")]
    assert sorted(r.turn for r in R.recent(turns.where("conv_id = 1"), 2).collect()) == [4, 5]
    assert [tuple(r) for r in spark.createDataFrame([(["b", "a", "b", None],), ([],), (None,)], "x array<string>").select(R.scope_json(F.col("x"))).collect()] == [('["a","b"]',), (None,), (None,)]


def test_chunk_table(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "chunks"))
    chunks = spark.createDataFrame([(0, "one", [1.0]), (1, "two", [0.5])], "chunk_index int, text string, vector array<double>")
    for user, doc in (("u1", "a"), ("u1", "b"), ("u2", "c")):
        table.append(chunks, user, doc)
    assert table.count("u1", "a") == 2 and table.read("u2").count() == 2 and table.read("u2", ["a"]).count() == 0
    assert table.delete_document("u2", "a") == 0 and table.delete_document("u1", "a") == 2 and table.count("u1", "a") == 0
    assert table.read("u1").count() == 2
    assert table.purge_orphans(spark.createDataFrame([("c",)], "document_id string")) == 2 and table.purge_orphans(spark.createDataFrame([("c",)], "document_id string")) == 0
    assert table.delete_user("u2") == 2 and table.read("u2").count() == 0


def test_chunk_table_with_odd_owners(spark, tmp_path):
    """Owners whose names mean something to a file system, or look like numbers."""
    table = ChunkTable(spark, str(tmp_path / "chunks"))
    chunks = spark.createDataFrame([(0, "one")], "chunk_index int, text string")
    owners = ["a/b", "../up", "x=y %", "007", "7"]
    for user in owners:
        table.append(chunks, user, "a")
        table.append(chunks, user, "b")
    assert [table.read(u).count() for u in owners] == [2] * 5 and {r.user_id for r in table.read("007").collect()} == {"007"}
    assert table.delete_document("a/b", "a") == 1 and table.read("a/b").count() == 1
    assert table.delete_user("../up") == 2 and table.delete_user("7") == 2
    assert [table.read(u).count() for u in owners] == [1, 0, 2, 2, 0]
    assert table.purge_orphans(spark.createDataFrame([("b",)], "document_id string")) == 2
    assert [table.read(u).count() for u in owners] == [1, 0, 1, 1, 0]
    assert table.purge_orphans(spark.createDataFrame([("c",)], "document_id string")) == 3 and table.read("007").count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["chunks"]


def test_chunk_table_is_idempotent_and_skips_files(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "a b" / "chunks"))
    rows = spark.createDataFrame([(k % 3, f"d{k // 3:03d}", "u1", f"s{k // 30}", f"t{k}") for k in range(90)], "chunk_index int, document_id string, user_id string, session_id string, text string")
    table.upsert(rows.where("document_id < 'd020'"))
    table.upsert(rows)
    table.upsert(rows)
    for _ in range(2):
        table.append(spark.createDataFrame([(0, "x"), (1, "y")], "chunk_index int, text string"), "u2", "d900", "s9")
    assert table.whole().count() == 92 and table.whole().select("point_id").distinct().count() == 92
    changed = rows.where("document_id = 'd004'").withColumn("text", F.lit("new"))
    table.upsert(changed)
    assert {r.text for r in table.read("u1", ["d004"]).collect()} == {"new"} and table.whole().count() == 92
    table.compact("u1", 20)
    whole = len(table.read("u1").inputFiles())
    one = table.read("u1", ["d004"])
    assert whole > 3 and len(one.inputFiles()) < whole and one.count() == 3 and len(table.read("u1", ["d004", "d029"]).inputFiles()) < whole
    assert table.read("u1", session_id="s2").count() == 30 and len(table.read("u1", session_id="s2").inputFiles()) < whole
    assert table.read("u1", ["nothing"]).count() == 0 and table.read("u2", ["d004"]).inputFiles() == []


def test_chunk_table_versions(spark, tmp_path, monkeypatch):
    """A failure between any two steps leaves the version before; who reads it keeps it; changes at the same time are both there."""
    table = ChunkTable(spark, str(tmp_path / "chunks"))
    chunks = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "chunk_index int, text string")
    table.append(chunks("one", "two"), "u1", "a")
    for step in ("_write", "_commit", "_files"):
        broken = ChunkTable(spark, table.path)
        whole = getattr(broken, step)

        def fails(*args, whole=whole, step=step):
            if step == "_write":
                whole(*args)
            raise OSError(step)

        monkeypatch.setattr(broken, step, fails)
        for change in (lambda t: t.append(chunks("three"), "u1", "a"), lambda t: t.delete_document("u1", "a"), lambda t: t.delete_user("u1"), lambda t: t.purge_orphans(spark.createDataFrame([], "document_id string"))):
            if step == "_write" and change.__code__.co_names[0] == "delete_user":
                continue
            with pytest.raises(OSError, match=step):
                change(broken)
            assert sorted(r.text for r in table.read("u1").collect()) == ["one", "two"]
    before = table.read("u1")
    other, wait = ChunkTable(spark, table.path), []
    commit = other._commit

    def late(state):
        if not wait:
            wait.append(table.append(chunks("b"), "u1", "b"))
        return commit(state)

    monkeypatch.setattr(other, "_commit", late)
    other.append(chunks("c"), "u1", "c")
    assert sorted(r.text for r in table.read("u1").collect()) == ["b", "c", "one", "two"]
    assert table.delete_document("u1", "a") == 2 and sorted(r.text for r in before.collect()) == ["one", "two"]
    assert table.read("u1", version=1).count() == 2
    table.vacuum()
    assert len(table.versions()) == 1 and table.read("u1").count() == 2 and len(list((tmp_path / "chunks" / "data").rglob("*.parquet"))) == 2


def test_orphans_without_owner(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "chunks"))
    rows = [(0, "a", "u1"), (0, "a", None), (1, "a", ""), (0, "gone", "u1"), (0, None, "u1"), (0, None, None)]
    table.upsert(spark.createDataFrame(rows, "chunk_index int, document_id string, user_id string").withColumn("session_id", F.lit(None).cast("string")))
    registry = spark.createDataFrame([("a",)], "document_id string")
    assert table.purge_orphans(registry) == 5 and table.purge_orphans(registry) == 0
    assert [(r.document_id, r.user_id) for r in table.whole().collect()] == [("a", "u1")]


def test_stream_into_chunk_table(spark, tmp_path):
    """A batch that is delivered twice is there once."""
    (tmp_path / "in").mkdir()
    table = ChunkTable(spark, str(tmp_path / "chunks"))
    schema = "chunk_index int, document_id string, user_id string, session_id string, text string"
    for k in range(3):
        spark.createDataFrame([(k, "d", "u", "s", f"t{k}")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second query has no memory of the first, its batches have the same numbers
        at = str(tmp_path / f"checkpoint{_}")
        stream.writeStream.foreachBatch(table.sink("chunks")).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in table.whole().collect()) == ["t0", "t1", "t2"] and len(table.versions()) == 3


def a_pdf(packed):
    """Two pages and an empty one: plain and deflated, with a map of codes, inherited fonts, escapes, and objects in a stream."""
    import zlib

    cmap = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0004> <00E9> endbfrange"
    first = b"BT /F1 12 Tf 72 700 Td (SECTION \\(A\\)) Tj 0 -14 Td [(Hel) 20 (lo) -300 (wor\\154d.)] TJ T* (Next) ' ET"
    second = zlib.compress(b"BT /F2 9 Tf 1 0 0 1 72 700 Tm <000100020003> Tj 1 0 0 1 72 650 Tm <0004> Tj ET")
    small = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R 10 0 R] /Count 3 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>"), (4, b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>"), (7, b"<< /Type /Font /BaseFont /Helvetica >>"), (8, b"<< /Type /Font /ToUnicode 9 0 R >>"), (10, b"<< /Type /Page /Parent 2 0 R >>")]
    streams = [(5, b"<< /Length %d >>" % len(first), first), (6, b"<< /Filter /FlateDecode /Length 11 0 R >>", second), (9, b"<< /Length %d >>" % len(cmap), cmap)]
    if packed:
        body = b" ".join(v for _, v in small)
        at = [sum(len(v) + 1 for _, v in small[:k]) for k in range(len(small))]
        head = b" ".join(b"%d %d" % (n, a) for (n, _), a in zip(small, at, strict=True)) + b" "
        streams.append((12, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>" % (len(small), len(head)), zlib.compress(head + body)))
        small = []
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in small) + b"".join(b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % x for x in streams) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages(spark, tmp_path):
    for packed in (False, True):
        (tmp_path / f"{packed}.pdf").write_bytes(a_pdf(packed))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing in here")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 4 0 R >>")
    got = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    for packed in ("False.pdf", "True.pdf"):
        assert [(p.number, p.text) for p in got[packed].pages] == [(1, "SECTION (A)\nHello world.\nNext"), (2, "Héê\në")]
    assert got["broken.pdf"].error == "no extractable text" and got["locked.pdf"].error == "the PDF file is encrypted"


def test_overlap_join(spark):
    """Against all pairs, and on one key with 100,000 pages."""
    from quillstone.operators import intervals as I

    rng = random.Random(6)
    some = lambda n, most: [(rng.choice(["a", "b", None]), rng.randint(-3000, 3000), rng.choice([0, 1, 7, rng.randint(0, most)])) for _ in range(n)]
    left, right = [(k, a, a + n) for k, a, n in some(120, 900)], [(k, a, a + n) for k, a, n in some(150, 5000)]
    left += [left[0], ("a", None, 5)]
    right += [right[0], ("a", 5, None)]
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"k string, {a} long, {b} long").withColumn(f"tag_{a}", F.lit(1))
    got = sorted((r.k, r.start, r.stop, r.from_, r.to_) for r in I.overlap_join(frame(left, "start", "stop"), frame(right, "from_", "to_"), ["k"], 4).collect())
    whole = lambda rows: [r for r in rows if None not in r]
    assert got == sorted((k, a, b, c, d) for k, a, b in whole(left) for j, c, d in whole(right) if j == k and c < b and d > a) and got
    pages = spark.range(100_000).select(F.lit("doc").alias("k"), (F.col("id") * 100).alias("from_"), (F.col("id") * 100 + 100).alias("to_"))
    spans = spark.range(50_000).select(F.lit("doc").alias("k"), (F.col("id") * 200 + 50).alias("start"), (F.col("id") * 200 + 250).alias("stop"))
    assert I.overlap_join(spans, pages, ["k"]).count() == 3 * 50_000 - 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"SECTION L\nplain \xff text")
    (tmp_path / "b.md").write_bytes(b"  \n ")
    (tmp_path / "c.exe").write_bytes(b"no")
    (tmp_path / "d.txt").write_bytes(b"")
    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "e.docx").write_bytes(data.getvalue())
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r.path.rpartition("/")[2]: ([p.text for p in r.pages] if r.pages is not None else None, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (["SECTION L\nplain  text"], None) and got["b.md"] == ([], "no extractable text") and got["e.docx"] == (["First\nSecond"], None)
    assert got["f.docx"][0] is None and got["f.docx"][1] and set(got) == {"a.txt", "b.md", "e.docx", "f.docx"}


def test_question_sets(spark, tmp_path):
    (tmp_path / "q.json").write_text('["plain?", {"question": "full?", "expected_answer": "yes", "relevant_sections": ["L"]}, {"expected_answer": "lost"}, ""]')
    (tmp_path / "q.csv").write_text("question,expected_answer,relevant_sections\nwhat?,this,A | B |\nbare?,,\n,none,\n")
    (tmp_path / "q.txt").write_text("first?\n\n  second, with comma?  \n")
    read = lambda n: [tuple(r) for r in files.sniff_questions(spark, str(tmp_path / n)).collect()]
    assert read("q.json") == [("plain?", None, None), ("full?", "yes", ["L"])]
    assert read("q.csv") == [("what?", "this", ["A", "B"]), ("bare?", None, None)]
    assert read("q.txt") == [("first?", None, None), ("second, with comma?", None, None)]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("q", 0.5, float("nan"), "extra")], "question string, mrr double, recall_at_k double, diversity string")
    export_csv(items, str(tmp_path / "out"))
    lines = [x.split(",") for x in "".join(p.read_text() for p in (tmp_path / "out").glob("part*")).splitlines()]
    head = list(EXPORT_COLUMNS)
    assert ",".join(head) == "question,answer,expected_answer,error,recall_at_k,precision_at_k,ndcg_at_k,mrr,context_precision,context_recall,faithfulness,answer_relevance,keyword_f1,composite_score,retrieval_ms,rerank_ms,generation_ms,total_ms"
    assert head in lines and [x[:8] for x in lines if x != head] == [["q", "", "", "", "", "", "", "0.5"]]
    assert tuple(json_safe(items).first()) == ("q", 0.5, None, "extra")


def brute_throttle(rows):
    recent, out = {}, {}
    for i, user, at, success in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        own = [t for t in recent.get(user, []) if at - t < 60]
        out[i] = len(own) < 8
        recent[user] = own if not out[i] else [] if success else [*own, at]
    return out


def test_throttle_table(spark):
    rng = random.Random(5)
    rows, at = [], 0.0
    for i in range(600):
        at += rng.choice([0.0, 1.0, 3.0, 5.0, 70.0]) if rng.random() < 0.9 else 60.0
        rows.append((i, rng.randrange(3), at, rng.random() < 0.05))
    got = {r.attempt_id: r.allowed for r in S.throttle_table(spark.createDataFrame(rows, "attempt_id long, user_id long, at double, success boolean")).collect()}
    assert got == brute_throttle(rows) and not all(got.values())


def test_throttle_stream(spark, tmp_path):
    rows = [(1, 1e9 + k, False) for k in range(10)] + [(2, 1e9, False)]
    schema = "user_id long, ts timestamp, success boolean"
    spark.createDataFrame(rows, "user_id long, at double, success boolean").select("user_id", F.timestamp_seconds("at").alias("ts"), "success").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = S.throttle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    got = {(r.user_id, r.at): r.allowed for r in spark.table("throttled").collect()}
    assert got == {**{(1, 1e9 + k): k < 8 for k in range(10)}, (2, 1e9): True}


def test_cooldowns(spark):
    errors = spark.createDataFrame([("m", "credit", 0.0), ("m", "rate", 100.0), ("n", "error", 100.0), ("o", "credit", 100.0)], "model string, kind string, at double")
    ready = lambda now: {r.model: r.ready for r in S.availability(errors, now).collect()}
    assert ready(129.0) == {"m": False, "n": False, "o": False} and ready(145.0) == {"m": True, "n": True, "o": False} and ready(50.0) == {"m": False}
    chain = spark.createDataFrame([("m", 1), ("z", 2)], "model string, priority int")
    cooldowns = spark.createDataFrame([("m", 110.5, True)], "model string, until double, credit boolean")
    served = spark.createDataFrame([("z", 4)], "model string, served long")
    assert sorted(tuple(r) for r in R.model_status(chain, cooldowns, served, 100.0).collect()) == [("m", 1, "exhausted", 10, 0), ("z", 2, "ready", 0, 4)]


TOPICS = ["river water flows under the old bridge", "stars shine over the dark desert", "bread is baked in a stone oven"]


@pytest.fixture(scope="module")
def lab(spark):
    """Six documents on three topics, and two questions: one with an answer, one with sections."""
    rng = random.Random(8)
    pages = lambda k: [(1, "SECTION A\n" + " ".join(f"Here {TOPICS[k % 3]} number{rng.randrange(50)}." for _ in range(12)))]
    docs = spark.createDataFrame([(k, pages(k)) for k in range(6)], "doc_id long, pages array<struct<number:int,text:string>>")
    questions = spark.createDataFrame([(1, TOPICS[0], "The " + TOPICS[0] + ".", None), (2, TOPICS[1], None, ["Section A"])], "qid long, question string, expected_answer string, relevant_sections array<string>")
    return docs, questions


def test_experiment(spark, lab, tmp_path):
    from quillstone.operators import experiment as E

    docs, questions = lab
    base = E.RunConfig(chunk_target_tokens=40, chunk_overlap_tokens=10, chunk_min_tokens=5, retrieval_mode="dense")
    configs = E.sweep(base, "final_k", [1, 2, 4]) + [base.with_axis("chunking_strategy", "nonsense"), base.with_axis("noise_pct", 0.67), base.with_axis("reranker_model", "terms")]
    configs += [base.with_axis("embed_model", "org/unknown"), base.with_axis("llm_model_id", "hf:unknown"), base.with_axis("reranker_model", "org/unknown")]
    found = E.run_all(configs, docs, questions, store=str(tmp_path / "chunks"))
    got = {(r.run_id, r.qid): r for r in found.collect()}
    for refused in ("chunking_strategy=nonsense", "embed_model=org/unknown", "llm_model_id=hf:unknown", "reranker_model=org/unknown"):
        assert got[refused, None].error
    assert len(got) == 14
    recall = [got[f"final_k={k}", 1].recall_at_k for k in (1, 2, 4)]
    assert recall == sorted(recall) and got["final_k=4", 1].relevance_source == "silver" and got["final_k=4", 2].relevance_source == "gold"
    for r in got.values():
        assert all(getattr(r, m) is None or -1e-9 <= getattr(r, m) <= 1 + 1e-9 for m in E.METRICS)
    assert got["final_k=4", 2].keyword_f1 is None and got["final_k=4", 1].keyword_f1 > 0 and got["noise_pct=0.67", 1].diversity > got["final_k=4", 1].diversity
    summary = {(r.run_id, r.metric): r for r in E.aggregate(found).collect()}
    assert summary["final_k=2", "recall_at_k"].corpus_size > 6 and summary["final_k=2", "recall_at_k"].n == 2 and summary["final_k=2", "recall_at_k"].n_questions == 2 and summary["final_k=2", "total_ms"].errors == 0
    assert summary["embed_model=org/unknown", "mrr"].errors == 1 and {m for _, m in summary} == {*E.METRICS, *E.TIMINGS}
    with pytest.raises(ValueError):
        base.with_axis("label", "x")
    assert E.RunConfig(embed_model="org/m", llm_model_id="hf:q").auto_label() == "fixed750_emb-m_hybrid_rrf_rr-none_k8_llm-q_noise0"


def test_configs_as_rows(spark):
    from quillstone.operators import experiment as E

    texts = ['{"final_k": 3, "unknown": 1}', '{"final_k": 3, "label": "x"}', "{}", '{"final_k": null, "noise_pct": 0.5}']
    rows = spark.createDataFrame([(t,) for t in texts], "value string").select(E.configs_from_json(F.col("value")).alias("c")).select("c", E.fingerprint(F.col("c")).alias("f")).collect()
    assert [E.from_row(r.c) for r in rows] == [E.RunConfig(final_k=3), E.RunConfig(final_k=3, label="x"), E.RunConfig(), E.RunConfig(noise_pct=0.5)]
    assert rows[0].f == rows[1].f and len({r.f for r in rows}) == 3 and all(len(r.f) == 10 for r in rows)
    named = E.as_rows(spark, [E.RunConfig(final_k=3), E.RunConfig(label="mine")]).orderBy("at").collect()
    assert [r.run_id for r in named] == [rows[0].f, "mine"]


def test_runs_with_models(spark, lab):
    """Every axis that names a model acts: each stub leaves its mark in the results."""
    from quillstone.functions.models import Models
    from quillstone.operators import experiment as E

    def embedder():
        return lambda texts: [[1.0, float("river" in t), float("stars" in t)] for t in texts]

    def scorer():
        return lambda q, p: [float(len(x) % 7) for x in p]

    def generator(temperature, most):
        def run(prompts):
            if temperature > 0.5:
                raise RuntimeError("too hot")
            return ["YES" if "Say YES or NO" in p and "river" in p.rpartition("Passage:")[2] else "NO" if "Say YES or NO" in p else f"The river at {temperature}." for p in prompts]

        return run

    def entailment():
        return lambda context, sentence: [0.9 if "river" in c else 0.1 for c in context]

    known = Models({"stub": embedder}, {"lengths": scorer}, {"echo": generator}, entailment)
    docs, questions = lab
    base = E.RunConfig(chunk_target_tokens=40, chunk_overlap_tokens=10, chunk_min_tokens=5, retrieval_mode="dense", final_k=3, llm_model_id="auto")
    from dataclasses import replace

    configs = [replace(base, label="base"), replace(base, embed_model="stub", label="embed"), replace(base, reranker_model="lengths", label="rerank"), replace(base, use_llm_judge=True, label="judge"), replace(base, faithfulness_mode="nli", label="nli"), replace(base, temperature=0.9, label="hot")]
    found = E.run_all(configs, docs, questions, known)
    got = {(r.run_id, r.qid): r for r in found.collect()}
    assert got["base", 1].answer == "The river at 0.0." and got["base", 1].generation_ms >= 0 and got["base", 1].total_ms is not None
    assert got["embed", 1].diversity < 1e-6 < got["base", 1].diversity and got["rerank", 1].rerank_ms >= 0
    assert got["judge", 1].relevance_source == "llm_judge" and got["judge", 1].precision_at_k == 1.0 and got["judge", 2].relevance_source == "gold"
    assert got["nli", 1].faithfulness == 0.9 and got["nli", 1].faithfulness_supported_frac == 1.0
    assert got["hot", 1].generation_error == "too hot" and got["hot", 1].answer is None and got["hot", 1].answer_relevance is None
    errors = {r.run_id: r.errors for r in E.aggregate(found).collect()}
    assert errors == {"base": 0, "embed": 0, "rerank": 0, "judge": 0, "nli": 0, "hot": 2}
    assert known.dimension("stub") == 3 and known.dimension("hash-64") == 64


def test_models_are_asked_once(spark, lab, tmp_path):
    """Calls are counted in a file: each distinct text, pair and prompt once, also when a run is repeated or was killed on its way."""
    from dataclasses import replace

    from quillstone.functions.models import Models
    from quillstone.operators import experiment as E

    log = str(tmp_path / "calls")

    def note(kind, items):
        with open(log, "a") as f:
            f.writelines(f"{kind}\n" for _ in items)

    def embedder():
        return lambda texts: (note("embed", texts), [[1.0, float("river" in t), float(len(t) % 5)] for t in texts])[1]

    def scorer():
        return lambda q, p: (note("score", q), [float(len(x) % 7) for x in p])[1]

    def generator(temperature, most):
        return lambda prompts: (note("judge" if "Say YES or NO" in prompts[0] else "answer", prompts), [f"YES, a river of {len(p)}." for p in prompts])[1]

    def entailment():
        return lambda c, s: (note("entail", c), [0.5 for _ in c])[1]

    def counts():
        from collections import Counter

        return Counter(open(log).read().split()) if (tmp_path / "calls").exists() else Counter()

    known = Models({"counted-vectors": embedder}, {"counted-pairs": scorer}, {"counted-answers": generator}, entailment)  # one name is one model in a worker
    docs, questions = lab
    base = E.RunConfig(chunk_target_tokens=40, chunk_overlap_tokens=10, chunk_min_tokens=5, retrieval_mode="dense", final_k=3, rerank_pool=5, reranker_model="counted-pairs", llm_model_id="counted-answers", embed_model="counted-vectors", use_llm_judge=True, faithfulness_mode="nli", label="all")
    rows = E.run_all([base], docs, questions, known, str(tmp_path / "store")).collect()
    first = counts()
    assert first["answer"] == 2 and first["score"] == 10 and first["judge"] == 3 and first["entail"] <= 6  # a section decides on the second question
    assert {r.relevance_source for r in rows} == {"llm_judge", "gold"} and all(r.retrieval_ms > 0 for r in rows)
    again = E.run_all([replace(base, label="again")], docs.union(docs.selectExpr("doc_id + 100", "pages")).limit(6), questions, known, str(tmp_path / "store")).collect()
    assert counts() == first and {r.answer for r in again} == {r.answer for r in rows}
    # A killed run has written half of its answers: the next one asks for the other half.
    from quillstone.sources.store import Store

    store = Store(spark, str(tmp_path / "killed"), portion=4)
    prompts = spark.createDataFrame([(k, f"p{k % 10}") for k in range(30)], "qid int, prompt string")
    half = prompts.where("qid < 5")
    call = lambda p: F.concat(p, F.lit("!"))
    assert {r.a for r in store.ask("answers", "m", half, [F.col("prompt")], call, "a").collect()} == {f"p{k}!" for k in range(5)}
    assert sorted((r.qid, r.a) for r in store.ask("answers", "m", prompts, [F.col("prompt")], call, "a").collect()) == [(k, f"p{k % 10}!") for k in range(30)]
    assert spark.read.parquet(store.folder("answers", "m")).count() == 10
    other = store.ask("answers", "other", half, [F.col("prompt")], lambda p: F.struct(p.alias("answer"), F.when(p == "p1", "bad").alias("error")), "a")
    assert {r.a.answer for r in other.collect() if r.a.error is None} == {"p0", "p2", "p3", "p4"}
    mended = store.ask("answers", "other", half, [F.col("prompt")], lambda p: F.struct(p.alias("answer"), F.lit(None).cast("string").alias("error")), "a")
    assert all(r.a.error is None for r in mended.collect()) and spark.read.parquet(store.folder("answers", "other")).count() == 6


def test_portions_read_what_is_theirs(spark, tmp_path, monkeypatch):
    """Portions together read their table once, however many there are, and of very many rows no more portions are made."""
    from quillstone.sources import store as S_

    rows = spark.range(0, 1000, 1, 3).selectExpr("id", "concat('t ', id) AS text")
    for portion, most, want in ((100, 100, 10), (100, 4, 4), (5000, 100, 1), (1, 7, 7)):
        monkeypatch.setattr(S_, "PORTIONS", most)
        parts = S_.Store(spark, str(tmp_path / "a b"), portion).portions(rows)
        files = [set(p.inputFiles()) for p in parts]
        assert len(parts) == want and len(set.union(*files)) == sum(map(len, files))
        assert sorted(r.id for p in parts for r in p.collect()) == list(range(1000))
        assert max(p.count() for p in parts) <= max(-(-1000 // want) + 100, 1000 // want * 2)
    assert S_.Store(spark, str(tmp_path / "none")).portions(rows.where("id < 0")) == []


def test_runs_share_passes_over_the_corpus(spark, lab, monkeypatch):
    """Configurations that share chunks rank them twice in all (hits and silver), look for hints once, and models that don't cut chunks share their texts."""
    from dataclasses import replace

    from quillstone.functions.models import Models
    from quillstone.operators import experiment as E

    calls = []
    for where, name in ((Q, "dense_top_k"), (E.M, "gold_relevant"), (E.K, "chunk")):
        monkeypatch.setattr(where, name, lambda *a, real=getattr(where, name), name=name: calls.append(name) or real(*a))
    docs, questions = lab
    known = Models({"marks": lambda: lambda texts: [[1.0, float("river" in t), float("stars" in t)] for t in texts]})
    base = E.RunConfig(chunk_target_tokens=40, chunk_overlap_tokens=10, chunk_min_tokens=5, final_k=3, label="a")
    configs = [base, replace(base, silver_relevance_k=2, label="b"), replace(base, reranker_model="terms", label="c"), replace(base, noise_pct=0.5, label="d"), replace(base, embed_model="marks", label="e")]
    got = {(r.run_id, r.qid): r for r in E.run_all(configs, docs, questions, known).collect()}
    assert len(got) == 10 and calls.count("dense_top_k") == 4 and calls.count("gold_relevant") == 2 and calls.count("chunk") == 1
    measures = lambda r: [None if getattr(r, m) is None else round(getattr(r, m), 9) for m in E.METRICS]
    for c in configs[3:4]:  # it is what it is alone
        alone = {r.qid: measures(r) for r in E.run_all([c], docs, questions, known).collect()}
        assert alone == {q: measures(got[c.label, q]) for q in (1, 2)}


def test_runs_that_fail_at_a_question(spark, lab):
    """Blank answers have no relevance, a failing reranker leaves no measures, an empty corpus nothing to retrieve."""
    from dataclasses import replace

    from quillstone.functions.models import Models
    from quillstone.operators import experiment as E

    def blank(temperature, most):
        return lambda prompts: [" " for _ in prompts]

    def broken():
        def run(q, p):
            raise RuntimeError("no scores")

        return run

    known = Models({}, {"broken": broken}, {"blank": blank})
    docs, questions = lab
    base = E.RunConfig(chunk_target_tokens=40, chunk_overlap_tokens=10, chunk_min_tokens=5, retrieval_mode="dense", final_k=3, llm_model_id="blank", label="blank")
    got = {(r.run_id, r.qid): r for r in E.run_all([base, replace(base, reranker_model="broken", label="broken")], docs, questions, known).collect()}
    assert got["blank", 1].answer_relevance is None and got["blank", 1].faithfulness is None and got["blank", 1].mrr is not None and got["blank", 1].generation_error is None
    assert got["broken", 1].generation_error == "reranking failed: no scores" and all(getattr(got["broken", 1], m) is None for m in E.METRICS)
    none = E.run_all([base], docs.limit(0), questions, known).collect()
    assert {r.generation_error for r in none} == {"no passages retrieved"} and all(r.mrr is None for r in none)


def test_corpus_of_an_owner(spark, tmp_path):
    from quillstone.operators import experiment as E

    (tmp_path / "a.txt").write_text("One sentence here. " * 30)
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("Not mine. " * 30)
    pages = files.read_documents(spark, str(tmp_path))
    at = lambda n: f"file:{tmp_path}/{n}"
    documents = spark.createDataFrame([(1, "u1", at("a.txt")), (2, "u1", at("b.docx")), (3, "u2", at("c.txt")), (4, "u1", at("gone.txt"))], "document_id long, user_id string, stored_path string")
    chunks, errors = E.corpus_chunks(documents, pages, "u1", E.RunConfig(chunk_min_tokens=5))
    assert {r.doc_id for r in chunks.collect()} == {1} and {r.document_id for r in errors.collect()} == {2, 4}
    assert chunks.first()["name"] == "1::0"
    own, bad = files.ingest(spark, str(tmp_path), least=5)
    assert own.select("doc_id").distinct().count() == 2 and [r.path.rpartition("/")[2] for r in bad.collect()] == ["b.docx"]
    saved = spark.createDataFrame([(7, "u1", "saved?", None, None)], "dataset_id long, user_id string, question string, expected_answer string, relevant_sections array<string>")
    inline = saved.select(F.lit("inline?").alias("question"), "expected_answer", "relevant_sections")
    asked = lambda *a: [r.question for r in E.resolve_questions(saved, *a).collect()]
    assert asked(inline, "u1", 7) == ["saved?"] and asked(inline, "u1") == ["inline?"] and asked(inline, "u2", 7) == []
    with pytest.raises(ValueError):
        E.resolve_questions(saved, None, "u1")


def test_chats(spark):
    chain = spark.createDataFrame([("m", "Model M", 1), ("n", "Model N", 2)], "model string, label string, priority int")
    cooldowns = spark.createDataFrame([("m", 110.5, False, "busy", 45.0)], "model string, until double, credit boolean, reason string, total double")
    served = spark.createDataFrame([("m", 3), ("n", 4)], "model string, served long")
    assert sorted(tuple(r) for r in R.model_chain(chain, cooldowns, served, 100.0).collect()) == [("m", "Model M", 1, "cooldown", False, "busy", 10, 45, 3), ("n", "Model N", 2, "ready", True, "", 0, 0, 4)]
    messages = spark.createDataFrame([("a", 1, 2.0, "user", None), ("a", 2, 1.0, "user", ""), ("a", 3, 1.0, "assistant", "[1]"), ("b", 4, 1.0, "user", None)], "chat_id string, seq long, created_at double, role string, sources string")
    assert [(r.chat_id, r.seq, r.nth) for r in R.transcript(messages).collect()] == [("a", 2, 1), ("a", 3, 2), ("a", 1, 3), ("b", 4, 1)]
    shown = R.public_message(messages.select(F.col("seq").alias("message_id"), "chat_id", "role", F.lit("text").alias("content"), "sources", "created_at"))
    assert sorted((r.message_id, r.sources) for r in shown.collect()) == [(1, "[]"), (2, "[]"), (3, "[1]"), (4, "[]")]
    chats = spark.createDataFrame([("a",), ("c",)], "chat_id string")
    got = {r.chat_id: [x.seq for x in r["items"]] for r in R.with_children(chats, messages, "chat_id", F.col("seq")).collect()}
    assert got == {"a": [1, 2, 3], "c": []}
    left, left_messages = R.cascade(chats.unionByName(spark.createDataFrame([("b",)], "chat_id string")), messages, "chat_id", F.col("chat_id") == "a")
    assert sorted(r.chat_id for r in left.collect()) == ["b", "c"] and [r.seq for r in left_messages.collect()] == [4]
    assert [tuple(r) for r in spark.createDataFrame([("[1,\"a\"]",), ("no",), ("{}",), (None,)], "x string").select(R.scope_from_json(F.col("x"))).collect()] == [(["a"],), (None,), (None,), (None,)]
    tried = spark.createDataFrame([(1, 1, "m", 503, 0), (1, 2, "n", 200, 5), (1, 3, "o", 200, 9), (2, 1, "m", 200, 0), (2, 2, "n", 500, 3)], "turn_id long, priority int, model string, status int, n_tokens int")
    assert {r.turn_id: (r.model, r.tried) for r in R.failover(tried).collect()} == {1: ("n", "m, n"), 2: (None, "m, n")}
    panel = R.source_panel(spark.range(1).selectExpr("id AS qid", "1 AS rank", "'f' AS filename", "1 AS page_start", "1 AS page_end", "'' AS section", "'t' AS text", "0.1 AS fused_score", "0.1 AS dense_score", "0.1 AS bm25_score", "'both' AS matched_by", "'secret' AS user_id"))
    assert len(panel.columns) == 11 and "user_id" not in panel.columns
    ids = spark.range(50).select(T.prefixed_id("chat_", 10).alias("i")).collect()
    assert len({r.i for r in ids}) == 50 and all(len(r.i) == 15 and r.i.startswith("chat_") for r in ids)


def test_models(spark):
    from quillstone.functions import models

    # local functions travel with the plan; a module of tests isn't on the workers
    def embedder():
        return lambda texts: [[3.0, 4.0] for _ in texts]

    def other():
        return lambda texts: [[1.0, 0.0] for _ in texts]

    def scorer():
        return lambda q, p: [len(a) + len(b) for a, b in zip(q, p, strict=True)]

    def failing():
        def run(prompts):
            raise RuntimeError("no model here")

        return run

    rows = spark.createDataFrame([("a b", "b c"), (None, "x")], "q string, p string")
    assert [r[0] for r in rows.select(models.shared_terms(F.col("q"), F.col("p"))).collect()] == [0.5, 0.0]
    got = rows.select(models.embed(F.col("p"), "three-four", embedder).alias("v"), models.embed(F.col("p"), "one", other).alias("w"), models.score(F.col("q"), F.col("p"), "sizes", scorer).alias("s"), models.generate(F.col("p"), "failing", failing).alias("g")).collect()
    assert [list(r.v) for r in got] == [[0.6, 0.8], [0.6, 0.8]] and [list(r.w) for r in got] == [[1.0, 0.0]] * 2 and [r.s.score for r in got] == [6.0, 1.0]
    assert got[0].g.error == "no model here" and got[0].g.answer is None
    assert rows.select(models.embed_text(F.col("p"), "intfloat/e5-small", True)).first()[0] == "query: b c"


def test_catalog(spark, tmp_path):
    from quillstone.sources.catalog import Catalog

    first = Catalog(spark, str(tmp_path), {"runs": "run_id string, user_id string"})
    first.open()
    first.insert("runs", [{"run_id": "r1", "user_id": "u1"}])
    catalog = Catalog(spark, str(tmp_path))  # a later version, with more tables and columns
    catalog.open()
    catalog.open()
    catalog.insert("runs", [{"run_id": "r2", "user_id": "u1", "status": "done", "created_at": 2.0}])
    catalog.insert("runs", spark.createDataFrame([("r2", "failed", 3.0)], "run_id string, status string, created_at double"))
    assert sorted((r.run_id, r.status or "") for r in spark.sql("SELECT * FROM runs").collect()) == [("r1", ""), ("r2", "done"), ("r2", "failed")]
    states = R.latest_state(catalog.table("runs").withColumn("at", F.coalesce("created_at", F.lit(0.0))), "run_id")
    assert {r.run_id: (r.user_id, r.status) for r in states.collect()} == {"r1": ("u1", None), "r2": ("u1", "failed")}
    for rows in ([{"run_id": "x", "other": 1}], spark.createDataFrame([(1,)], "other int")):
        with pytest.raises(ValueError):
            catalog.insert("runs", rows)
    assert spark.sql("SELECT * FROM messages").count() == 0


def test_credentials():
    from quillstone.functions import credentials as X

    stored = X.password_hash("correct horse 1")
    assert X.password_matches("correct horse 1", stored) and not X.password_matches("correct horse 2", stored)
    assert not any(X.password_matches("x", s) for s in ("", "plain", "scrypt$!$", "md5$YQ==$YQ=="))
    mark = X.signature("payload", "key")
    assert X.signed("payload", "key", mark) and not X.signed("payload", "other", mark) and not set("+/=") & set(mark)


def test_options_and_erasure(spark):
    from quillstone.operators import experiment as E

    docs = spark.createDataFrame([("a", "u1", 1.0), ("b", "u1", 2.0), ("c", "u2", 3.0), ("d", None, 4.0)], "document_id string, user_id string, upload_time double")
    rows = E.options(docs, "u1").collect()
    assert [r.value for r in sorted(rows, key=lambda r: r.at) if r.kind == "document"] == ["b", "a"] and {r.value for r in rows if r.kind == "axis"} == set(E.AXES)
    left = R.erase_owner({"documents": docs}, "u1")["documents"]
    assert sorted(r.document_id for r in left.collect()) == ["c", "d"]
    with pytest.raises(ValueError):
        R.erase_owner({"documents": docs}, " ")
