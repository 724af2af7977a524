"""The pipeline against plain models of its stages, and the registered queries of the subpackage against DuckDB."""

from collections import Counter

import duckdb
import pytest
from test_llm_operators import brute_lines, brute_near, line_results

import corpus_pipeline
from quillstone.llm import common as C
from quillstone.llm import decontaminate, queries, quality, token_counts


def leaks(text, items):
    """Half of the five-word sequences of an item."""
    own = decontaminate.words_of(text)
    held = set(zip(*(own[k:] for k in range(5)), strict=False))
    for item in items:
        w = decontaminate.words_of(item)
        parts = list(zip(*(w[k:] for k in range(5)), strict=False))
        if parts and sum(p in held for p in parts) > len(parts) / 2:
            return True
    return False


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf_dir):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = C.table(spark, sf_dir, "documents")
    good = {r.doc_id for r in quality.judge_documents(docs, C.table(spark, sf_dir, "labels")).where("kept").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    left = [(i, t) for i, n, gone, t in brute_lines(left, 3).elements() if not gone or gone < n]
    one = {i for i, _, _, kept in brute_near(left) if kept}
    items = [r.text for r in C.table(spark, sf_dir, "benchmark").collect()]
    want = {i: t for i, t in left if i in one and not leaks(t, items)}
    assert set(got) == set(want) and len(got) > 50
    library = token_counts.model_at("piece_bpe_32k.model").processor
    for i, r in got.items():
        assert r.round_trip and r.n_tokens == len(r.ids) and library.decode(r.ids) == want[i]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").where("doc_id < 60")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, empty, sf_dir).count() == 0, name


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the stages use inside."""
    sentence = lambda a, n: " ".join(f"{a}{k % 97}x{k}" for k in range(n))
    rows = [
        (1, sentence("a", 80), "en", "s1", 5, "n", 1), (1, sentence("a", 80), "en", "s1", 5, "n", 1), (1, sentence("a", 80), "fr", None, None, None, None), (2, sentence("a", 80), "en", "s1", 5, "n", 1),
        (1, sentence("b", 90), "en", "s1", 5, "n", 1), (None, sentence("c", 60), None, None, None, None, None), (None, sentence("c", 60), "en", "s9", 1, "m", 2), (3, None, "en", "s1", 0, "n", 1), (3, None, "en", "s1", 0, "n", 1),
        (4, "", "en", "s1", 0, "n", 1), (None, None, None, None, None, None, None), (None, "", "fr", "s2", 0, "o", 3), (5, " \n\t\n ", "en", "s1", 4, "n", 1), (6, sentence("d", 60_000), "en", "s1", 1, "n", 1),
        (7, "\n".join(sentence(f"l{k}", 20) for k in range(6)), "en", "s1", 9, "n", 1), (8, "\n".join(["other head", *(sentence(f"l{k}", 20) for k in range(6)), "other tail"]), "en", "s1", 9, "n", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept_n int"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


def test_stages_with_awkward_rows(spark, sf_dir, awkward):
    """What each stage keeps of awkward rows, in all columns."""
    rows, frame = awkward
    want = {
        # Without labels of these documents the rules decide, here their number of words.
        "quality_rules": Counter(r for r in rows if len((r[1] or "").split()) >= 50),
        # The runs and long lines of an earlier document go; of equal rows all stay, of other ids none.
        "line_winnowing": None,
        "near_duplicates": None,
        "decontamination": Counter(rows),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, frame, sf_dir)
        assert left.schema.simpleString() == frame.schema.simpleString(), name
        got = Counter(tuple(r) for r in left.collect())
        if want[name] is not None:
            assert got == want[name], name
        elif name == "line_winnowing":
            kept, found = Counter(), line_results([r[:2] for r in rows], 3)
            for r in rows:
                _, n, gone, text = found[r[:2]]
                if not gone:
                    kept[r] += 1
                elif gone < n:
                    kept[(r[0], text, *r[2:4], len(text), *r[5:])] += 1
            assert got == kept
        else:
            assert not got - Counter(rows)
            wordless = Counter(r for r in rows if not (r[1] or "").split())
            assert got & wordless == wordless
            assert sorted(str(r[0]) for r in (got - wordless).elements()) == ["1", "1", "6", "7", "None"]
    ids = Counter((r.doc_id, r.n_tokens > 0, r.round_trip) for r in corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect())
    assert ids == Counter((r[0], bool(r[1]), True) for r in rows)


def test_tables_are_removed(spark, sf_dir, awkward):
    """A written result of a stage leaves no table of the stage behind."""
    from pathlib import Path

    folder = Path(C.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    own = C.Scratch(spark)
    with C.Scratch.watched():
        left = own.keep(corpus_pipeline.near_duplicates(spark, awkward[1], sf_dir), "left")
    assert left.count() > 0 and len(set(folder.glob("*")) - before) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = db.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {q.partition("_")[0] for q in entry.queries() if q.startswith("op")}
    assert entry.queries()["pipeline"]
