"""The chunkers by cases worked by hand and by what holds of any document."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking as K

STRATEGIES = ("fixed", "sentence", "recursive", "semantic")
SCHEMA = "doc_id long, pages array<struct<number:int,text:string>>"


def cut(rows, strategy, *sizes):
    """Semantic chunking needs a model to be named: the stand-in."""
    return K.chunk(rows, strategy, *sizes, embedder=K.HASHED if strategy == "semantic" else None)


def chunks(spark, documents, strategy, *sizes):
    """Chunks of each document in order: (text, first page, last page, section)."""
    out = {i: [] for i in range(len(documents))}
    found = cut(spark.createDataFrame(list(enumerate(documents)), SCHEMA), strategy, *sizes).orderBy("doc_id", "chunk_index").collect()
    for r in found:
        assert r.chunk_index >= len(out[r.doc_id])
        out[r.doc_id].append((r.text, r.page_start, r.page_end, r.section))
    return [out[i] for i in range(len(documents))]


# Sentences of three words count 5 tokens, of six words 9.
A, B, C, D = "Alpha one two.", "Beta one two.", "Gamma one two.", "Delta one two."


def test_fixed_by_hand(spark):
    documents = [
        [(1, f"{A} {B} {C} {D}")],
        [(1, f"{A} {B}"), (2, f"{C}\n{D}")],
        [(1, f"SECTION A\n{A}\nSECTION B\n{B} {C}")],
        [(3, "Alone.")],
        [(1, "  \n"), (2, f"{A}\t {B}")],
        None,
    ]
    got = chunks(spark, documents, "fixed", 10, 0, 1)
    assert got[0] == [(f"{A} {B}", 1, 1, ""), (f"{C} {D}", 1, 1, "")]
    assert got[1] == [(f"{A} {B}", 1, 1, ""), (f"{C} {D}", 1, 2, "")]  # what follows a full chunk starts on its page
    assert got[2] == [(A, 1, 1, "SECTION A"), (f"{B} {C}", 1, 1, "SECTION B")]
    assert got[3] == [("Alone.", 3, 3, "")] and got[4] == [(f"{A} {B}", 2, 2, "")] and got[5] == []
    # An overlap of 5 carries one sentence over; the last chunk is the rest.
    assert [c[0] for c in chunks(spark, documents[:1], "fixed", 10, 5, 1)[0]] == [f"{A} {B}", f"{B} {C}", f"{C} {D}", D]
    # Chunks below the least are dropped: a lone sentence of five tokens.
    assert [c[0] for c in chunks(spark, documents[:1], "fixed", 10, 5, 6)[0]] == [f"{A} {B}", f"{B} {C}", f"{C} {D}"]


def test_spans_by_hand(spark):
    text = f"{A} {B} {C} {D}"
    assert [text[a:b] for a, b in K.sentence_spans(text)] == [A, B, C, D]
    assert [c[0] for c in chunks(spark, [[(1, text)]], "sentence", 10, 0, 1)[0]] == [f"{A} {B}", f"{C} {D}"]
    assert [c[0] for c in chunks(spark, [[(1, text)]], "sentence", 10, 5, 1)[0]] == [f"{A} {B}", f"{B} {C}", f"{C} {D}", D]
    paragraphs = "one two three\n\nfour five six\n\nseven eight nine ten eleven twelve. thirteen"
    assert [paragraphs[a:b] for a, b in K.recursive_spans(paragraphs, 9)] == ["one two three", "four five six", "seven eight nine ten eleven twelve", "thirteen"]
    assert [paragraphs[a:b] for a, b in K.recursive_spans(paragraphs, 100)] == [paragraphs]
    assert K.recursive_spans(" \n", 5) == []


def test_semantic_breaks_where_the_subject_changes(spark):
    river, stars = ["The river runs to the sea.", "The river runs in the valley.", "The river runs by the sea."], ["Stars shine over dark sand.", "Stars shine over dark stone."]
    text = " ".join(river + stars)
    assert [text[a:b] for a, b in K.semantic_spans(text, 1000)] == [" ".join(river), " ".join(stars)]
    assert len(K.semantic_spans(text, 5)) > 2  # groups far over the target are cut further


def test_places_by_hand(spark):
    pages = [(4, f"SECTION ONE\n{A}"), (5, f"{B}\nSECTION TWO\n{C}"), (9, D)]
    got = chunks(spark, [pages], "recursive", 5, 0, 1)[0]
    place = {text: (first, last, section) for text, first, last, section in got}
    assert place[A] == (4, 4, "SECTION ONE") and place[B] == (5, 5, "SECTION ONE") and place[C] == (5, 5, "SECTION TWO") and place[D] == (9, 9, "SECTION TWO")
    whole = chunks(spark, [pages], "sentence", 1000, 0, 1)[0]
    assert len(whole) == 1 and whole[0][1:3] == (4, 9)


@pytest.fixture(scope="module")
def documents():
    """Random documents whose words are all different, so that a chunk shows where it comes from."""
    rng = random.Random(11)
    out = [[(1, "x" * 5000)], [(2, "word " * 3000)]]
    for _ in range(25):
        n, pages = 0, []
        for number in range(rng.randint(1, 4)):
            parts = []
            for _ in range(rng.randint(1, 12)):
                size = rng.randint(1, 25)
                parts.append("W" + " w".join(str(n + k) for k in range(size)) + rng.choice([".", "!", "?", ""]))
                n += size
            pages.append((number + 1, rng.choice(["\n", "\n\n", " ", "\r\n"]).join(parts)))
        out.append(pages)
    return out


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize(("target", "overlap"), [(40, 10), (120, 20), (60, 0)])
def test_what_holds_of_all_chunks(spark, documents, strategy, target, overlap):
    for pages, found in zip(documents[2:], chunks(spark, documents[2:], strategy, target, overlap, 1), strict=True):
        said = [text.split() for text, *_ in found]
        numbers = [[int(w.lstrip("Ww").rstrip(".!?")) for w in own] for own in said]
        total = sum(len(t.split()) for _, t in pages)
        assert {n for own in numbers for n in own} == set(range(total))  # nothing is lost
        for own in numbers:
            assert own == list(range(own[0], own[-1] + 1))  # a chunk is one stretch
        for one, after in zip(numbers, numbers[1:], strict=False):
            shared = one[-1] - after[0] + 1
            assert 0 <= shared and (after[-1] > one[-1] or strategy == "fixed")
            assert K.token_count(" ".join("w" * max(0, shared))) <= overlap + 1 or shared == 0  # no more is carried over
        where = {}
        n = 0
        for number, t in pages:
            for _ in t.split():
                where[n] = number
                n += 1
        for own, (_, first, last, _) in zip(numbers, found, strict=True):
            assert first <= last and where[own[-1]] == last and first in where.values()
            if strategy != "fixed":
                assert where[own[0]] == first
        text = "".join(t + "\n\n" for _, t in pages)
        longest = max(K.token_count(text[a:b]) for a, b in K.sentence_spans(text))
        for own in said:
            assert K.token_count(" ".join(own)) <= K.OVERSIZE * target + longest
    for found in chunks(spark, documents[:2], strategy, target, overlap, 1):
        assert found and all(text for text, *_ in found)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_rows_without_text(spark, strategy):
    assert chunks(spark, [[], [(1, "")], [(1, " \n ")], None], strategy) == [[], [], [], []]
    assert cut(spark.createDataFrame([], SCHEMA), strategy).collect() == []
    twice = spark.createDataFrame([(1, [(1, A)]), (1, [(1, A)]), (None, [(1, A)])], SCHEMA)
    assert sorted((r.doc_id or 0, r.chunk_index) for r in cut(twice, strategy, 10, 0, 1).collect()) == [(0, 0), (1, 0), (1, 0)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        K.chunk(spark.createDataFrame([], SCHEMA), "other")


def test_heading(spark):
    lines = {
        "SECTION L - INSTRUCTIONS": True, "A.1.2": True, "C.3.1 Reporting": True, "3.2 Scope of Work": True, "ALL CAPS HEADINGS": True, "ABCD": False,
        "Plain text line": False, "": False, "  ": False, "X" * 91: False, "1.2.3.4 Deep": True, "3.2 lower": False,
    }
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string")
    got = {r.x: r.h for r in rows.select("x", T.heading(F.col("x")).alias("h")).collect()}
    assert {x: h is not None for x, h in got.items()} == lines and got["C.3.1 Reporting"] == "C.3.1 Reporting"


def test_semantic_chunks_are_those_of_the_model(spark):
    def by_length():
        return lambda texts: [[1.0, 0.0] if len(t) > 30 else [0.0, 1.0] for t in texts]

    def by_river():
        return lambda texts: [[1.0, 0.0] if "river" in t else [0.0, 1.0] for t in texts]

    text = "A river runs by. A river that runs on and on through all the land. Stars shine over the sand of a very wide desert. Stars fall. Stars rise."
    docs = spark.createDataFrame([(k, [(1, text)]) for k in range(3)], SCHEMA)
    texts = lambda name, make: [r.text for r in K.chunk(docs, "semantic", 12, 0, 1, (name, make)).where("doc_id = 1").orderBy("chunk_index").collect()]
    first, second = texts("length", by_length), texts("river", by_river)
    assert first != second and len(second) > 2
    assert [K.semantic_spans(text, 100, m()) for m in (by_length, by_river)][0] != K.semantic_spans(text, 100, by_river())
    with pytest.raises(ValueError, match="embedding model"):
        K.chunk(docs, "semantic")
    found = K.sentence_likeness(docs, ("river", by_river)).where("doc_id = 2").orderBy("at").collect()
    assert [(r.at, r.likeness, r.ends) for r in found] == [(0, 1.0, False), (1, 0.0, True), (2, 1.0, False), (3, 1.0, False)]


def test_sentences_of_a_batch_go_to_the_model_together():
    asked = []

    def embed(texts):
        asked.append(len(texts))
        return [[1.0, float(len(t))] for t in texts]

    texts = ["One. Two. Three.", "", "Only one.", "A. " * 3000]
    found = K.likeness([K.sentence_spans(t) for t in texts], texts, embed)
    assert [len(x) for x in found] == [2, 0, 0, 2999] and asked == [3003] and K.EMBEDDED > 3003


def test_breaks_are_those_of_the_sql_to_the_last_digit():
    import duckdb

    rng = np.random.default_rng(1)
    groups = {g: np.round(rng.random(n), 1 + g % 17) for g, n in enumerate(np.repeat((2, 3, 4, 5, 6, 7, 52), 200))}
    x = pd.DataFrame([(g, float(v)) for g, own in groups.items() for v in own], columns=["g", "x"])
    want = dict(duckdb.sql("SELECT g, quantile_cont(x, 0.25) FROM x GROUP BY g").fetchall())
    assert {g: K.quantile(own, 0.25) for g, own in groups.items()} == want
    vectors = rng.integers(0, 9, (500, 26)).astype(float)
    v = pd.DataFrame({"k": range(500), "v": vectors.tolist()})
    sql = "SELECT list_inner_product(v, n) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(n, n))) FROM (SELECT k, v, lead(v) OVER (ORDER BY k) AS n FROM v) WHERE n IS NOT NULL ORDER BY k"
    assert K.likeness([[(0, 1)] * 500], ["x"], lambda texts: vectors)[0].tolist() == [r[0] for r in duckdb.sql(sql).fetchall()]
