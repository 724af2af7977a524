"""Pluggable models: embedders, scorers, entailment and generators as Arrow batches, with stand-ins that need no download.

A model is a function over a whole batch. A factory makes it once in each worker, where it is kept under the name
that the caller gives it: one name is one model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]
Generator = Callable[[list[str]], list[str]]

_MADE: dict[str, object] = {}


def made(name: str, factory: Callable[[], object]) -> object:
    """What a factory makes, once a worker for each name."""
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


def loaded() -> list[str]:
    """The models that this process has made."""
    return sorted(_MADE)


@dataclass(frozen=True)
class Models:
    """Factories by name. A generator's factory takes temperature and most tokens; the first one is what "auto" stands for."""

    embedders: dict[str, Callable[[], Embedder]] = field(default_factory=dict)
    scorers: dict[str, Callable[[], Scorer]] = field(default_factory=dict)
    generators: dict[str, Callable[[float, int], Generator]] = field(default_factory=dict)
    #: The probability that a passage entails a sentence, of each pair.
    entailment: Callable[[], Scorer] | None = None

    def generator(self, name: str) -> str:
        return next(iter(self.generators), "extract") if name == "auto" else name

    def refuse_unknown(self, embedder: str, reranker: str, generator: str, nli: bool, judge: bool) -> None:
        """An error for what has no model: a run must not report a stand-in's numbers as another model's."""
        if embedder != "hash-64" and embedder not in self.embedders:
            raise ValueError(f"no embedding model: {embedder!r}")
        if reranker not in ("none", "terms") and reranker not in self.scorers:
            raise ValueError(f"no reranking model: {reranker!r}")
        if self.generator(generator) != "extract" and generator != "auto" and generator not in self.generators:
            raise ValueError(f"no generating model: {generator!r}")
        if nli and self.entailment is None:
            raise ValueError("no entailment model")
        if judge and self.generator(generator) == "extract":
            raise ValueError("no model to judge with")

    def embed(self, text: Column, name: str, query: bool = False) -> Column:
        return V.hashed_vector(text) if name == "hash-64" else embed(embed_text(text, name, query), name, self.embedders[name])

    def embedder(self, name: str) -> tuple[str, Callable[[], Embedder]]:
        """Name and factory of a model over lists of texts, as passages; the stand-in is one of hashed words."""
        if name == "hash-64":
            return name, lambda: V.hashed_vectors
        make, front = self.embedders[name], passage_prefix(name)
        return f"{name} passages", lambda: (lambda model: lambda texts: model([front + t for t in texts]))(make())

    def dimension(self, name: str) -> int:
        """Length of a model's vectors, from one call on the driver."""
        return V.BUCKETS if name == "hash-64" else int(np.asarray(made(f"embedder {name}", self.embedders[name])(["x"])).shape[1])


def passage_prefix(model: str) -> str:
    return "passage: " if "e5-" in model.lower() else ""


def embed_text(text: Column, model: str, query: bool = False) -> Column:
    """The text with what its model wants in front."""
    prefix = "query: " if query else passage_prefix(model)
    instruction = "Represent this sentence for searching relevant passages: " if query else ""
    return F.concat(F.lit(prefix if "e5-" in model.lower() else instruction), text)


def embed(text: Column, name: str, factory: Callable[[], Embedder]) -> Column:
    """Unit vectors of a text column by another model."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = made(f"embedder {name}", factory)
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("").tolist()), np.float64)
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)))

    return run(text)


def score(left: Column, right: Column, name: str, factory: Callable[[], Scorer]) -> Column:
    """struct(score, error, ms) of pairs by a model such as a cross encoder or an entailment model; ms is a pair's share of its batch.

    A model that fails gives the error, never a failed job.
    """

    @F.pandas_udf("score double, error string, ms double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = made(f"scorer {name}", factory)
        for q, p in batches:
            start = time.perf_counter()
            try:
                found: dict[str, object] = {"score": np.asarray(model(q.fillna("").tolist(), p.fillna("").tolist()), np.float64), "error": None}
            except Exception as e:
                found = {"score": np.full(len(q), np.nan), "error": [str(e)[:300]] * len(q)}
            yield pd.DataFrame(found | {"ms": 1000 * (time.perf_counter() - start) / max(1, len(q))}, index=range(len(q)))

    return run(left, right)


def generate(prompt: Column, name: str, factory: Callable[[], Generator]) -> Column:
    """struct(answer, error, ms) of each prompt; a model that fails gives the error, never a failed job."""

    @F.pandas_udf("answer string, error string, ms double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = made(f"generator {name}", factory)
        for prompts in batches:
            start = time.perf_counter()
            try:
                found: dict[str, object] = {"answer": model(prompts.fillna("").tolist()), "error": None}
            except Exception as e:
                found = {"answer": [None] * len(prompts), "error": str(e)[:300]}
            yield pd.DataFrame(found | {"ms": 1000 * (time.perf_counter() - start) / max(1, len(prompts))})

    return run(prompt)


#: Characters of a passage that a judge sees.
JUDGED = 1500


def judge_prompt(question: Column, passage: Column) -> Column:
    return F.concat(F.lit("Does this passage help to answer the question? Say YES or NO.\n\nQuestion: "), question, F.lit("\n\nPassage: "), F.substring(passage, 1, JUDGED))


def shared_terms(question: Column, passage: Column) -> Column:
    """A stand-in for a cross encoder: the share of the question's terms that the passage has."""
    asked = F.array_distinct(T.terms(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, T.terms(passage))), F.size(asked)), F.lit(0.0))


def extract(passage: Column, length: int = 300) -> Column:
    """A stand-in for a generator: the begin of the best passage."""
    return F.substring(passage, 1, length)
