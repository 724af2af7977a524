"""Segmentation of documents into overlapping chunks of a token budget. No row moves.

A document is a row with pages array<struct<number:int,text:string>>. All strategies need sums over parts of parts, which a
fold over arrays would copy or evaluate again for each element; so they run over Arrow batches, each linear in
the text. Offsets count from 0, ends are exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.functions import text as T
from quillstone.functions import vectors as V

TARGET, OVERLAP, LEAST = 750, 150, 80
# The next two.
#: Where a chunk may be cut, coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: A semantic group is cut further from this many times the target on; groups end below this quantile of likeness.
OVERSIZE, QUANTILE = 1.6, 0.25
#: Sentences that a model gets at once, at most.
EMBEDDED = 4096
_SENTENCE_GAP = re.compile(rf"(?<=[.!?])\s+(?=[{T.OPENERS['chunk']}])")
_INGEST_GAP, _SPACES = re.compile(rf"(?<=[.!?])\s+(?=[{T.OPENERS['ingest']}])"), re.compile(r"[ \t]+")
_HEADING = re.compile(T.HEADING)
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("text", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("section", pa.string())])

Span = tuple[int, int]
Embedder = tuple[str, Callable[[], models.Embedder]]


def token_count(text: str) -> int:
    return int(len(text.split()) / 0.75) + 1


def sentence_spans(text: str) -> list[Span]:
    out, start = [], 0
    for gap in [*_SENTENCE_GAP.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        if not text[start:stop].isspace() and start < stop:
            out.append((start, stop))
        start = gap.end() if gap else stop
    return out


def recursive_spans(text: str, target: int) -> list[Span]:
    """Spans within the target where a separator allows it: what is over it is cut at the next finer one."""
    spans = [(0, len(text))] if text.strip() else []
    for sep in SEPARATORS:
        finer: list[Span] = []
        for start, stop in spans:
            if token_count(text[start:stop]) <= target:
                finer.append((start, stop))
                continue
            while start <= stop:
                end = text.find(sep, start, stop)
                end = stop if end < 0 else end
                if text[start:end].strip():
                    finer.append((start, end))
                start = end + len(sep)
        spans = finer
    return spans


def likeness(spans: list[list[Span]], texts: list[str], embed: Callable[[list[str]], np.ndarray]) -> list[np.ndarray]:
    """For each text the cosine of each sentence with the next one. The sentences of all texts are one list for the model, cut at a bound."""
    flat = [t[a:b] for own, t in zip(spans, texts, strict=True) if len(own) > 1 for a, b in own]
    found = [np.asarray(embed(flat[k : k + EMBEDDED]), np.float64) for k in range(0, len(flat), EMBEDDED)]
    vectors = np.concatenate(found) if found else np.zeros((0, 1))
    # One division comes last: of vectors of whole numbers all that is rounded before it is rounded alike everywhere.
    size = np.sqrt((vectors * vectors).sum(1))
    products, sizes = (vectors[:-1] * vectors[1:]).sum(1), size[:-1] * size[1:]
    cosines = np.divide(products, sizes, out=np.zeros_like(sizes), where=sizes > 0)
    out, at = [], 0
    for own in spans:
        n = len(own) if len(own) > 1 else 0
        out.append(cosines[at : at + n - 1] if n else np.zeros(0))
        at += n
    return out


def quantile(values: np.ndarray, share: float) -> float:
    """The interpolated quantile, rounded as DuckDB's quantile_cont rounds it: numpy's differs by a last digit, which moves what lies at the edge."""
    at = (len(values) - 1) * share
    low = int(at)
    ordered = np.sort(values)
    if np.isnan(ordered[-1]):
        return math.nan
    if at == low:
        return float(ordered[low])
    return math.fma(float(ordered[low]), 1 - (at - low), float(ordered[low + 1]) * (at - low))


def semantic_breaks(cosines: np.ndarray) -> list[int]:
    """The sentences after which a group ends: those whose likeness to the next one is below the quartile."""
    return np.flatnonzero(cosines < quantile(cosines, QUANTILE)).tolist() if len(cosines) else []


def _grouped(text: str, spans: list[Span], cosines: np.ndarray, target: int) -> list[Span]:
    """Sentences grouped between the breaks; groups far over the target are cut further."""
    if len(spans) < 2:
        return spans
    last = [*semantic_breaks(cosines), len(spans) - 1]
    groups = [(spans[a][0], spans[b][1]) for a, b in zip([0, *(k + 1 for k in last)], last, strict=False)]
    return [(a + s, a + e) for a, b in groups for s, e in (recursive_spans(text[a:b], target) if token_count(text[a:b]) > OVERSIZE * target else [(0, b - a)])]


def semantic_spans(text: str, target: int, embed: models.Embedder = V.hashed_vectors) -> list[Span]:
    """The groups of one text."""
    spans = sentence_spans(text)
    return _grouped(text, spans, likeness([spans], [text], embed)[0], target)


def pack(text: str, spans: list[Span], target: int, overlap: int, least: int) -> list[Span]:
    """Spans merged up to the target, each chunk beginning with the tail of the one before. The first one may be short."""
    sizes = [token_count(text[a:b]) for a, b in spans]
    out: list[Span] = []
    first, total = 0, 0  # the chunk at hand is spans[first:k]

    def end_before(k: int) -> None:
        nonlocal first, total
        body = text[spans[first][0] : spans[k - 1][1]].strip()
        if body and (not out or token_count(body) >= least):
            out.append((spans[first][0], spans[k - 1][1]))
        start, total = k, 0
        while start > first and total + sizes[start - 1] <= overlap:
            start -= 1
            total += sizes[start]
        first = start

    for k, size in enumerate(sizes):
        if first < k and total + size > target:
            end_before(k)
        total += size
        if total >= target:
            end_before(k + 1)
    if first < len(spans):
        end_before(len(spans))
    return out


class _Layout:
    """A document's whole text, and what lies where in it."""

    def __init__(self, pages: list[tuple[int, str]]) -> None:
        self.numbers, self.starts, self.ends = [], [], []
        self.heading_at, self.headings = [], []
        at = 0
        for number, text in pages:
            line_at = at
            for line in text.splitlines(keepends=True):
                bare = line.rstrip()
                if bare and len(bare) <= T.HEADING_LENGTH and _HEADING.match(bare):
                    self.heading_at.append(line_at)
                    self.headings.append(bare.strip())
                line_at += len(line)
            self.numbers.append(number)
            self.starts.append(at)
            self.ends.append(at + len(text))
            at += len(text) + 2
        self.text = "".join(t + "\n\n" for _, t in pages)

    def pages(self, start: int, stop: int) -> Span:
        """First and last page that a span touches; else the page around its start, else all pages."""
        touched = self.numbers[bisect.bisect_right(self.ends, start) : bisect.bisect_left(self.starts, stop)]
        if touched:
            return min(touched), max(touched)
        k = bisect.bisect_right(self.starts, start) - 1
        if k >= 0 and start < self.ends[k]:
            return self.numbers[k], self.numbers[k]
        return self.numbers[0], self.numbers[-1]

    def section(self, at: int) -> str:
        k = bisect.bisect_right(self.heading_at, at)
        return self.headings[k - 1] if k else ""


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _CHUNKS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS, strict=True)], schema=_CHUNKS)


def _spanned(strategy: str, target: int, overlap: int, least: int, embedder: Embedder | None):
    """Chunks of whole batches: sentences of all documents of a batch go to the model together."""

    def spans_of(texts: list[str]) -> list[list[Span]]:
        if strategy == "recursive":
            return [recursive_spans(t, target) for t in texts]
        sentences = [sentence_spans(t) for t in texts]
        if strategy == "sentence":
            return sentences
        cosines = likeness(sentences, texts, models.made(f"embedder {embedder[0]}", embedder[1]))
        return [_grouped(t, s, c, target) for t, s, c in zip(texts, sentences, cosines, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            layouts = [_Layout([(p["number"], p["text"]) for p in pages]) for pages in data.column("pages").to_pylist()]
            rows = []
            for doc_id, own, spans in zip(data.column("doc_id").to_pylist(), layouts, spans_of([x.text for x in layouts]), strict=True):
                for k, (a, b) in enumerate(pack(own.text, spans, target, overlap, least)):
                    if body := own.text[a:b].strip():
                        rows.append((doc_id, k, body, *own.pages(a, b), own.section(a)))
            yield _batch(rows)

    return run


def _fixed(pages: list[tuple[int, str]], target: int, overlap: int, least: int) -> Iterator[tuple[str, int, int, str]]:
    """Sentences of lines packed to the target; a heading ends a chunk and names what follows. Each sentence is counted once."""
    own: deque[tuple[str, int]] = deque()
    total, section = 0, ""
    first = last = pages[0][0] if pages else 1

    def whole() -> Iterator[tuple[str, int, int, str]]:
        body = " ".join(s for s, _ in own).strip()
        if body and token_count(body) >= least:
            yield body, first, last, section

    for number, text in pages:
        for line in text.split("\n"):
            bare = line.rstrip()
            if bare and len(bare) <= T.HEADING_LENGTH and _HEADING.match(bare):
                yield from whole()
                own.clear()
                total, section, first, last = 0, bare.strip(), number, number
                continue
            for part in _INGEST_GAP.split(_SPACES.sub(" ", line)):
                if not (sentence := part.strip()):
                    continue
                size = token_count(sentence)
                own.append((sentence, size))
                total, last = total + size, number
                if total >= target:
                    yield from whole()
                    kept = 0
                    for k, (_, n) in enumerate(reversed(own)):
                        if kept + n > overlap:
                            own = deque(list(own)[len(own) - k :])
                            break
                        kept += n
                    total, first, last = kept, number, number
    yield from whole()


def _packed_lines(target: int, overlap: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            rows = []
            for doc_id, pages in zip(data.column("doc_id").to_pylist(), data.column("pages").to_pylist(), strict=True):
                rows += [(doc_id, k, *c) for k, c in enumerate(_fixed([(p["number"], p["text"]) for p in pages], target, overlap, least))]
            yield _batch(rows)

    return run


#: The stand-in for a model, to be named by who wants it.
HASHED: Embedder = ("hash-64", lambda: V.hashed_vectors)


def _pages(docs: DataFrame) -> DataFrame:
    pages = F.coalesce("pages", F.array().cast("array<struct<number:int,text:string>>"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(pages, lambda p: ~T.is_blank(p["text"])).alias("pages"))


def chunk(docs: DataFrame, strategy: str = "fixed", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, embedder: Embedder | None = None) -> DataFrame:
    """doc_id, chunk_index, text, page_start, page_end, section of docs (doc_id, pages). Null pages give no chunk.

    embedder: the name and the factory of the model whose vectors decide where semantic chunks end; that strategy needs one.
    """
    if strategy not in ("fixed", "sentence", "recursive", "semantic"):
        raise ValueError(f"unknown chunking strategy: {strategy!r}")
    if strategy == "semantic" and embedder is None:
        raise ValueError("semantic chunking needs an embedding model")
    run = _packed_lines(target, overlap, least) if strategy == "fixed" else _spanned(strategy, target, overlap, least, embedder)
    return _pages(docs).mapInArrow(run, "doc_id long, chunk_index int, text string, page_start int, page_end int, section string")


_LIKE = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("likeness", pa.float64()), ("ends", pa.bool_())])


def sentence_likeness(docs: DataFrame, embedder: Embedder) -> DataFrame:
    """doc_id, at, likeness, ends of docs (doc_id, pages): how like each sentence is to the next one by a model, and whether a semantic group ends after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            ids, texts = data.column("doc_id").to_pylist(), [_Layout([(p["number"], p["text"]) for p in pages]).text for pages in data.column("pages").to_pylist()]
            found = likeness([sentence_spans(t) for t in texts], texts, models.made(f"embedder {embedder[0]}", embedder[1]))
            rows = [(i, k, float(x), k in ends) for i, own in zip(ids, found, strict=True) for ends in [set(semantic_breaks(own))] for k, x in enumerate(own)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in _LIKE]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LIKE, strict=True)], schema=_LIKE)

    return _pages(docs).mapInArrow(run, "doc_id long, at int, likeness double, ends boolean")
