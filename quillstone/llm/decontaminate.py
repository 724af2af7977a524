"""Benchmark decontamination: a BM25 index of test items, searched with every passage of the corpus.

A passage is a stretch of words; stretches overlap by half, so an item of up to half a stretch lies in
one as a whole. Items of up to 64 words meet stretches of 128, longer ones those of a class of their own length, the next power
of two: what an item matches doesn't depend on how long others are. The score of an item is its BM25 score for the distinct words of the passage, as a share of its
score for its own words. All items at or above a threshold are retrieved by block-max WAND over many
passages at once: items lie in blocks; for each word a block has the maximum of what it can add there.

 1. The most frequent words can't reach the threshold by themselves: what they add to any item of a
    block is bounded beforehand. The others, which are rare in passages, are looked up, and the maxima of
    a passage's words are summed by block. Blocks whose sum and bound stay below the threshold are skipped.
 2. For those left, the sum is taken over all words of the passage, and blocks below it are skipped.
 3. The items of the blocks left are scored exactly.

An item that is retrieved counts only if both its question and its answer overlap with the passage.
Document frequencies, number and lengths of items are counted once, over all items. The index is cut into shards of a
bounded size, and a bounded number of shards is sent to all tasks and searched in one pass over the documents; the
result is the same however items are cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved.
THRESHOLD = 0.6
#: Share of the trigrams of the question, and of the answer, that the passage must hold; of bigrams or words where these are short.
OVERLAP = 0.5
PASSAGE_WORDS = 128
BLOCK_ITEMS = 16
#: What the frequent words may add to an item, as a share of its score.
FREQUENT_SHARE = 0.35
#: Bytes of items in a shard of the index, about, and shards that are searched in one pass.
SHARD_BYTES, PASS_SHARDS = 4 << 20, 4

_WORD = re.compile(r"\w+")
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
MATCH_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


#: Of ASCII text, what is in no word becomes a space.
_ASCII = {c: " " for c in range(128) if not _WORD.match(chr(c))}


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    if not text:
        return []
    text = text.lower()
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer, of five words at least but no more than half of all."""
    whole = words_of(text)
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text) if (w := words_of(s))]
    n = min(max(5, len(sentences[-1]) if len(sentences) > 1 else len(whole) // 2), len(whole) // 2)
    return whole[: len(whole) - n], whole[len(whole) - n :]


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's trigrams that a passage holds; of its bigrams below eight words, of its words below five.

    One changed word takes three trigrams or two bigrams: so it leaves half at least of each part of two words and more.
    """
    if not part:
        return 1.0
    n = 3 if len(part) >= 8 else 2 if len(part) >= 5 else 1
    own, held = (set(zip(*(words[k:] for k in range(n)), strict=False)) for words in (part, passage))
    return len(own & held) / len(own)


@dataclass(frozen=True)
class Match:
    item_id: int
    score: float
    question_overlap: float
    answer_overlap: float
    first_word: int


@dataclass(frozen=True)
class Statistics:
    """Of all items: how many have words, their mean length, and how many of them hold each word (of a shard)."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Statistics:
        own = [w for _, t in items if (w := words_of(t))]
        return cls(len(own), sum(map(len, own)) / max(1, len(own)), Counter(w for words in own for w in set(words)))


class Index:
    """Items of one class of length: block-max postings, and each item's parts. Without statistics its items are all there are."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, passage_words: int = PASSAGE_WORDS, statistics: Statistics | None = None) -> None:
        about = statistics or Statistics.of(items)
        found = [(i, Counter(w), len(w), t) for i, t in items if (w := words_of(t))]
        found.sort(key=lambda x: (x[2], x[0]))  # items of like length and impact share blocks
        self.threshold = threshold
        self.items = [i for i, *_ in found]
        self.parts = [question_and_answer(t) for *_, t in found]
        self.passage_words = passage_words
        self.blocks = math.ceil(len(found) / BLOCK_ITEMS)
        df = {w: about.df[w] for _, tf, _, _ in found for w in tf}
        self.vocabulary = {w: k for k, w in enumerate(sorted(df, key=lambda w: (-df[w], w)))}
        words, item, impact = [], [], []
        for k, (_, tf, n, _) in enumerate(found):
            own = {w: math.log1p((about.n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / about.mean)) for w, f in tf.items()}
            whole = math.fsum(own.values())
            words += [self.vocabulary[w] for w in own]
            item += [k] * len(own)
            impact += [x / whole for x in own.values()]
        order = np.lexsort([item, words]) if words else np.zeros(0, np.int64)
        self.word, self.item, self.impact = np.array(words, np.int64)[order], np.array(item, np.int64)[order], np.array(impact)[order]
        self.starts = np.searchsorted(self.word, np.arange(len(df) + 1))
        # By word and block, the largest impact.
        block = self.item // BLOCK_ITEMS
        edge = np.flatnonzero(np.diff(self.word * (self.blocks + 1) + block, prepend=-1))
        self.max_block = block[edge]
        self.max_impact = np.maximum.reduceat(self.impact, edge) if len(edge) else np.zeros(0)
        self.max_starts = np.searchsorted(self.word[edge], np.arange(len(df) + 1))
        # The frequent words: as many as can't add more than their share to any item.
        self.frequent, added = 0, np.zeros(len(found))
        for k in range(len(df)):
            at = slice(self.starts[k], self.starts[k + 1])
            if (added[self.item[at]] + self.impact[at]).max() > FREQUENT_SHARE * threshold / THRESHOLD:
                break
            added[self.item[at]] += self.impact[at]
            self.frequent = k + 1
        self.bound = np.array([added[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(self.blocks)])

    def _spread(self, passages: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum by passage and block of the maxima of the words: keys passage * blocks + block, and sums."""
        n = self.max_starts[words + 1] - self.max_starts[words]
        at = np.repeat(self.max_starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys, index = np.unique(np.repeat(passages, n) * self.blocks + self.max_block[at], return_inverse=True)
        return keys, np.bincount(index, self.max_impact[at], len(keys))

    def retrieve(self, ids: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score of all that reach the threshold. ids: the places' words, -1 if unknown, of texts of these lengths, one after the other.

        A text has a passage for each half stretch that it begins, numbered over all texts.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(ids >= self.frequent)
        if not len(at):
            return none
        half, size = self.passage_words // 2, len(self.vocabulary)
        starts, lengths, bases = self._layout(np.array([len(ids)]) if lengths is None else lengths)
        # The two passages that hold each place; the first half of a text lies in one alone.
        text = np.searchsorted(starts, at, "right") - 1
        nth = (at - starts[text]) // half
        pairs = np.unique(np.concatenate((bases[text] + nth, bases[text] + np.maximum(nth - 1, 0))) * size + np.tile(ids[at], 2))
        keys, sums = self._spread(pairs // size, pairs % size)
        keys = keys[sums + self.bound[keys % self.blocks] >= self.threshold - 1e-9]
        if not len(keys):
            return none
        # All words of the passages left.
        wanted = np.unique(keys // self.blocks)
        text = np.searchsorted(bases, wanted, "right") - 1
        first = starts[text] + (wanted - bases[text]) * half
        n = np.minimum(first + 2 * half, starts[text] + lengths[text]) - first
        own = ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        owner = np.repeat(wanted, n)
        pairs = np.unique(owner[own >= 0] * size + own[own >= 0])
        passages, words = pairs // size, pairs % size
        full, sums = self._spread(passages, words)
        keys = np.intersect1d(keys, full[sums >= self.threshold - 1e-9])
        # The items of the blocks left.
        n = self.starts[words + 1] - self.starts[words]
        at = np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        passage, item = np.repeat(passages, n), self.item[at]
        ok = np.isin(passage * self.blocks + item // BLOCK_ITEMS, keys)
        pair, index = np.unique(passage[ok] * len(self.items) + item[ok], return_inverse=True)
        score = np.bincount(index, self.impact[at][ok], len(pair))
        reached = score >= self.threshold - 1e-9
        return pair[reached] // len(self.items), pair[reached] % len(self.items), np.round(score[reached], 9)

    def _layout(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the texts that have words begin, their lengths, and the number of each one's first passage. Others get no passage."""
        half = self.passage_words // 2
        passages = -(-lengths // half)
        some = lengths > 0
        return (np.cumsum(lengths) - lengths)[some], lengths[some], (np.cumsum(passages) - passages)[some]

    def search(self, texts: list[str | None], least_overlap: float = OVERLAP) -> list[list[Match]]:
        """For each text, the items that it leaks: of each the passage with the highest score."""
        return self.matches([words_of(t) for t in texts], least_overlap)

    def matches(self, words: list[list[str]], least_overlap: float) -> list[list[Match]]:
        half = self.passage_words // 2
        out: list[list[Match]] = [[] for _ in words]
        lengths = np.array([len(w) for w in words], np.int64)
        if not self.items or not lengths.sum():
            return out
        get = self.vocabulary.get
        passages, items, scores = self.retrieve(np.concatenate([np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for w in words]), lengths)
        of = np.flatnonzero(lengths)
        _, _, bases = self._layout(lengths)
        text = np.searchsorted(bases, passages, "right") - 1
        best: dict[tuple[int, int], Match] = {}
        for i, score, k, first in zip(items.tolist(), scores.tolist(), of[text].tolist(), ((passages - bases[text]) * half).tolist(), strict=True):
            own = words[k][first : first + 2 * half]
            question, answer = (overlap(part, own) for part in self.parts[i])
            if question >= least_overlap and answer >= least_overlap:
                m = Match(self.items[i], score, question, answer, first)
                if (k, i) not in best or (m.score, -m.first_word) > (best[k, i].score, -best[k, i].first_word):
                    best[k, i] = m
        for (k, _), m in sorted(best.items()):
            out[k].append(m)
        return out


class Shard:
    """Items of any length: an index for each class of lengths."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, passage_words: int = PASSAGE_WORDS, statistics: Statistics | None = None) -> None:
        about, classes = statistics or Statistics.of(items), defaultdict(list)
        for i, t in items:
            size, n = passage_words, len(words_of(t))
            while size < 2 * n:
                size *= 2
            classes[size].append((i, t))
        self.indexes = [Index(own, threshold, size, about) for size, own in sorted(classes.items())]

    def search(self, texts: list[str | None], least_overlap: float = OVERLAP) -> list[list[Match]]:
        words = [words_of(t) for t in texts]
        found = [index.matches(words, least_overlap) for index in self.indexes]
        return [[m for own in of_text for m in own] for of_text in zip(*found, strict=True)] if found else [[] for _ in texts]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct words with the number of all of its words; items without words give no row."""
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.string()))])
    for data in batches:
        own = [words_of(t) for t in data.column("text").to_pylist()]
        yield C.batch(schema, data.column("shard"), [len(w) for w in own], [sorted(set(w)) for w in own])


def shards(items: DataFrame, threshold: float, passage_words: int, shard_bytes: int) -> Iterator[tuple[Shard, bool]]:
    """Shards of all items, one at a time, of a bounded size each, with the statistics of all items; whether it is the last."""
    scratch = C.Scratch(items.sparkSession)
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = C.block_count(*rows.agg(F.sum(F.octet_length("text")), F.count("*")).first(), shard_bytes)
    rows = scratch.keep(rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    terms = scratch.keep(rows.mapInArrow(_terms, "shard long, n long, words array<string>").where("n > 0"), "item-terms")
    whole = terms.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    words = terms.select("shard", F.explode("words").alias("word"))
    df = words.groupBy("shard", "word").agg(F.count("*").alias("own"))
    df = scratch.keep(df.join(df.groupBy("word").agg(F.sum("own").alias("df")), "word").select("shard", "word", "df"), "item-df")
    for k in range(n):
        own = rows.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        counts = {r["word"]: r["df"] for r in df.where(F.col("shard") == k).collect()}
        yield Shard([(r["item_id"], r["text"]) for r in own], threshold, passage_words, Statistics(whole["n"], whole["mean"] or 0.0, counts)), k == n - 1
    scratch.drop_but()


def _passes(spark: SparkSession, found: Iterator[tuple[Shard, bool]], search: Callable[[list[Broadcast]], DataFrame], most: int = PASS_SHARDS) -> Iterator[DataFrame]:
    """search() with a bounded number of shards at a time. What is found by all but the last pass is written, and its shards are released."""
    scratch, sent = C.Scratch(spark), []
    for index, last in found:
        sent.append(spark.sparkContext.broadcast(index))
        if last:
            yield search(sent)
        elif len(sent) == most:
            yield scratch.keep(search(sent), "searched")
            for b in sent:
                b.destroy()
            sent = []


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least_overlap: float = OVERLAP, passage_words: int = PASSAGE_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each document and test item that it leaks: doc_id, item_id, score, overlaps, and the passage's first word.

    Words are runs of letters, digits and underscores in lower case. Documents and items without words, null
    ones too, match nothing; items without an id are left out; equal documents, null ids and repeated ids are searched
    each on their own, equal items count once; of passages of a document with equal scores the first is named. Empty
    tables give no rows. Texts of any length are searched whole. Other columns are not read. Documents don't move.
    """
    C.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(sent: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data in batches:
                ids, own = data.column("doc_id").to_pylist(), data.column("text").to_pylist()
                for index in sent:
                    found = index.value.search(own, least_overlap)
                    yield from C.arrow(_MATCHES, [(ids[k], m.item_id, m.score, m.question_overlap, m.answer_overlap, m.first_word) for k, ms in enumerate(found) for m in ms]).to_batches()

        return texts.mapInArrow(run, MATCH_SCHEMA)

    return reduce(DataFrame.unionByName, _passes(docs.sparkSession, shards(items, threshold, passage_words, shard_bytes), search))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least_overlap: float = OVERLAP, passage_words: int = PASSAGE_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs that leak no item, with all their columns: those for which find_leaks has no row.

    Documents without words, null ones too, stay; equal rows and repeated ids are judged each on their own; without
    items all stay; an empty table gives no rows. Columns may have any names.
    """
    C.bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def search(sent: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data in batches:
                for index in sent:
                    data = data.filter(pa.array([not m for m in index.value.search(data.column(at).to_pylist(), least_overlap)], pa.bool_()))
                yield data

        return docs.mapInArrow(run, T.StructType(docs.schema.fields))

    for left in _passes(docs.sparkSession, shards(items, threshold, passage_words, shard_bytes), search):
        docs = left
    return docs
