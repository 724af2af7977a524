"""SentencePiece encoding by batched Viterbi search, and decoding.

The best segmentation is the one whose pieces have the largest sum of scores. A text with its spaces
marked is cut where no piece reaches across: before a space mark that follows another character,
and around line breaks and tabs, which no longer piece holds. What lies between, here called a word,
is solved once for all its copies in a worker. Words of equal length advance together: at each end
position the hashes of all substrings are looked up in the sorted hashes of the pieces of that length, and the
maximum over the begins is kept with a pointer back. Characters that no piece holds become their bytes.

Long words are cut into stretches of equal length that overlap and advance together like words. What a search does next
depends only on the differences between its last sums, as many as the longest piece has characters. So where the sums
of two stretches differ by one constant over that many places, the later stretch goes on as a search from
the word's begin would; where they don't within the overlap, the stretch begins earlier. Scores are whole numbers
(fixed point), so sums are exact.

Of equal sums the one with the longest last piece is kept, then the longest before it, and so on.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common as C
from .token_counts import SPACE, tokenizer_path

#: Longer words are cut into stretches.
LONGEST_TOGETHER = 96
#: Words that a worker remembers.
REMEMBERED = 400_000
#: Words solved in one matrix, and stretches of long words.
TOGETHER, STRETCHES = 20_000, 4_000

#: See Pieces.load; with this one the token counts of the merge model's own encoding are met best.
RANK_OFFSET = 100

_BASE = 0x2545F4914F6CDD1D
_LOST = -(1 << 62)
#: Scores are multiples of 1 / _ONE.
_ONE = 1 << 32
#: Bits of the table that says which hashes may be a piece's.
_BITS = 16

_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])
ENCODED_SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean"


class Pieces:
    """Pieces with scores, ready for the search. Spaces stand for space marks in here."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]) -> None:
        """pieces: id and score of each; byte_ids: the ids that stand for the 256 bytes."""
        self.pieces = {p.replace(SPACE, " "): (i, round(x * _ONE)) for p, (i, x) in pieces.items()}
        self.byte_ids = byte_ids
        self.longest = max(map(len, pieces), default=1)
        #: A character that no piece holds costs more than any piece.
        self.unknown = min((s for _, s in self.pieces.values()), default=0) - 10 * _ONE
        longer = {c for p in self.pieces if len(p) > 1 for c in p}
        if any(" " in p.lstrip(" ") for p in self.pieces) or longer & {"\n", "\t"}:
            self.cut = re.compile(r".+", re.S)  # a piece may reach across: the text is one word
        else:
            self.cut = re.compile(r"[\n\t]| *[^ \n\t]+| +")
        self.powers = np.array([pow(_BASE, i, 2**64) for i in range(self.longest + 1)], np.uint64)
        #: By length: the sorted hashes of the pieces, their ids and scores, and a bit for the high bits of each hash.
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in range(1, self.longest + 1):
            own = sorted((self._hash(p), *x) for p, x in self.pieces.items() if len(p) == length)
            keys = np.array([k for k, _, _ in own], np.uint64)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[keys >> np.uint64(64 - _BITS)] = True
            self.keys[length] = keys, np.array([i for _, i, _ in own], np.int32), np.array([s for _, _, s in own], np.int64), maybe
        self.text_of: dict[int, bytes] = {i: p.encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The scored pieces of a SentencePiece model with byte fallback.

        A unigram model's scores are log probabilities. A merge model has the negative rank of each
        piece instead, whose sums mean nothing; there the rank stands for a frequency by the law of
        Zipf and Mandelbrot: the score is -log(rank + RANK_OFFSET).
        """
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = [sp.get_score(i) for i in usual]
        if all(s == int(s) for s in scores):
            scores = [-math.log(rank + RANK_OFFSET) for rank in range(len(usual))]
        return cls({sp.id_to_piece(i): (i, s) for i, s in zip(usual, scores, strict=True)}, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def _search(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, pointers back and pieces at each place of words of one length, which are the columns of chars."""
        length, n = chars.shape
        chars = chars.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * np.uint64(_BASE) + chars[j]
        best = np.full((length + 1, n), _LOST, np.int64)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):  # the longest first: it wins a tie
                keys, ids, scores, maybe = self.keys[j - i]
                key = prefix[j] - prefix[i] * self.powers[j - i]
                at = np.flatnonzero(maybe[key >> np.uint64(64 - _BITS)])
                if len(at):
                    own = key[at]
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = keys[place] == own
                    at, place = at[hit], place[hit]
                    total = best[i, at] + scores[place]
                    more = total > best[j, at]
                    at, place = at[more], place[more]
                    best[j, at], back[j, at], piece[j, at] = total[more], i, ids[place]
            worse = np.flatnonzero(best[j] < best[j - 1] + self.unknown)
            if len(worse):
                best[j, worse], back[j, worse], piece[j, worse] = best[j - 1, worse] + self.unknown, j - 1, -1
        return best, back, piece

    def _solve(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        _, back, piece = self._search(np.ascontiguousarray(chars.T))
        return self._paths(words, back, piece)

    def _paths(self, words: list[str], back: np.ndarray, piece: np.ndarray) -> list[list[int]]:
        """Follow the pointers of all words together; a step of each word is a column."""
        row = np.arange(len(words))
        at = np.full(len(words), len(words[0]))
        steps = []
        while at.any():
            steps.append(np.where(at > 0, piece[at, row], -2))
            at = np.where(at > 0, back[at, row], 0)
        path = np.stack(steps[::-1], axis=1)
        used = path != -2
        edges = np.concatenate(([0], np.cumsum(used.sum(axis=1)))).tolist()
        flat = path[used].tolist()
        out = [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for k in np.flatnonzero((path == -1).any(axis=1)).tolist():
            out[k] = self._follow(words[k], back[:, k].tolist(), piece[:, k].tolist())
        return out

    def _follow(self, word: str, back: list[int], piece: list[int]) -> list[int]:
        out: list[int] = []
        j = len(word)
        while j:
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                out += [self.byte_ids[b] for b in reversed(word[back[j] : j].encode())]
            j = back[j]
        out.reverse()
        return out

    def _solve_long(self, words: list[str]) -> list[list[int]]:
        """Ids of words of any lengths, by stretches that advance together."""
        step = max(LONGEST_TOGETHER, 4 * self.longest)
        chars = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        # A stretch of a word is named by the place where it ends; it starts so far before the end of the stretch before it.
        before = {(k, min(end, len(c))): 2 * self.longest for k, c in enumerate(chars) for end in range(step, len(c) + step, step)}
        solved: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
        todo = list(before)
        while todo:
            by_length: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for k, end in todo:
                start = max(0, (end - 1) // step * step - before[k, end])
                by_length[end - start].append((k, end, start))
            for same in by_length.values():
                for some in (same[i : i + STRETCHES] for i in range(0, len(same), STRETCHES)):
                    found = self._search(np.stack([chars[k][start:end] for k, end, start in some], axis=1))
                    for j, (k, end, start) in enumerate(some):
                        solved[k, end] = start, *(x[:, j].copy() for x in found)
            joined = {name: self._joined(solved, *name, step) for name in before}
            todo = [name for name, at in joined.items() if at is None]
            before |= {name: 2 * before[name] for name in todo}
        back, piece = [np.zeros(len(c) + 1, np.int64) for c in chars], [np.full(len(c) + 1, -1, np.int32) for c in chars]
        for (k, end), at in sorted(joined.items()):
            start, _, own_back, own_piece = solved[k, end]
            back[k][at + 1 : end + 1] = own_back[at + 1 - start :] + start
            piece[k][at + 1 : end + 1] = own_piece[at + 1 - start :]
        return [self._follow(w, back[k].tolist(), piece[k].tolist()) for k, w in enumerate(words)]

    def _joined(self, solved: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]], k: int, end: int, step: int) -> int | None:
        """The place after which a stretch has the pointers of a search from the word's begin, if the one before it has; None if there is none."""
        start, own = solved[k, end][:2]
        if not start:
            return 0
        last = (end - 1) // step * step  # where the stretch before it ends; that one is sure of its last step
        other_start, other = solved[k, last][:2]
        low = max(start, other_start, last - step)
        gap = own[low - start : last - start + 1] - other[low - other_start :]
        unlike = np.flatnonzero(gap != gap[-1])
        first = low if not len(unlike) else low + int(unlike[-1]) + 1  # from here on they differ by one constant
        return first + self.longest - 1 if last - first + 1 >= self.longest else None

    def solve(self, words: set[str]) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        by_length: defaultdict[int, list[str]] = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for length, same in by_length.items():
            if length <= LONGEST_TOGETHER:
                for k in range(0, len(same), TOGETHER):
                    found |= zip(same[k : k + TOGETHER], self._solve(same[k : k + TOGETHER]), strict=True)
        if long := [w for w in words if len(w) > LONGEST_TOGETHER]:
            found |= zip(long, self._solve_long(long), strict=True)
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text with the space put in front; a space mark in it is a space, as in the library."""
        return self.cut.findall(" " + (text.replace(SPACE, " ") if SPACE in text else text)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, without the space that encoding put in front; other ids than those of pieces and bytes stand for nothing."""
        return b"".join([self.text_of.get(i, b"") for i in ids]).removeprefix(b" ")


class Encoder:
    """Encodes texts; words that were solved before are remembered, up to a bound."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.edge = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.pieces.words(t) for t in texts]
        new = set(chain.from_iterable(cut))
        if len(self.slot) + len(new) > REMEMBERED:
            self._forget()
        new.difference_update(self.slot)
        if new:
            found = self.pieces.solve(new)
            self.slot |= zip(found, range(len(self.slot), len(self.slot) + len(found)), strict=True)
            sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
            self.edge = np.concatenate((self.edge, self.edge[-1] + np.cumsum(sizes)))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found.values()), np.int32, int(sizes.sum()))))
        out = []
        for words in cut:
            slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
            start, n = self.edge[slots], self.edge[slots + 1] - self.edge[slots]
            out.append(self.flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_at(name: str) -> Encoder:
    """The encoder of a model file, loaded once a worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(Pieces.load(tokenizer_path(name)))
    return _ENCODERS[name]


def _encode(name: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(name)
        for data in batches:
            texts = [t or b"" for t in data.column("text").to_pylist()]
            ids = encoder.encode([t.decode("utf-8", "replace") for t in texts])
            digests = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
            same = [encoder.pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            sizes = [len(x) for x in ids]
            if keep_ids:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            else:
                lists = pa.nulls(len(ids), pa.list_(pa.int32()))
            yield C.batch(_ENCODED, data.column("doc_id"), sizes, lists, digests, same)

    return run


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip of every row.

    round_trip says that decoding the ids gives the very text, which fails only for texts that hold the space mark itself or bytes that are no UTF-8. A null or empty text has no tokens; a null
    id stays null; equal rows and repeated ids are encoded each on their own; an empty table gives no
    rows. Texts and words of any length are encoded whole. Columns other than doc_id and text are not read. No row moves between tasks.
    """
    C.bounded_batches(docs.sparkSession)
    return C.documents(docs).mapInArrow(_encode(model, keep_ids), ENCODED_SCHEMA)


def _decode(name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder_at(name).pieces
        for data in batches:
            texts = [None if ids is None else pieces.decode(ids).decode("utf-8", "replace") for ids in data.column("ids").to_pylist()]
            yield C.batch(schema, data.column("doc_id"), texts)

    return run


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of rows (doc_id, ids) such as encode_documents gives: its inverse.

    Null ids give a null text, none an empty one; ids that stand for no piece or byte are left out, and bytes that
    are no UTF-8 become replacement characters. Null doc_ids, equal rows and repeated ids are decoded each on their own; an
    empty table gives no rows. Other columns are not read.
    """
    C.bounded_batches(encoded.sparkSession)
    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(_decode(model), "doc_id long, text string")
