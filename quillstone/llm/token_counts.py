"""Exact SentencePiece token counts, huge documents by overlapping chunks.

A document longer than a chunk is encoded in chunks that overlap. Where one chunk meets the next, the
count is spliced at a byte offset at which both encodings have a boundary that provably is one in the
encoding of the whole text; if the overlap holds none, it is widened.

The proof: merges join neighbours into pieces of the vocabulary only, and no piece has a space mark
after another character, nor a line break or tab beside any. So no merge crosses from a non-space to a space, or into or out of
a line break or tab, and what lies on either side of such a place is merged as if the other side were absent. `Model` checks
at load which of this holds for the pieces, and that the normaliser changes nothing but marking spaces and putting one in front.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK_BYTES = 32_768
OVERLAP_BYTES = 256
SPACE = "▁"

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files have this one; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """A SentencePiece model whose places before a space are proven boundaries."""

    def __init__(self, path: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.vocab_size()
        pieces = [self.processor.id_to_piece(i) for i in range(size)]
        single = [self.processor.is_byte(i) for i in range(size)]
        for i, piece in enumerate(pieces):
            if not single[i] and SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} has a space mark inside: no boundary is proven")
        longer = "".join(p for i, p in enumerate(pieces) if not single[i] and len(p) > 1)
        #: Bytes that are pieces of their own wherever they stand.
        self.alone = bytes(c for c in (0x0A, 0x09) if chr(c) not in longer)
        for probe in (" a  b ", " ﬁ İ\n\tÅ", "  "):
            if self.processor.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError("the normaliser rewrites text: no boundary is proven")
        #: Bytes of text that each id stands for.
        self.n_bytes = np.array([1 if single[i] else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def count(self, text: bytes) -> int:
        return len(self.processor.encode(text.decode("utf-8", "replace")))

    def ends(self, text: bytes, start: int, stop: int) -> np.ndarray:
        """The offsets in the text at which the pieces of text[start:stop] end."""
        ids = self.processor.encode(text[start:stop].decode("utf-8", "replace"))
        return start - 1 + np.cumsum(self.n_bytes[np.array(ids, np.int64)])  # the first byte is the space put in front


def _at_character(text: bytes, at: int) -> int:
    """The last start of a character at or before an offset."""
    at = max(0, min(at, len(text)))
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _common_boundary(text: bytes, left: np.ndarray, right: np.ndarray, start: int, stop: int, alone: bytes = b"") -> int | None:
    """The first proven boundary that both encodings have inside (start, stop)."""
    for at in np.intersect1d(left, right).tolist():
        if start < at < stop and ((text[at] == 0x20 and text[at - 1] != 0x20) or text[at] in alone or text[at - 1] in alone):
            return at
    return None


def count_in_chunks(model: Model, text: bytes, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> int:
    """Tokens of the whole text; at no time is more encoded than a chunk, or the stretch that has no boundary."""
    text = text.decode("utf-8", "replace").replace(SPACE, " ").encode()  # the library takes the mark itself for a space
    total, spliced, start = 0, -1, 0  # a piece that ends at 0 is the space put in front
    stop = _at_character(text, chunk_bytes)
    left = model.ends(text, start, stop)
    while stop < len(text):
        overlap = overlap_bytes
        while True:
            begin = _at_character(text, stop - overlap)
            if begin <= max(spliced, 0):  # the whole chunk holds no boundary: encode further
                stop = _at_character(text, stop + max(chunk_bytes, stop - start))
                left = model.ends(text, start, stop)
                if stop == len(text):
                    return total + len(left) - bisect.bisect_right(left, spliced)
                overlap = overlap_bytes
                continue
            end = _at_character(text, begin + chunk_bytes + overlap)
            right = model.ends(text, begin, end)
            at = _common_boundary(text, left, right, max(begin, spliced), stop, model.alone)
            if at is not None:
                break
            overlap *= 2
        total += bisect.bisect_right(left, at) - bisect.bisect_right(left, spliced)
        spliced, start, stop, left = at, begin, end, right
    return total + len(left) - bisect.bisect_right(left, spliced)


_MODELS: dict[str, Model] = {}


def model_at(name: str) -> Model:
    """The model of a path, loaded once a worker."""
    if name not in _MODELS:
        _MODELS[name] = Model(tokenizer_path(name))
    return _MODELS[name]


def _counts(name: str, chunk_bytes: int, overlap_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(name)
        for data in batches:
            texts = [t or b"" for t in data.column("text").to_pylist()]
            short = [t.decode("utf-8", "replace") for t in texts if len(t) <= chunk_bytes]
            counts = iter([len(x) for x in model.processor.encode(short, num_threads=1)] if short else [])
            n = [next(counts) if len(t) <= chunk_bytes else count_in_chunks(model, t, chunk_bytes, overlap_bytes) for t in texts]
            yield C.batch(_COUNTS, data.column("doc_id"), [len(t) for t in texts], n)

    return run


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; equal rows and repeated ids are
    counted each on their own; an empty table gives no rows. A text longer than a chunk is counted in chunks, one without any proven
    boundary whole. Bytes that are no UTF-8 count as replacement characters. Columns other than doc_id and text are not read.
    No row moves: the plan is a scan and one Python step.

    model: a file of the installed vocabularies by name, or a path that every executor can read.
    """
    C.bounded_batches(docs.sparkSession)
    found = C.documents(docs).mapInArrow(_counts(model, chunk_bytes, overlap_bytes), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
