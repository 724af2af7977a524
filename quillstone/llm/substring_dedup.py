"""Removal of repeated passages by compressed FM-indexes.

A window is `width` consecutive words; each word of a window that also starts earlier is removed. Each
window has a fingerprint, the smallest hash of the shorter word sequences in it, so equal windows
share one. Consecutive windows with one fingerprint place make a segment.

 1. Blocks of documents send the fingerprints of their segments, by ranges; those seen twice return.
 2. Blocks send the distinct segments with such fingerprints, by ranges of the fingerprint: equal windows
    meet in one shard. A block sends equal segments once, as the earliest of them.
 3. A shard indexes the earliest segment of each fingerprint (fm_index.py) and streams all others through
    backward search: where matching statistics reach the width, the window starts earlier. What no reference holds is
    indexed in turn, and the interval of a window names those that equal it, of which the earliest is kept. Each
    block learns which windows of the segments that it sent start earlier. The fingerprints of step 1 only
    spare the shards text that can't repeat: with all segments sent the result is the same.
 4. Blocks remove the words that those windows cover.

Segments of a fingerprint that is frequent in many surroundings are sent a window each, by the hash of
the window, so that no shard gets them all. The order is that of doc_id, null first, then of a hash of the text,
then of the place; rows that share id and text count as one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fm_index import FIRST, SEPARATOR, FMIndex

WIDTH = 20
#: Words of the sequences whose smallest hash is a window's fingerprint.
SEED = 8
BLOCK_BYTES = 4 << 20
#: Bytes of text for one shard, of which most has no repeated fingerprint.
SHARD_BYTES = 5 << 20
#: Segments from which on a fingerprint's windows are sent one by one.
FREQUENT = 100_000

_CELLS = pa.schema([("range_id", pa.int32()), ("block", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])
_SEEN = pa.schema([("block", pa.int64()), ("range_id", pa.int32()), ("seen", pa.binary())])
_SEGMENTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
_EARLIER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("earlier", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string, kept_sha256 string"
_KEY = np.dtype([("doc_id", "<i8"), ("text_hash", "<u8"), ("place", "<i8")])


def _least(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each span of values and the first place that has it, by spans of doubled length."""
    least, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        right = least[step:]
        left = least[: len(right)]
        other = right < left
        least, at = np.where(other, right, left), np.where(other, at[step:], at[: len(right)])
        size += step
    return least, at


class _Block:
    """The documents of a block in order, their words on end, and their segments."""

    def __init__(self, row: dict, width: int, seed: int) -> None:
        ids, null, texts = C.block_rows(row)
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
        order = np.lexsort([hashes, ids])
        self.ids, self.null, self.text_hashes = ids[order], null[order], hashes[order]
        vocabulary = C.Vocabulary()
        encoded = [vocabulary.encode(C.words_of(texts[k])) for k in order]
        self.lengths = np.array([len(w) for w in encoded], np.int64)
        self.words = np.concatenate([np.zeros(0, np.int32), *encoded])
        self.texts = list(vocabulary.ids)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.width = width
        doc = np.repeat(np.arange(len(order)), self.lengths)
        h = vocabulary.hashes()[self.words]
        self.hashes = h
        n = len(h) - width + 1
        self.segments = np.zeros(0, np.int64)
        self.windows = np.zeros(0, np.int64)
        self.prints = np.zeros(0, np.uint64)
        if n <= 0:
            return
        seeds = C.grams(h, seed)[seed - 1 :]
        least, at = _least(seeds, width - seed + 1)
        valid = doc[width - 1 :] == doc[:n]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        #: The first window of each segment, and how many it has.
        self.segments = np.flatnonzero(begins)
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | begins[1:]
        self.windows = np.flatnonzero(ends) - self.segments + 1
        self.prints = least[self.segments]
        self.doc = doc

    def sent(self, seen: list[tuple[int, bytes]], ranges: int, shards: int) -> None:
        """With what has returned of the fingerprints, the distinct segments to send, by shard."""
        distinct, index = np.unique(self.prints, return_inverse=True)
        code = np.concatenate([np.zeros(0, np.uint8), *(C.unpack(data, np.uint8) for _, data in sorted(seen))])[index] if len(distinct) else np.zeros(0, np.uint8)
        usual, frequent = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        n = self.windows[frequent]
        single = np.repeat(self.segments[frequent] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = np.concatenate((self.segments[usual], single))
        windows = np.concatenate((self.windows[usual], np.ones(len(single), np.int64)))
        words = windows + self.width - 1
        route = np.concatenate((self.prints[usual], C.grams(self.hashes, self.width)[single + self.width - 1] if len(single) else np.zeros(0, np.uint64)))
        # Equal content has an equal key: a polynomial over the words, by prefix sums of powers.
        order = np.argsort(start, kind="stable")
        start, windows, words, route = start[order], windows[order], words[order], route[order]
        key = np.zeros(len(start), np.uint64)
        for k in range(int(words.max(initial=0))):
            on = words > k
            key[on] = C.scramble(key[on] * np.uint64(3) + self.hashes[start[on] + k])
        key = C.scramble(key + words.astype(np.uint64)) ^ route
        _, first, self.copy_of = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.n_windows = start, windows  # of all copies
        #: Of the distinct ones, the earliest copy each.
        self.earliest = first
        edges = [(i << 64) // shards for i in range(1, shards)]
        self.shard = np.searchsorted(np.array(edges, np.uint64), route[first], "right") if edges else np.zeros(len(first), np.int64)

    def key_of(self, starts: np.ndarray) -> np.ndarray:
        """Where segments lie: id, hash of the text, and place in the document."""
        out = np.zeros(len(starts), _KEY)
        doc = self.doc[starts] if len(starts) else np.zeros(0, np.int64)
        out["doc_id"], out["text_hash"], out["place"] = self.ids[doc], self.text_hashes[doc], starts - self.first[doc]
        return out

    def in_shard(self, shard: int) -> np.ndarray:
        """The distinct segments that a shard gets, in the order in which they are sent."""
        return np.flatnonzero(self.shard == shard)


def _send_prints(width: int, seed: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            for row in data.to_pylist():
                distinct, counts = np.unique(_Block(row, width, seed).prints, return_counts=True)
                at = C.cut(distinct, ranges)
                rows = [(int(r), row["block"], C.pack_sorted(distinct[at[r] : at[r + 1]]), C.pack(counts[at[r] : at[r + 1]].astype(np.uint32))) for r in np.flatnonzero(np.diff(at))]
                yield from C.arrow(_CELLS, rows).to_batches()

    return run


def _merge_prints(frequent: int):
    def run(group: pa.Table) -> pa.Table:
        cells = list(zip(*(group.column(c).to_pylist() for c in ("block", "prints", "counts")), strict=True))
        prints = [C.unpack_sorted(p) for _, p, _ in cells]
        at = np.cumsum([0, *map(len, prints)])
        distinct, index = np.unique(np.concatenate(prints), return_inverse=True)
        total = np.bincount(index, np.concatenate([C.unpack(c, np.uint32) for *_, c in cells]), len(distinct))
        code = (total > 1).astype(np.uint8) + (total > frequent)
        return C.arrow(_SEEN, [(block, group.column("range_id")[0].as_py(), C.pack(code[index[at[k] : at[k + 1]]])) for k, (block, *_) in enumerate(cells)])

    return run


def _returned(cells: pa.Table, key: str, value: str) -> list[tuple[int, bytes]]:
    return list(zip(cells.column(key).to_pylist(), cells.column(value).to_pylist(), strict=True))


def _send_segments(width: int, seed: int, ranges: int, shards: int):
    def run(blocks: pa.Table, seen: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            block = _Block(row, width, seed)
            block.sent(_returned(seen, "range_id", "seen"), ranges, shards)
            texts = block.texts.__getitem__
            for shard in np.unique(block.shard).tolist():
                own = block.earliest[block.in_shard(shard)]
                starts, lengths = block.start[own], block.n_windows[own] + width - 1
                places = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                rows.append((shard, row["block"], C.pack(block.key_of(starts).view(np.int64)), C.pack(lengths.astype(np.uint16)), C.pack_bytes(b" ".join(map(texts, block.words[places].tolist())))))
        return C.arrow(_SEGMENTS, rows)

    return run


def _parts(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of words on end."""
    return words[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def _indexed(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> FMIndex:
    """An index of stretches of words, which nothing matches across."""
    texts = np.full(lengths.sum() + len(lengths), SEPARATOR, np.int32)
    texts[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = _parts(words, starts, lengths)
    return FMIndex(texts, 2 ** math.ceil(math.log2(width + 1)))


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The smallest hash of the shorter sequences in the first window of each segment, which is that of all its windows."""
    seeds = C.grams(hashes, seed)
    out = seeds[starts + seed - 1]
    for k in range(seed, width):
        out = np.minimum(out, seeds[starts + k])
    return out


def earlier_windows(width: int, seed: int = SEED):
    """A shard's work: which windows of the segments it got start earlier than they do there."""

    def run(group: pa.Table) -> pa.Table:
        cells = list(zip(*(group.column(c).to_pylist() for c in ("block", "keys", "lengths", "words")), strict=True))
        keys = np.concatenate([C.unpack(k, np.int64).view(_KEY) for _, k, *_ in cells])
        each = [C.unpack(n, np.uint16).astype(np.int64) for *_, n, _ in cells]
        lengths = np.concatenate(each)
        vocabulary = C.Vocabulary()
        words = np.concatenate([vocabulary.encode(C.unpack_bytes(w).split(b" ")) for *_, w in cells]) + np.int32(FIRST)
        starts = np.cumsum(lengths) - lengths
        # Equal segments of several blocks are indexed once.
        content = np.zeros(len(lengths), np.uint64)
        for k in range(int(lengths.max())):
            on = lengths > k
            content[on] = C.scramble(content[on] * np.uint64(3) + words[starts[on] + k].astype(np.uint64))
        _, first, copy_of = np.unique(C.scramble(content + lengths.astype(np.uint64)), return_index=True, return_inverse=True)
        # A number for each place that sorts as the places do; windows add their offset.
        _, doc = np.unique(keys[["doc_id", "text_hash"]], return_inverse=True)
        place = doc.astype(np.int64) << 36 | keys["place"]
        earliest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(earliest, copy_of, place)

        n = lengths[first]
        own = np.repeat(starts[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        words = words[own]  # of the distinct segments
        del content, own
        starts = np.cumsum(n) - n
        windows = n - width + 1
        segment = np.repeat(np.arange(len(n)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        begins = earliest[segment] + offset  # where each window begins first, as far as it is known
        # The earliest segment of each fingerprint is indexed, the others are streamed: equal windows have one fingerprint, so what matches begins earlier.
        prints = _fingerprints(vocabulary.hashes()[words - FIRST], starts, width, seed)
        _, print_of, sharing = np.unique(prints, return_inverse=True, return_counts=True)
        order = np.lexsort((earliest, print_of))
        head = np.diff(print_of[order], prepend=-1) > 0
        references, others = np.sort(order[head & (sharing[print_of[order]] > 1)]), np.sort(order[~head])
        if len(others):
            index = _indexed(words, starts[references], n[references], width)
            found, _ = index.matching_statistics(_parts(words, starts[others], n[others]), n[others], width)
            del index
            streamed = np.isin(segment, others)
            at = (np.cumsum(n[others]) - n[others])[np.searchsorted(others, segment[streamed])] + offset[streamed]
            matched = found[at] >= width
            begins[np.flatnonzero(streamed)[matched]] = -1
            # Runs of windows that no reference holds, where another segment of the fingerprint has such windows too: indexed
            # together, and each one's interval names what equals it.
            left = np.flatnonzero(streamed)[~matched]
            with_some = np.bincount(print_of[np.unique(segment[left])], minlength=len(sharing))
            left = left[with_some[print_of[segment[left]]] > 1]
            if len(left):
                new = np.append(True, (np.diff(left) > 1) | (np.diff(segment[left]) > 0))
                run_at = np.flatnonzero(new)
                size = np.diff(np.append(run_at, len(left)))
                begin = (starts[segment] + offset)[left[run_at]]
                index = _indexed(words, begin, size + width - 1, width)
                found, low = index.matching_statistics(_parts(words, begin, size + width - 1), size + width - 1, width)
                whole = size + width - 1
                at = np.repeat(np.cumsum(whole) - whole - (np.cumsum(size) - size), size) + np.arange(len(left))
                name = np.searchsorted(index.edges(width), low[at], "right") - 1
                earlier_of = np.full(len(index.edges(width)), np.iinfo(np.int64).max)
                np.minimum.at(earlier_of, name, begins[left])
                begins[left] = earlier_of[name]
                del index

        out, done = [], 0
        first_window = np.cumsum(windows) - windows
        for (block, *_), size in zip(cells, each, strict=True):
            copies = np.arange(done, done + len(size))
            m = windows[copy_of[copies]]
            offsets = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            earlier = np.repeat(place[copies], m) + offsets > begins[np.repeat(first_window[copy_of[copies]], m) + offsets]
            out.append((block, group.column("shard")[0].as_py(), C.pack_bytes(np.packbits(earlier).tobytes())))
            done += len(size)
        return C.arrow(_EARLIER, out)

    return run


def _remove(width: int, seed: int, ranges: int, shards: int, keep_text: bool):
    def run(blocks: pa.Table, seen: pa.Table, earlier: dict[int, bytes]) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            block = _Block(row, width, seed)
            block.sent(_returned(seen, "range_id", "seen"), ranges, shards)
            cover = np.zeros(len(block.words) + 1, np.int64)
            # Windows of the earliest copies, as the shards say.
            flags: list[np.ndarray] = [np.zeros(0, bool)] * len(block.earliest)
            for shard, data in earlier.items():
                own = block.in_shard(shard)
                n = block.n_windows[block.earliest[own]]
                bits = np.unpackbits(np.frombuffer(C.unpack_bytes(data), np.uint8), count=int(n.sum())).astype(bool)
                for k, part in zip(own.tolist(), np.split(bits, np.cumsum(n)[:-1]), strict=True):
                    flags[k] = part
            if len(block.earliest):
                windows = block.n_windows
                copies = np.repeat(np.arange(len(windows)), windows)
                offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                sizes = windows[block.earliest]
                flat, begin = np.concatenate(flags), np.cumsum(sizes) - sizes
                gone = flat[begin[block.copy_of[copies]] + offset]
                keys = block.key_of(block.start)
                later = keys != keys[block.earliest][block.copy_of]  # a copy behind one of its own block
                starts = (block.start[copies] + offset)[gone | later[copies]]
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + width, -1)
            removed = np.cumsum(cover[:-1]) > 0
            kept_words = block.texts.__getitem__
            for k, (i, null) in enumerate(zip(block.ids.tolist(), block.null.tolist(), strict=True)):
                part = slice(block.first[k], block.first[k] + block.lengths[k])
                out = removed[part]
                text = b" ".join(map(kept_words, block.words[part][~out].tolist()))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])))).reshape(-1, 2).tolist()
                rows.append((None if null else i, int(block.lengths[k]), int(out.sum()), [{"start": a, "stop": b} for a, b in edge], text.decode() if keep_text else None, hashlib.sha256(text).hexdigest()))
        return C.arrow(_RESULT, rows)

    def both(blocks: pa.Table, cells: pa.Table) -> pa.Table:
        kinds = np.array(cells.column("shard").is_null())
        return run(blocks, cells.filter(pa.array(kinds)), dict(_returned(cells.filter(pa.array(~kinds)), "shard", "earlier")))

    return both


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, keep_text: bool = True, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of word numbers), kept_text and kept_sha256 of every row.

    Windows are judged on the input. A null or empty text has no words; a document with fewer words than a
    window loses none. Null ids come first; texts that share an id are ordered by a hash, and rows that
    share both get the same result. An empty table gives no rows. Texts of any length are compared whole; one longer than a
    block is a block. Columns other than doc_id and text are not read. Two sequences of words are taken for one if their 64-bit hashes agree.
    """
    C.bounded_batches(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession)
    rows = C.documents(docs).withColumn("kind", F.lit(0))
    blocks = scratch.keep(rows.mapInArrow(C.to_blocks(block_bytes), C.BLOCK_SCHEMA), "blocks")
    n_blocks = max(1, blocks.count())
    n_bytes, n_rows = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary"))), F.count("*")).first()
    ranges = max(4, math.ceil((n_bytes or 0) / 6 / 4 / C.RANGE_ENTRIES))
    shards = max(4, C.block_count(n_bytes, n_rows, shard_bytes))
    by_block = lambda df: df.repartition(n_blocks, "block").groupBy("block")  # noqa: E731  a partition for each block or so at every size
    prints = blocks.mapInArrow(_send_prints(width, seed, ranges), "range_id int, block long, prints binary, counts binary").repartition(4 * ranges, "range_id")
    seen = scratch.keep(prints.groupBy("range_id").applyInArrow(_merge_prints(frequent), "block long, range_id int, seen binary"), "prints")
    segments = by_block(blocks).cogroup(by_block(seen)).applyInArrow(_send_segments(width, seed, ranges, shards), "shard int, block long, keys binary, lengths binary, words binary")
    segments = segments.repartition(4 * shards, "shard").groupBy("shard")
    earlier = scratch.keep(segments.applyInArrow(earlier_windows(width, seed), "block long, shard int, earlier binary"), "earlier")
    cells = seen.select("block", "range_id", "seen", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("earlier")).unionByName(earlier.select("block", F.lit(None).cast("int").alias("range_id"), F.lit(None).cast("binary").alias("seen"), "shard", "earlier"))
    result = scratch.keep(by_block(blocks).cogroup(by_block(cells)).applyInArrow(_remove(width, seed, ranges, shards, keep_text), RESULT_SCHEMA), "kept-words")
    scratch.drop_but(result)
    return result
