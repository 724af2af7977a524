"""A compressed full-text index over words: suffix order, Burrows-Wheeler transform, wavelet matrix.

Patterns are searched from their end, a word at a time, many of them together. The index orders
suffixes by their first `depth` words; that is enough for patterns of fewer words. Once it is built, neither the text nor
the suffixes' order is kept: the index is a bit for each level of a word's number, and a byte for what a suffix
shares with the one before it.
"""

from __future__ import annotations

import numpy as np

#: Before, between and after the indexed texts. Words are numbered from FIRST.
END, SEPARATOR, FIRST = 0, 1, 2


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Where the suffixes begin, in the order of their first depth values; equal ones in the order of the text."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
    order = np.argsort(rank, kind="stable") if depth <= 1 else np.zeros(0, np.int64)
    step = 1
    while step < depth:
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:] + 1
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2) + behind
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        step *= 2
    return order.astype(np.int32)


class BitVector:
    """Packed bits; the number of ones before each word of 64 is kept."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """Rank of any symbol in a sequence, a bit of the symbol at each level."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.levels = max(1, int(sequence.max(initial=0)).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        sequence = sequence.copy()
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.bits.append(BitVector(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        #: Where each symbol begins after the last level.
        self.start = np.zeros(int(sequence.max(initial=0)) + 2, np.int64)
        if len(sequence):
            edge = np.flatnonzero(np.diff(sequence, prepend=-1))
            self.start[sequence[edge]] = edge

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place after the last level: start of the symbol plus its rank before the place."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, texts: np.ndarray, depth: int) -> None:
        """texts: words from FIRST on, with SEPARATOR after each text. Patterns may have less than depth words, which is below 256."""
        text = np.concatenate((texts, [END])).astype(np.int32)
        self.depth = depth
        order = suffix_order(text, depth)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[order - 1])
        counts = np.bincount(text, minlength=len(self.wavelet.start))
        self.words = len(counts)
        #: From the place after the last level to the place in the suffix order.
        self.shift = (np.cumsum(counts) - counts) - self.wavelet.start[: self.words]
        self.counts = counts
        self._common = self._common_prefixes(text, order, depth)
        self._edges: dict[int, np.ndarray] = {}

    @staticmethod
    def _common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
        """Words that each suffix shares with the one before it in the order, up to most."""
        out = np.zeros(len(text), np.uint8)
        live = np.arange(1, len(text), dtype=np.int32)
        for k in range(most):
            a, b = order[live] + k, order[live - 1] + k
            ok = (a < len(text)) & (b < len(text))
            live = live[ok]
            live = live[text[a[ok]] == text[b[ok]]]
            if not len(live):
                break
            out[live] = k + 1
        return out

    def edges(self, length: int) -> np.ndarray:
        """Where the suffixes with equal first `length` words begin, and the end."""
        if length not in self._edges:
            self._edges[length] = np.concatenate((np.flatnonzero(self._common < length), [self.size])) if length else np.array([0, self.size])
        return self._edges[length]

    def shorten(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first `length` words of what begins at low."""
        edges = self.edges(length)
        at = np.searchsorted(edges, low, "right") - 1
        return edges[at], edges[at + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the symbols put before the patterns with these intervals; empty if low reaches high."""
        both = self.wavelet.down(np.concatenate((symbol, symbol)), np.concatenate((low, high))) + np.tile(self.shift[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streamed texts, the longest match that begins there, up to cap words, and where its interval begins.

        words: those of all texts on end, 0 for one that the index doesn't hold; cap must be less than depth.
        """
        ends = np.cumsum(lengths)
        found, at_low = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(-lengths, kind="stable")
        remaining = lengths[order]
        low, high, length = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64), np.zeros(len(order), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            n = int(np.searchsorted(-remaining, -back, "right"))  # texts of so many words at least
            place = ends[order[:n]] - back
            symbol = words[place]
            low, high, length = low[:n], high[:n], length[:n]
            full = np.flatnonzero(length == cap)
            if len(full):
                low[full], high[full] = self.shorten(low[full], cap - 1)
                length[full] = cap - 1
            known = (symbol >= FIRST) & (symbol < self.words)
            known[known] = self.counts[symbol[known]] > 0
            low[~known], high[~known], length[~known] = 0, self.size, 0
            todo = np.flatnonzero(known)
            while len(todo):
                a, b = self.extend(symbol[todo], low[todo], high[todo])
                ok = a < b
                done, failed = todo[ok], todo[~ok]
                low[done], high[done] = a[ok], b[ok]
                length[done] += 1
                for shorter in np.unique(length[failed]).tolist():  # drop the last word and try again
                    own = failed[length[failed] == shorter]
                    low[own], high[own] = self.shorten(low[own], shorter - 1)
                    length[own] = shorter - 1
                todo = failed
            found[place], at_low[place] = length, low
        return found, at_low
