"""A compressed FM-index over integer sequences, against which many sequences are streamed at once.

The Burrows-Wheeler transform of the concatenated sequences is kept as a wavelet matrix alone:
one bit vector per bit of the alphabet, packed into 64-bit words with running counts, so a rank
costs one lookup and one bit count per level. Suffixes are sorted by their first ``depth``
symbols, which is all that matches of up to ``depth`` symbols depend on; the suffix array is
dropped once the transform, the lengths of prefixes that neighbours share (a byte or two each)
and the least value of each class of equal prefixes have been taken from it.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols or more, by doubling; equal ones by position."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        width *= 2
    return order


def shared_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many of the first ``depth`` symbols each suffix shares with the one before it in ``order``; 0 for the first."""
    n = len(order)
    out = np.zeros(n, np.uint8 if depth < 256 else np.int32)
    live = np.arange(1, n)
    for k in range(depth):
        a, b = order[live - 1] + k, order[live] + k
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[text[a] == text[b]]
        out[live] += 1
        if not len(live):
            break
    return out


class BitRank:
    """A packed bit vector that counts ones before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (seq >> shift & 1).astype(np.uint8)
            zeros = int(len(bits) - bits.sum(dtype=np.int64))
            self.levels.append((shift, BitRank(bits), zeros))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position, less a term that depends on the symbol alone."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at


class Classes:
    """Intervals of suffixes that share a prefix; those of one suffix alone are not stored."""

    def __init__(self, shared: np.ndarray, depth: int):
        heads = np.flatnonzero(shared < depth).astype(np.int32)
        ends = np.append(heads[1:], np.int32(len(shared)))
        many = ends - heads > 1
        self.low, self.high = heads[many], ends[many]

    def number(self, at: np.ndarray) -> np.ndarray:
        """Which stored class holds each position, -1 if it is alone."""
        if not len(self.low):
            return np.full(len(at), -1)
        k = np.searchsorted(self.low, at, "right") - 1
        return np.where((k >= 0) & (at < self.high[k]), k, -1)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.number(at)
        if not len(self.low):
            return at, at + 1
        return np.where(k >= 0, self.low[k], at), np.where(k >= 0, self.high[k], at + 1)


class FMIndex:
    """``text`` holds symbols from 1 on, with 0 after each sequence; ``value`` a number for each position."""

    def __init__(self, text: np.ndarray, depth: int, value: np.ndarray):
        self.depth, self.size = depth, len(text)
        order = sorted_suffixes(text, depth)
        self.sigma = int(text.max(initial=0)) + 1
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma), dtype=np.int64)])
        self.matrix = WaveletMatrix(text[order - 1].astype(np.int32), self.sigma)
        # the wavelet matrix keeps each symbol's occurrences together at the bottom
        self.start = first[:-1] - self.matrix.rank(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        self.shared = shared_prefixes(text, order, depth)
        self._classes: dict[int, Classes] = {}
        whole = self.classes(depth)
        owned = np.append(value[order], np.iinfo(np.int64).max)
        bounds = np.stack([whole.low, whole.high], 1).ravel().astype(np.int64)
        #: The least value in each class of several suffixes that share ``depth`` symbols.
        self.least = np.minimum.reduceat(owned, bounds)[::2] if len(bounds) else np.zeros(0, np.int64)

    def classes(self, depth: int) -> Classes:
        if depth not in self._classes:
            self._classes[depth] = Classes(self.shared, depth)
        return self._classes[depth]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns with one more symbol in front; empty for symbols that the text lacks."""
        known = (symbol > 0) & (symbol < self.sigma)
        s = np.where(known, symbol, 0)
        both = self.matrix.rank(np.concatenate([s, s]), np.concatenate([low, high])) + np.concatenate([self.start[s]] * 2)
        a, b = both[: len(s)], both[len(s) :]
        return a, np.where(known, b, a)

    def matching_statistics(self, query: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of ``query`` the longest match, up to ``depth``, that starts there, and its suffix range.

        The streams ``query[begin : begin + length]`` are read from right to left, all at once. A
        match grows by backward search; one of full depth first loses its last symbol, and one that
        can't grow loses symbols until it can: both widen the range to a class of shorter prefixes.
        Positions outside the streams have length 0.
        """
        n = len(query)
        found, lows, highs = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, self.size, np.int32)
        by_length = np.argsort(-length, kind="stable")
        begin, length = begin[by_length], length[by_length]
        size = np.zeros(len(begin), np.int64)
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.size, np.int64)
        for k in range(int(length.max(initial=0))):
            on = int(np.searchsorted(-length, -k, "left"))  # streams longer than k
            at = begin[:on] + length[:on] - 1 - k
            symbol = query[at]
            self._shorten(np.flatnonzero(size[:on] == self.depth), size, low, high)
            todo = np.arange(on)
            while len(todo):
                a, b = self.extend(symbol[todo], low[todo], high[todo])
                grew = a < b
                ok = todo[grew]
                low[ok], high[ok] = a[grew], b[grew]
                size[ok] += 1
                todo = todo[~grew]
                todo = todo[size[todo] > 0]  # nothing matches here where even the symbol alone fails
                self._shorten(todo, size, low, high)
            found[at], lows[at], highs[at] = size[:on], low[:on], high[:on]
        return found, lows, highs

    def _shorten(self, which: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Drop the last symbol of matches: their ranges become those of the prefixes one shorter."""
        size[which] -= 1
        depths = size[which]
        for d in np.unique(depths):
            part = which[depths == d]
            if d == 0:
                low[part], high[part] = 0, self.size
            else:
                low[part], high[part] = self.classes(int(d)).around(low[part])
