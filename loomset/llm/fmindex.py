"""A compressed full-text index over sequences of small integers, built and searched in numpy.

The text is an int array in which 0 separates sequences. Every separator is taken as a symbol of its own,
in order of position, so no match runs over one and suffixes differ at the latest there. Suffixes are sorted
by prefix doubling, the Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with counts at
each word, and of the suffix positions only samples are kept: every ``rate``-th one, and those that follow a
separator, so that a walk to the left meets a sample before it meets a separator.

All searches take whole arrays of patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

MAX_SYMBOLS = (1 << 21) - 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (its last symbol is 0) in the order of their suffixes."""
    n = len(text)
    pos_bits, sym_bits = max(1, int(n).bit_length()), max(1, int(text.max(initial=0)).bit_length())
    h = max(1, (63 - pos_bits) // sym_bits)
    h = min(h, 8)
    key = np.zeros(n, dtype=np.uint64)
    open_ = np.ones(n, dtype=bool)  # no separator among the symbols so far
    shifted = text.astype(np.uint64)
    for k in range(h):
        part = np.zeros(n, dtype=np.uint64)
        part[: n - k] = shifted[k:]
        key = (key << np.uint64(sym_bits)) | np.where(open_, part, np.uint64(0))
        open_ &= part != 0
    order = np.sort((key << np.uint64(pos_bits)) | np.arange(n, dtype=np.uint64))
    sa = (order & np.uint64((1 << pos_bits) - 1)).astype(np.int64)
    key = key[sa]
    # equal keys that hold a separator are in their final order, that of their positions
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | ~open_[sa[1:]]
    rank = np.empty(n, dtype=np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = start
    tied = ~new
    tied[:-1] |= ~new[1:]
    rows = np.flatnonzero(tied)
    bits = np.uint64(21)
    low = np.uint64((1 << 21) - 1)
    while len(rows):
        at = sa[rows]
        group = rank[at]
        nxt = rank[np.minimum(at + h, n - 1)]
        if n > MAX_SYMBOLS:  # three numbers do not fit into one
            pick = np.lexsort((np.arange(len(rows)), nxt, group))
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = (group[pick][1:] != group[pick][:-1]) | (nxt[pick][1:] != nxt[pick][:-1])
        else:
            order = np.sort((group.astype(np.uint64) << (bits + bits)) | (nxt.astype(np.uint64) << bits) | np.arange(len(rows), dtype=np.uint64))
            pick = (order & low).astype(np.int64)
            pair = order >> bits
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = pair[1:] != pair[:-1]
        sa[rows] = at[pick]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
        rank[sa[rows]] = rows[first]
        same = ~fresh
        same[:-1] |= ~fresh[1:]
        rows = rows[same]
        h *= 2
    return sa


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(((n >> 6) + 1) << 6, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, text: np.ndarray, rate: int = 16):
        text = np.asarray(text, dtype=np.int64)
        if len(text) == 0 or text[-1] != 0:
            text = np.append(text, 0)
        self.n = n = len(text)
        self.sigma = sigma = int(text.max()) + 1
        sa = suffix_array(text)
        bwt = text[sa - 1]  # position 0 gives the last symbol, a separator
        self.first = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        marked = (sa % rate == 0) | (bwt == 0)
        self.marked, self.samples = Bits(marked), sa[marked]
        self.levels, self.zeros = [], []
        self.depth = max(1, (sigma - 1).bit_length())
        cur = bwt
        for b in range(self.depth - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            cur = np.concatenate((cur[~bit], cur[bit]))
        #: where the occurrences of a symbol begin at the lowest level
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, zeros, b in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            ones = level.rank(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``symbol`` + pattern, from the rows [lo, hi) of each pattern. Symbols lie in 1..sigma-1."""
        base = self.first[symbol] - self.begin[symbol]
        return base + self._down(symbol, lo), base + self._down(symbol, hi)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each line of a matrix of symbols; equal where it doesn't occur."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        live = np.flatnonzero(((patterns > 0) & (patterns < self.sigma)).all(axis=1))
        hi[np.setdiff1d(np.arange(m), live)] = 0
        for k in range(length - 1, -1, -1):
            lo[live], hi[live] = self.extend(patterns[live, k], lo[live], hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows that begin with no separator."""
        rows = np.asarray(rows, dtype=np.int64)
        found = np.empty(len(rows), dtype=np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            here = self.marked.at(at)
            done = left[here]
            found[done] = self.samples[self.marked.rank(at[here])] + steps
            left, at = left[~here], at[~here]
            symbol, i = np.zeros(len(at), dtype=np.int64), at
            for level, zeros in zip(self.levels, self.zeros):
                bit, ones = level.at(i), level.rank(i)
                symbol = (symbol << 1) | bit
                i = np.where(bit, zeros + ones, i - ones)
            at = self.first[symbol] + i - self.begin[symbol]
            steps += 1
        return found


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and for each the range it is of."""
    count = hi - lo
    of = np.repeat(np.arange(len(lo)), count)
    start = np.repeat(np.cumsum(count) - count, count)
    return lo[of] + np.arange(len(of)) - start, of
