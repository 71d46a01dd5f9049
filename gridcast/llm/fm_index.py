"""A succinct full-text index over a sequence of symbols, built and searched inside one task.

Symbol 0 ends a text; no pattern may hold it. The wavelet matrix keeps one bit per symbol and
level, with a running count per 64 bits, so an index takes ``1.5 * log2(symbols)`` bits a
symbol, plus the sampled suffix positions.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Ends are unlike each other, earlier ones smaller."""
    n = len(seq)
    ends = seq == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, seq.astype(np.int64) + n_ends)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        if step < n:
            follow[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(key[1:] != key[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """How often a symbol stands before a position, for many symbols and positions at once."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.n = len(seq)
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        cur = seq
        for level in reversed(range(self.levels)):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(self.n - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.first = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _ones(self, level: int, pos: np.ndarray) -> np.ndarray:
        at = pos >> 6
        below = (_ONE << (pos & 63).astype(np.uint64)) - _ONE
        return self.counts[level][at] + np.bitwise_count(self.words[level][at] & below)

    def _down(self, symbols: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, pos)
            is_one = (symbols >> (self.levels - 1 - level)) & 1
            pos = np.where(is_one == 1, self.zeros[level] + ones, pos - ones)
        return pos

    def rank(self, symbols: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return self._down(symbols, pos) - self.first[symbols]

    def at(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some positions, and how often each stands before."""
        symbols = np.zeros(len(pos), np.int64)
        for level in range(self.levels):
            is_one = (self.words[level][pos >> 6] >> (pos & 63).astype(np.uint64)) & _ONE
            ones = self._ones(level, pos)
            pos = np.where(is_one == 1, self.zeros[level] + ones, pos - ones)
            symbols = 2 * symbols + is_one.astype(np.int64)
        return symbols, pos - self.first[symbols]


class FMIndex:
    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 16, weights: np.ndarray | None = None):
        """``sample``: every so many positions one is kept for :meth:`locate`; 0: none.

        ``weights``: how often each position counts; see :meth:`matching`."""
        order = suffix_array(seq)
        bwt = seq[order - 1]                               # position 0 is preceded by the last end
        self.n = len(seq)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.bwt = WaveletMatrix(bwt, n_symbols)
        if weights is not None:
            self.mass = np.concatenate([[0], np.cumsum(weights[order])])
        if sample:
            kept = (order % sample == 0) | (bwt == 0)      # text starts too: no walk crosses an end
            self.kept = np.packbits(kept, bitorder="little")
            self.rows = np.flatnonzero(kept)
            self.at = order[kept]

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the patterns with one more symbol in front."""
        both = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        base = self.before[symbols]
        return base + both[:len(symbols)], base + both[len(symbols):]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[lo, hi)`` of each pattern; ``patterns`` is padded on the right."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (hi > lo))
            if not len(live):
                break
            lo[live], hi[live] = self.extend(patterns[live, lengths[live] - back], lo[live], hi[live])
        return lo, hi

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Matching statistics up to ``length``: of ``text[start:start + length]``, how many symbols
        counted from the end still match with a mass of at least ``least``."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        matched = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        for back in range(1, length + 1):
            lo[live], hi[live] = self.extend(text[starts[live] + length - back], lo[live], hi[live])
            live = live[self.mass[hi[live]] - self.mass[lo[live]] >= least]
            matched[live] = back
        return matched

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: step back to the next sampled one."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while True:
            kept = (self.kept[rows[open_] >> 3] >> (rows[open_] & 7)) & 1
            open_ = open_[kept == 0]
            if not len(open_):
                return self.at[np.searchsorted(self.rows, rows)] + steps
            symbols, before = self.bwt.at(rows[open_])
            rows[open_] = self.before[symbols] + before
            steps[open_] += 1
