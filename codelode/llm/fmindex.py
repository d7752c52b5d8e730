"""A compressed FM-index over integer sequences, searched for many patterns in step."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; a shorter suffix comes before its extensions."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[:-step] += rank[step:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        rank, step = new, step * 2
        if step >= n or rank[order[-1]] == n:
            return order


class WaveletMatrix:
    """Rank over a sequence of symbols, in ``bits`` packed levels with a count for every 64 positions."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n, self.bits = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(U64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.words[level][word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return self.counts[level][word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair: a number that grows by one per occurrence of ``symbol`` before ``at``; see :class:`FMIndex`."""
        at = at.astype(np.int64)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search with the document of every occurrence.

    ``text`` is documents of symbols from 2 up, each followed by a separator 1; a
    terminator 0 is added. ``owner`` gives the document number of every position.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, sigma: int) -> None:
        whole = np.append(text, 0)
        sa = suffix_array(whole)
        self.bwt = WaveletMatrix(whole[sa - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(whole, minlength=sigma))))
        # rank() ends on the last level, where equal symbols lie together: subtracting a symbol's start there leaves the count.
        self.base = self.bwt.rank(np.arange(sigma), np.zeros(sigma, np.int64))
        docs = np.append(owner, -9)[sa]
        self.docs = docs
        change = np.append(np.flatnonzero(docs[1:] != docs[:-1]) + 1, len(docs))
        self.next_other = change[np.searchsorted(change, np.arange(len(docs)), side="right")]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` followed by what ``[lo, hi)`` stands for."""
        m = len(lo)
        both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        start = self.first[symbol] - self.base[symbol]
        return start + both[:m], start + both[m:]

    def elsewhere(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether an interval holds an occurrence of a document other than ``own``."""
        at = np.minimum(lo, len(self.docs) - 1)
        return (lo < hi) & ((self.docs[at] != own) | (self.next_other[at] < hi))

    def reach(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Matching statistics from the right: the least ``r >= start`` with ``codes[r:end + 1]`` in another document.

        ``end + 1`` if not even one symbol is. ``codes`` holds the patterns end to end.
        """
        pos, out = end.copy(), end + 1
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.bwt.n, np.int64)
        while len(live):
            lo, hi = self.step(codes[pos[live]], lo, hi)
            good = self.elsewhere(lo, hi, own[live])
            live, lo, hi = live[good], lo[good], hi[good]
            out[live] = pos[live]
            pos[live] -= 1
            more = pos[live] >= start[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return out
