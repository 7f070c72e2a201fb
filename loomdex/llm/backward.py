"""Compressed FM-index over word sequences: wavelet-matrix rank, matching statistics by backward search in lockstep."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit planes of a symbol sequence, one level a bit, with one running count a 64-bit word."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.words, self.before, self.zeros = [], [], []
        at = values
        for level in reversed(range(self.levels)):
            bit = (at >> level) & 1
            n = len(bit)
            packed = np.zeros(-(-n // 64) * 8 + 8, np.uint8)
            p = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(p)] = p
            words = packed.view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(n - int(counts.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence ends up below all levels, following ``symbol``'s bits."""
        for level in range(self.levels):
            word = i >> 6
            inside = self.words[level][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[level][word] + np.bitwise_count(inside).astype(np.int64)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return i


class BackwardIndex:
    """Index of several word sequences, each ended by a mark of its own that sorts below all words.

    ``weights`` tells how often each sequence occurs; an interval of suffix-array rows weighs what
    its rows weigh. ``lcp`` of a row is the common prefix with the row before, ``left`` and ``right``
    are the nearest rows of a shorter one, so an interval's parent is found at once.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        count = len(sizes)
        self.alphabet, ids = np.unique(words, return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        n = self.n = int(ends[-1]) + 1 if count else 0
        text = np.empty(n, np.int64)
        is_word = np.ones(n, bool)
        is_word[ends] = False
        text[ends] = np.arange(count)
        text[is_word] = count + ids
        order, lengths = self._suffixes(text)
        self.lcp = np.r_[lengths, -1] if n else np.zeros(1, np.int64)
        self.least = [self.lcp.astype(np.int32)]
        while (half := 1 << len(self.least) - 1) < len(self.least[-1]):
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        owner = np.repeat(np.arange(count), sizes + 1)
        self.weight = np.r_[0, np.cumsum(weights[owner][order])] if n else np.zeros(1, np.int64)
        shown = np.where(is_word, text - count + 1, 0)
        self.tree = WaveletMatrix(shown[order - 1], len(self.alphabet))
        symbols = np.arange(len(self.alphabet) + 1)
        counts = np.bincount(shown, minlength=len(symbols))
        self.shift = np.cumsum(counts) - counts - self.tree.descend(symbols, np.zeros(len(symbols), np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array by prefix doubling, and each row's common prefix with the row before (-1 for the first), read off the ranks of all rounds."""
        n, rank, step, ranks = len(text), text, 1, [text]
        order = np.argsort(text, kind="stable")
        while n:
            ahead = np.zeros(n, np.int64)
            if step < n:
                ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 2) + ahead
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1:
                break
            ranks.append(rank)
        a, b, same = order[1:].copy(), order[:-1].copy(), np.zeros(max(0, n - 1), np.int64)
        for j in reversed(range(len(ranks))):
            inside = np.maximum(a, b) < n
            equal = np.zeros(len(a), bool)
            equal[inside] = ranks[j][a[inside]] == ranks[j][b[inside]]
            jump = equal.astype(np.int64) << j
            a, b, same = a + jump, b + jump, same + jump
        return order, np.r_[-1, same][:n]

    def _before(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The last row before each of ``at`` whose lcp is less than ``size``, by halving steps over minima of blocks."""
        at = at.copy()
        for k in reversed(range(len(self.least))):
            first = at - (1 << k)
            ok = np.flatnonzero(first >= 0)
            ok = ok[self.least[k][first[ok]] >= size[ok]]
            at[ok] = first[ok]
        return at - 1

    def _behind(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first row after each of ``at`` whose lcp is less than ``size``."""
        at = at + 1
        for k in reversed(range(len(self.least))):
            ok = np.flatnonzero(at + (1 << k) <= self.n + 1)
            ok = ok[self.least[k][at[ok]] >= size[ok]]
            at[ok] += 1 << k
        return at

    def statistics(self, words: np.ndarray, sizes: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: for each position of the given sequences, how many words from here occur with a weight of ``least``.

        All sequences stream backwards together. A word in front narrows the interval; where that
        leaves too little weight, the match gives up its last words, down to the parent interval, and tries again.
        """
        where = np.minimum(np.searchsorted(self.alphabet, words), max(0, len(self.alphabet) - 1))
        known = self.alphabet[where] == words if len(self.alphabet) else np.zeros(len(words), bool)
        ids = np.where(known, where + 1, -1)
        out = np.zeros(len(words), np.int64)
        starts = np.cumsum(sizes) - sizes
        at = starts + sizes - 1
        low, high, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64), np.zeros(len(sizes), np.int64)
        open_ = np.flatnonzero(sizes > 0)
        while len(open_):
            lo, hi, here = low[open_], high[open_], at[open_]
            symbol = np.maximum(ids[here], 0)
            both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
            a, b = both[: len(lo)], both[len(lo) :]
            ok = (ids[here] > 0) & (b > a)
            ok[ok] = self.weight[b[ok]] - self.weight[a[ok]] >= least
            won, lost = open_[ok], open_[~ok]
            low[won], high[won] = a[ok], b[ok]
            size[won] += 1
            none = lost[size[lost] == 0]
            shrunk = lost[size[lost] > 0]
            lo, hi = low[shrunk], high[shrunk]
            parent = np.maximum(self.lcp[lo], self.lcp[hi])
            wide = parent <= 0
            low[shrunk[wide]], high[shrunk[wide]] = 0, self.n
            size[shrunk] = np.maximum(parent, 0)
            if not wide.all():
                for rows, edge, step in ((low, lo, self._before), (high, hi, self._behind)):
                    go = np.flatnonzero((self.lcp[edge] == parent) & ~wide)
                    rows[shrunk[go]] = step(edge[go], parent[go])
            for done in (won, none):
                out[at[done]] = size[done]
                at[done] -= 1
            open_ = open_[at[open_] >= starts[open_]]
        return out
