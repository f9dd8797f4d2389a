"""A compressed full-text index of word numbers (FM-index over a wavelet matrix), searched for many streams at once.

Rows are the suffixes in the order of their first words, sorted by doubling up to a depth that covers what is
searched, so that rows alike that far stay in text order. Kept are the bits of the wavelet
matrix of the words before them (one bit and a half a word and level), where each word's rows start, and a
byte a row for how far it agrees with the row above. Text and suffix order go.

A search reads a stream from its end and keeps the rows that start with what was read, at most ``depth - 1``
words of it. A word more is two ranks a level. If no row has it, the last word is
dropped, which widens the rows to those that agree so far. So each step knows the longest match that starts at its
place, up to ``depth`` words: the matching statistics of the stream.

Edge cases: no text gives an index without rows, in which nothing matches; 0 ends a text and never
matches; words outside the index match nothing.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Ranks of ones by a count a 64-bit block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(8 + (-packed.size) % 8, np.uint8)).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]).astype(np.int32)
        self.zeros = bits.size - int(np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class FmIndex:
    def __init__(self, word: np.ndarray, depth: int):
        """``word``: numbers of the words of all texts, from 1 on, with a 0 after each text; below 2**31 in all."""
        self.depth, self.n = depth, word.size
        order, ranks = _order(word.astype(np.int64), depth)
        self.agree = _agreement(order, ranks, depth).astype(np.uint8)
        self.order = order
        n_words = int(word.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])
        column = word[order - 1] if self.n else word
        self.levels = []
        for level in reversed(range(max(1, (n_words - 1).bit_length()))):
            ones = (column >> level) & 1 == 1
            self.levels.append((level, BitVector(ones)))
            column = np.concatenate([column[~ones], column[ones]])
        # where each word's rows lie in the last order of the matrix
        self.block = np.zeros(n_words, np.int64)
        if self.n:
            new = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            self.block[column[new]] = new
        self.starts: dict[int, np.ndarray] = {}
        self.group = np.cumsum(self.agree < depth - 1) - 1

    def forget_places(self) -> np.ndarray:
        """The place in the text of each row; the index does not need it."""
        order, self.order = self.order, None
        return order

    def rows_of(self, depth: int) -> np.ndarray:
        """First rows of the groups that agree in ``depth`` words, and the number of rows."""
        if depth not in self.starts:
            self.starts[depth] = np.append(np.flatnonzero(self.agree < depth), self.n)
        return self.starts[depth]

    def extend(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with ``word`` and then as rows ``low`` to ``high`` (excluded) do."""
        a, b = low, high
        for level, bits in self.levels:
            one = (word >> level) & 1 == 1
            x, y = bits.rank(a), bits.rank(b)
            a, b = np.where(one, bits.zeros + x, a - x), np.where(one, bits.zeros + y, b - y)
        move = self.first[word] - self.block[word]
        return a + move, b + move

    def matching(self, word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streams in ``word`` (which end before ``ends``): words matched from there on, up to depth, and the first row that has them."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        by_length = np.argsort(starts - ends, kind="stable")
        ends, sizes = ends[by_length], (ends - starts)[by_length]
        matched, row = np.zeros(word.size, np.int16), np.zeros(word.size, np.int64)
        low, high, deep = np.zeros(ends.size, np.int64), np.full(ends.size, self.n, np.int64), np.zeros(ends.size, np.int16)
        top = self.rows_of(self.depth - 1)
        for t in range(int(sizes[0]) if sizes.size else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # streams of more than t words
            low, high, deep = low[:live], high[:live], deep[:live]
            at = ends[:live] - 1 - t
            w = word[at]
            known = (w > 0) & (w < self.block.size)
            w = np.where(known, w, 0)
            a, b = self.extend(low, high, w)
            b = np.where(known, b, a)
            while (empty := np.flatnonzero((a >= b) & (deep > 0))).size:
                self._shorten(empty, low, high, deep)
                a[empty], b[empty] = self.extend(low[empty], high[empty], w[empty])
                b[empty] = np.where(known[empty], b[empty], a[empty])
            hit = a < b
            deep = np.where(hit, deep + 1, 0).astype(np.int16)
            matched[at], row[at] = deep, a
            low, high = np.where(hit, a, 0), np.where(hit, b, self.n)
            if (full := np.flatnonzero(deep == self.depth)).size:
                g = self.group[low[full]]
                low[full], high[full], deep[full] = top[g], top[g + 1], self.depth - 1
        return matched, row

    def _shorten(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, deep: np.ndarray) -> None:
        """Drop last words until there are more rows."""
        below = np.where(high[at] < self.n, self.agree[np.minimum(high[at], self.n - 1)], 0)
        deep[at] = np.minimum(np.maximum(self.agree[low[at]], below), deep[at] - 1)
        for d in np.unique(deep[at]):
            own = at[deep[at] == d]
            if d == 0:
                low[own], high[own] = 0, self.n
            else:
                starts = self.rows_of(int(d))
                g = np.searchsorted(starts, low[own], "right") - 1
                low[own], high[own] = starts[g], starts[g + 1]


def _order(word: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first words, as many as the power of two from ``depth`` on, and ranks by 1, 2, 4, ... words."""
    n = word.size
    ranks, h = [word], 1
    order = np.argsort(word, kind="stable")
    while h < depth and n:
        rank = ranks[-1]
        after = np.append(rank[h:] + 1, np.zeros(min(h, n), np.int64))
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        ranks.append(new)
        h *= 2
    return order, ranks


def _agreement(order: np.ndarray, ranks: list[np.ndarray], depth: int) -> np.ndarray:
    """Words that each row shares with the one above, up to ``depth``."""
    n = order.size
    out = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for k in reversed(range(len(ranks))):
        rank = np.append(ranks[k], -1)
        same = (a < n) & (b < n) & (rank[np.minimum(a, n)] == rank[np.minimum(b, n)])
        a[same] += 1 << k
        b[same] += 1 << k
    out[1:] = a - order[1:]
    return np.minimum(out, depth)
