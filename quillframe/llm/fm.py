"""A succinct FM-index over integer sequences: wavelet matrix of the Burrows-Wheeler transform, sampled suffix positions.

Symbol 0 ends a piece and never takes part in a match. All searches work on many patterns at a time.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a round sorts only suffixes whose rank is still shared."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # the rank of a suffix is the place of the first suffix of its group, so that settled ones never move
    first = np.searchsorted(rank[order], np.arange(rank.max() + 1 if n else 0))
    rank = first[rank]
    h = 1
    while True:
        shared = np.flatnonzero((rank[order] == np.concatenate([[-1], rank[order][:-1]])) | (rank[order] == np.concatenate([rank[order][1:], [-1]])))
        if not len(shared):
            return order
        at = order[shared]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1) + 1
        key = (rank[at].astype(U64) << U64(32)) | ahead.astype(U64)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[shared] = at  # groups keep their places, as the high half of the key is the place
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, shared, 0))
        h *= 2


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        p = np.packbits(bits, bitorder="little")
        packed[: len(p)] = p
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32 if n < 1 << 31 else np.int64)
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(bool)


class FMIndex:
    """Of one shard's text (non-negative integers, 0 between pieces)."""

    def __init__(self, text: np.ndarray, sample: int = 4) -> None:
        text = np.concatenate([np.asarray(text, np.int64) + 1, [0]])  # the end is a symbol of its own: only so do walks to the left hold
        self.n, self.sample = len(text), sample
        order = suffix_array(text)
        bwt = text[order - 1]
        self.sigma = int(text.max()) + 1
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            b = ((bwt >> level) & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(len(b) - int(b.sum()))
            bwt = np.concatenate([bwt[~b], bwt[b]])
        self.first = np.searchsorted(self._bit_reversed(bwt), self._bit_reversed(np.arange(self.sigma)))
        marked = order % sample == 0
        self.marks, self.positions = Bits(marked), order[marked].astype(np.int32 if self.n < 1 << 31 else np.int64)

    def _bit_reversed(self, s: np.ndarray) -> np.ndarray:
        """The order in which the wavelet matrix leaves the symbols at its end."""
        out = np.zeros_like(s)
        for level in range(self.levels):
            out |= ((s >> level) & 1) << (self.levels - 1 - level)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the first i places of the transform."""
        for k, level in enumerate(reversed(range(self.levels))):
            one = self.bits[k].rank(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + one, i - one)
        return i - self.first[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, from those of the patterns; symbols as stored, one above the text's."""
        n = len(lo)
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.counts[symbol] + both[:n], self.counts[symbol] + both[n:]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of a matrix; an interval is empty where the pattern does not occur."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns > 0).all(1) & (patterns < self.sigma - 1).all(1))
        lo[np.setdiff1d(np.arange(len(patterns)), alive)] = self.n
        for k in reversed(range(patterns.shape[1])):
            lo[alive], hi[alive] = self.extend(patterns[alive, k] + 1, lo[alive], hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        return lo, np.maximum(lo, hi)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least_hits: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end in ends: the length (at most most) of the longest piece of text that ends there and
        occurs at least least_hits times, with its interval. Symbols unknown to the index or 0 end a piece."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        length, alive = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for k in range(most):
            at = ends[alive] - 1 - k
            symbol = np.where(at >= 0, text[np.maximum(at, 0)], 0)
            ok = (symbol > 0) & (symbol < self.sigma - 1)
            alive, symbol = alive[ok], symbol[ok]
            a, b = self.extend(symbol + 1, lo[alive], hi[alive])
            ok = b - a >= least_hits
            alive = alive[ok]
            lo[alive], hi[alive], length[alive] = a[ok], b[ok], k + 1
            if not len(alive):
                break
        return length, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes: walk to the next sampled one on the left."""
        out, todo, row, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marks.get(row)
            out[todo[hit]] = self.positions[self.marks.rank(row[hit])] + walked
            todo, i = todo[~hit], row[~hit]
            symbol = np.zeros(len(i), np.int64)
            for k, level in enumerate(reversed(range(self.levels))):
                b = self.bits[k].get(i)
                one = self.bits[k].rank(i)
                symbol |= b.astype(np.int64) << level
                i = np.where(b, self.zeros[k] + one, i - one)
            row = self.counts[symbol] + i - self.first[symbol]
            walked += 1
        return out

    @property
    def nbytes(self) -> int:
        return sum(b.words.nbytes + b.before.nbytes for b in [*self.bits, self.marks]) + self.positions.nbytes


def interval_rows(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the interval, row) for all rows of all intervals."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
