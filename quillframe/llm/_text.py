"""Word tables over Arrow text columns.

Texts stay in the contiguous UTF-8 buffer that Arrow hands over; words are pairs of byte offsets
into it and are hashed with prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one step of the columnar code works on (a longer document is a step alone).
CHUNK_BYTES = 1 << 19


def _odd_random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=U64) | U64(1)


def byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bytes of ``[^\\x20\\x09-\\x0D]+``, word bytes of lower-cased letters/digits/non-ASCII, lower-casing)."""
    ws = np.ones(256, bool)
    ws[[9, 10, 11, 12, 13, 32]] = False
    alnum = np.zeros(256, bool)
    alnum[0x30:0x3A] = alnum[0x61:0x7B] = alnum[0x80:] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return ws, alnum, lower


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a copy."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U64(base | 1), U64(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(m - 1, b, U64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


class Hasher:
    """64-bit hashes of byte ranges and of word sequences; equal inputs hash alike in every process."""

    def __init__(self, seed: int = 7) -> None:
        self.table = _odd_random(seed, 256)
        a, b = (int(x) for x in _odd_random(seed + 1, 2))
        self.bytes, self.words = Powers(a), Powers(b)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U64)
        up, down = self.bytes.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def grams(self, word_hash: np.ndarray, n: int) -> np.ndarray:
        """Of the n words from each position on; the last n - 1 positions have none."""
        m = len(word_hash)
        if m < n:
            return np.zeros(0, U64)
        up, down = self.words.upto(m + 1)
        total = np.zeros(m + 1, U64)
        np.cumsum(word_hash * up[:m], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[: m - n + 1] + U64(n))

    def spans(self, word_hash: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of word_hash[starts[i]:ends[i]]."""
        up, down = self.words.upto(len(word_hash) + 1)
        total = np.zeros(len(word_hash) + 1, U64)
        np.cumsum(word_hash * up[: len(word_hash)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them); a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        raise TypeError(f"text column expected, not {column.type}")
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind the last, index of each row's first word and the end) of all words."""
    flag = is_word[data]
    first, last = flag.copy(), flag.copy()
    if len(data):
        first[1:] &= ~flag[:-1]
        last[:-1] &= ~flag[1:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        first[cut] = flag[cut]
        last[cut - 1] = flag[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def rows_of(counts_at: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))


def inside(at: np.ndarray, n: int) -> np.ndarray:
    """Positions of items from which n items of the same row follow (itself the first)."""
    row = rows_of(at)
    pos = np.arange(at[-1] - at[0])
    return pos[pos + n <= at[1:][row]]
