"""Words of whole texts as hashes, in numpy: what the shingle and passage operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
# Odd multipliers of the polynomial and of the finaliser.
BASE = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> S33)
    x = x * MIX_1
    x ^= x >> S33
    x = x * MIX_2
    x ^= x >> S33
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word hashes of a block of texts, one text after the other.

    ``hashes`` holds a 64-bit hash per word (bytes between space and U+0009-U+000D, A-Z lowered),
    ``first`` the index of each text's first word plus a final end.
    """

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
        space = _SPACE[joined]
        word = ~space
        start = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
        stop = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
        self.start, self.stop, self.text_at = start, stop, np.concatenate(([0], ends))
        self.first = np.searchsorted(start, self.text_at)
        if not len(start):
            self.hashes = np.empty(0, dtype=np.uint64)
            return
        # each byte times a power that counts from the start of its word
        at = np.arange(len(joined), dtype=np.int64)
        begin = np.zeros(len(joined), dtype=np.int64)
        begin[start] = start
        np.maximum.accumulate(begin, out=begin)
        offset = at - begin
        powers = _powers(int((stop - start).max()) + 1, BASE)
        offset[space] = 0
        value = (_LOWER[joined].astype(np.uint64) + np.uint64(1)) * powers[offset]
        value[space] = 0
        total = np.add.reduceat(value, start)
        self.hashes = mixed(total ^ (stop - start).astype(np.uint64))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, in order; empty when there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j, k in enumerate(_powers(n + 1, 0xD6E8FEB86659FD93)[1:]):
        out += hashes[j : j + m] * k
    return mixed(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Order-dependent hash of all the words."""
    if not len(hashes):
        return np.uint64(0)
    return mixed(np.array([np.sum(hashes * _powers(len(hashes) + 1, 0xA0761D6478BD642F)[1:], dtype=np.uint64)], dtype=np.uint64))[0]


def text_blocks(column: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive slices (number of the first row, texts as bytes) of about ``limit`` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin, n = 0, len(column)
    while begin < n:
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield begin, [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end


def word_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, word hashes) of every text."""
    for begin, texts in text_blocks(column):
        words = Words(texts)
        for i in range(len(texts)):
            yield begin + i, words.of(i)
