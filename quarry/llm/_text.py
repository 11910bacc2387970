"""Byte-level text kernels in numpy, over many texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 equals
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = _U64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; bounds the temporary arrays for texts of any length.
_SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U64) * _ODD)


class _Powers:
    """Powers of an odd base modulo 2**64, extended as longer words come."""

    def __init__(self) -> None:
        self.table = np.ones(1, _U64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = np.concatenate([np.ones(1, _U64), np.cumprod(np.full(max(n, 256) * 2, 0xD6E8FEB86659FD93, _U64))])
        return self.table


_POWERS = _Powers()


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a uint8 array."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint ascending byte spans; equal spans have equal hashes."""
    out = np.empty(len(starts), _U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _SLICE, "right")))
        s, length = starts[lo:hi], ends[lo:hi] - starts[lo:hi]
        first = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(first, length)
        value = _BYTE[data[inside + np.repeat(s, length)]] * _POWERS.upto(int(length.max(initial=0)))[inside]
        out[lo:hi] = np.add.reduceat(value, first) if len(value) else 0
        out[lo:hi] += length.astype(_U64) * _ODD
        lo = hi
    return mix(out)


def batch_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and its offsets by text (one more than texts)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_spans(data)
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(data, starts, ends), np.searchsorted(starts, edge)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, _U64)
    for i in range(k):
        out = out * _U64(0xD1342543DE82EF95) + words[i : len(words) - k + 1 + i]
        out ^= out >> _U64(29)
    return mix(out + _U64(k))


def groups(sizes: list[int], limit: int):
    """Consecutive (first, end) ranges whose sizes sum to about ``limit``."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
