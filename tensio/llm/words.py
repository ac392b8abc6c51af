"""Words and word n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than U+0020 and U+0009-U+000D.  Hashes are 64-bit: per word a
polynomial over a random value per byte, finished by a bijective mixer; n-grams combine
word hashes by doubling, mixed at every step, so an n-gram's hash depends on order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[i for i in range(128) if not chr(i).isalnum()]] = 32
_U = np.uint64


def _byte_values(seed: int, zero: list[int]) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | _U(1)
    values[zero] = 0
    return values


_SPACES = [32, 9, 10, 11, 12, 13]
#: Byte values and multiplier of two independent hashes.
_FAMILY = [(_byte_values(101, _SPACES), _U(0x9E3779B97F4A7C15)), (_byte_values(202, _SPACES), _U(0xC2B2AE3D27D4EB4F))]
_LINE = _byte_values(303, [10])


def is_space(data: np.ndarray) -> np.ndarray:
    return _WS[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place on its own copy)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _run_hash(data: np.ndarray, starts: np.ndarray, values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of each run ``starts[i]:starts[i+1]``; bytes whose value is 0 do not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(starts, append=len(data))
    at = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, sizes)
    part = values[data[starts[0] :]]
    part *= _powers(base, int(sizes.max()))[at]
    return mix(np.add.reduceat(part, starts - starts[0]))


@dataclass
class Words:
    """Words of a batch of texts; ``first[d]:first[d+1]`` are the words of text ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, family: int = 0) -> np.ndarray:
        values, base = _FAMILY[family]
        return _run_hash(self.data, self.starts, values, base)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text start here or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return lead[self.ends] - lead[self.starts]


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False) -> Words:
    """``lower``: A-Z are lower-cased.  ``letters``: ASCII characters other than letters and digits
    count as white space, and with ``lower`` the capitals U+00C0 to U+00DE are lower-cased too."""
    if lower:
        data = _LOWER[data]
    if lower and letters and len(data):
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + np.uint8(32) * capital
    if letters:
        data = _LETTERS[data]
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), np.int64))
    space = _WS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space
    start, end = word.copy(), word.copy()
    start[1:] &= space[:-1] | edge[1:n]
    end[:-1] &= space[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def shifted(a: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    if by < len(a):
        out[: len(a) - by] = a[by:]
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U(0x9FB21C651E98DF25) + (right ^ _U(0xD6E8FEB86659FD93)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position; the last ``n - 1`` of a text reach beyond
    it and are for the caller to leave out (``Words.room() >= n``)."""
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power if out is None else joined(out, shifted(power, have))
            have += size
        size *= 2
        if size > n:
            return out
        power = joined(power, shifted(power, size // 2))


def covered(flagged: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words whose start is flagged."""
    edge = np.zeros(len(flagged) + n + 1, np.int32)
    edge[: len(flagged)] += flagged
    edge[n : n + len(flagged)] -= flagged
    return np.cumsum(edge)[: len(flagged)] > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(keys), bool)
    if len(twice):
        maybe = np.zeros(1 << 20, bool)
        maybe[twice >> _U(44)] = True
        at = np.flatnonzero(maybe[keys >> _U(44)])
        found = np.searchsorted(twice, keys[at])
        found[found == len(twice)] = 0
        out[at] = twice[found] == keys[at]
    return out


def by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word values over each text."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Lines:
    """Lines (split at U+000A) of a batch of texts; a last empty line is left out."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n:
        edge[1:] |= data == 10
    starts = np.flatnonzero(edge[:n])
    ends = np.append(starts[1:], n)
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if n else ends[:0]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    h = _run_hash(data, starts, _LINE, _FAMILY[0][1])
    return Lines(starts, ends, doc, mix(h + (ends - starts).astype(np.uint64)))
