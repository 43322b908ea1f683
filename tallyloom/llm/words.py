"""Words and word shingles of many texts at once, as numpy arrays.

A word is a maximal run of bytes that are neither ASCII punctuation, white space nor control characters, after A-Z are
lower-cased: the pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ on code points, as all bytes of a non-ASCII character are
0x80 or more. All arrays are over the words of a batch of texts; hashes have 64 bits and are the same on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallyloom.llm.common import text_bytes

_LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    _LOWER[_b] = _b + 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scramble of 64-bit numbers."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        steps = np.full(max(n, _SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=np.uint64)
        if n <= _SEGMENT + 4096:
            _powers[name] = got
    return got[:n]


@dataclass
class Words:
    lower: np.ndarray  # bytes, lower-cased; 0 between words
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past the last byte
    first: np.ndarray  # index of each text's first word; one more than texts
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.lower[self.start[i] : self.end[i]].tobytes()

    def texts(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space; they must belong to one text."""
        return b" ".join(self.lower[s:e].tobytes() for s, e in zip(self.start[max(i, 0) : j], self.end[max(i, 0) : j], strict=True))


def words_of(arr: pa.Array) -> Words:
    data, offsets = text_bytes(arr)
    lower = _LOWER[data]
    n = len(lower)
    edge = np.zeros(n + 2, np.bool_)
    edge[1 : n + 1] = lower != 0
    inner = edge[1 : n + 1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts = inner & ~edge[:n]
    starts[cut] |= inner[cut]
    ends = inner & ~edge[2:]
    ends[cut - 1] |= inner[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(lower, start, end, np.searchsorted(start, offsets), _hashes(lower, start, end))


def _hashes(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes, from running sums over segments of many words."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _SEGMENT)))
        base, n = start[i], int(end[j - 1] - start[i])
        up, down = _power("up", _BASE, n), _power("down", _BASE_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(lower[base : base + n] * up, out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one text, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    inside = np.ones(n, np.bool_)
    for k in range(1, size):
        bad = first[1:-1] - k
        inside[bad[(bad >= 0) & (bad < n)]] = False
    at = np.flatnonzero(inside)
    return h[at], at


def shingle_bags(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of every shingle, in order; a text of fewer words, but not none, is one shingle."""
    h, at = shingles(words.hash, words.first, size)
    of = np.searchsorted(words.first, at, side="right") - 1
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            x = np.uint64(counts[d])
            with np.errstate(over="ignore"):
                for w in words.hash[words.first[d] : words.first[d + 1]]:
                    x = mix(np.array([x ^ w], np.uint64))[0]
            extra[k] = x
        order = np.argsort(np.concatenate([of, short]), kind="stable")
        return np.concatenate([of, short])[order], np.concatenate([h, extra])[order]
    return of, h
