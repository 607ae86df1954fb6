"""Vectorised word scanning of UTF-8 texts.

Words are maximal runs of bytes outside a separator set that is pure ASCII, so
working on bytes equals working on characters. A-Z are lower-cased, nothing
else. Every word is identified by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Words of the language model and of near-duplicate detection: [^\x20\x09-\x0D]+
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[9, 10, 11, 12, 13, 32]] = False

# Words of decontamination, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True

_BYTE = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (a bijection on 64-bit integers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(256, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        p = np.full(max(n, 2 * len(_POWERS)), _PRIME, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    elif _POWERS[1] == 1:
        _POWERS[1:] = _PRIME
        _POWERS = np.multiply.accumulate(_POWERS)
    return _POWERS[:n]


@dataclass
class Words:
    """Words of several texts: ``ids[ptr[i]:ptr[i + 1]]`` belong to text ``i``;
    ``start``/``end`` index ``buf``, the lower-cased bytes of all texts."""

    ids: np.ndarray
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buf: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def scan(texts: list[bytes], is_word: np.ndarray) -> Words:
    raw = b"\n".join(texts) + b"\n"
    buf = LOWER[np.frombuffer(raw, dtype=np.uint8)]
    mask = is_word[buf]
    step = np.diff(mask.view(np.int8), prepend=np.int8(0))
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    length = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ptr = np.searchsorted(start, np.concatenate([[0], np.cumsum(length)]))
    size = end - start
    if not len(start):
        return Words(np.zeros(0, np.uint64), ptr, start, end, buf)
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(int(size.sum())) - np.repeat(offset, size)
    terms = _BYTE[buf[mask]] * powers(int(size.max()))[inside]
    ids = mix64(np.add.reduceat(terms, offset) + size.astype(np.uint64) * _PRIME)
    return Words(ids, ptr, start, end, buf)


def ngram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit ids of the ``n`` consecutive words at each position."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= _PRIME
        out += ids[k:k + m] ^ (ids[k:k + m] >> np.uint64(29))
    return mix64(out)
