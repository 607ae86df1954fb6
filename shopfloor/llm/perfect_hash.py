"""Minimal perfect hashing of 128-bit digests into flat numpy tables.

Level by level, digests that are alone at their place of a bit array set its
bit; the others go on to the next, smaller array. A digest's slot is the number
of bits set before its own, so n distinct digests fill the slots 0 to n - 1.
The table keeps the digest of every slot: a looked-up digest that is not the
slot's own is reported as absent, never as somebody else.
"""

from __future__ import annotations

import numpy as np

from shopfloor.llm.tokens import mix64

MOST_LEVELS = 200  # distinct digests need a few dozen at most
_STEP = 0x9E3779B97F4A7C15


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((2 * level + 1) * _STEP % (1 << 64))
    return (mix64(mix64(a.view(np.uint64) + seed) ^ b.view(np.uint64)) % np.uint64(size)).astype(np.int64)


class NodeTable:
    """Slots of distinct digests ``(a[i], b[i])`` (64-bit integers)."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, used = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("digests are not distinct")
            size = 2 * len(rest) + 8
            at = _place(a[rest], b[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            self.levels.append((bits, used + np.cumsum(bits) - 1))
            used += int(bits.sum())
            rest = rest[~alone]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        slot = self._slot(a, b)
        self.a[slot], self.b[slot] = a, b

    def __len__(self) -> int:
        return len(self.a)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        rest = np.arange(len(a))
        for k, (bits, rank) in enumerate(self.levels):
            at = _place(a[rest], b[rest], k, len(bits))
            hit = bits[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The digests' slots; -1 where the table does not hold the digest."""
        s = self._slot(a, b)
        ok = s >= 0
        ok[ok] = (self.a[s[ok]] == a[ok]) & (self.b[s[ok]] == b[ok])
        return np.where(ok, s, -1)
