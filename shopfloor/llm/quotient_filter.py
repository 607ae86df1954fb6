"""Counting quotient filters over 64-bit fingerprints.

A fingerprint splits into a quotient (its leading ``Q`` bits, the home slot)
and a remainder (the other bits). The remainders of one quotient form a run in
ascending order, each followed by its count, so the whole filter is a sorted
sequence: merging two filters is merging sorted runs and adding the counts of
equal remainders. Nothing is lost, and the order of merges does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Q = 16
R = 64 - Q


@dataclass
class CountingQuotientFilter:
    occupied: np.ndarray    # quotients that have a run, ascending
    run_end: np.ndarray     # index past the last remainder of each run
    remainder: np.ndarray   # ascending inside a run
    count: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> "CountingQuotientFilter":
        fp, count = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls._from_sorted(fp, count.astype(np.int64))

    @classmethod
    def _from_sorted(cls, fp: np.ndarray, count: np.ndarray) -> "CountingQuotientFilter":
        quotient = (fp >> np.uint64(R)).astype(np.int64)
        occupied, first = np.unique(quotient, return_index=True)
        return cls(occupied, np.append(first[1:], len(fp)).astype(np.int64)[:len(occupied)],
                   fp & np.uint64((1 << R) - 1), count)

    def fingerprints(self) -> np.ndarray:
        runs = np.diff(self.run_end, prepend=0)
        return (np.repeat(self.occupied, runs).astype(np.uint64) << np.uint64(R)) | self.remainder

    @classmethod
    def merge(cls, filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        fp = np.concatenate([f.fingerprints() for f in filters] or [np.zeros(0, np.uint64)])
        count = np.concatenate([f.count for f in filters] or [np.zeros(0, np.int64)])
        order = np.argsort(fp, kind="stable")  # sorted runs: timsort merges them
        fp, count = fp[order], count[order]
        if not len(fp):
            return cls._from_sorted(fp, count)
        first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        return cls._from_sorted(fp[first], np.add.reduceat(count, first))

    def split(self, n: int):
        """Filters of ``n`` consecutive quotient ranges, as (range, filter)."""
        home = self.occupied * n >> Q
        for b in np.unique(home):
            lo, hi = np.searchsorted(home, [b, b + 1])
            a = 0 if lo == 0 else int(self.run_end[lo - 1])
            z = int(self.run_end[hi - 1])
            yield int(b), CountingQuotientFilter(
                self.occupied[lo:hi], self.run_end[lo:hi] - a, self.remainder[a:z], self.count[a:z])

    def to_bytes(self) -> bytes:
        head = np.array([len(self.occupied), len(self.remainder)], dtype="<i8")
        return b"".join([head.tobytes(), self.occupied.astype("<u2").tobytes(),
                         self.run_end.astype("<i8").tobytes(),
                         self.remainder.astype("<u8").tobytes(), self.count.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountingQuotientFilter":
        runs, n = np.frombuffer(data, "<i8", 2)
        at = 16
        out = []
        for kind, k in (("<u2", runs), ("<i8", runs), ("<u8", n), ("<i8", n)):
            out.append(np.frombuffer(data, kind, int(k), at))
            at += int(k) * int(kind[-1])
        return cls(out[0].astype(np.int64), out[1], out[2].astype(np.uint64), out[3])

    def counts(self, fingerprints: np.ndarray) -> np.ndarray:
        """Counts of the given fingerprints (0 where absent)."""
        own = self.fingerprints()
        fp = fingerprints.astype(np.uint64)
        if not len(own):
            return np.zeros(len(fp), np.int64)
        at = np.minimum(np.searchsorted(own, fp), len(own) - 1)
        return np.where(own[at] == fp, self.count[at], 0)
