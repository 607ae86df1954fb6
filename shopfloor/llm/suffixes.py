"""Sparse suffixes of byte texts and their order (numpy kernels).

Every WINDOW-byte string of a text has one anchor: of the TOKEN-byte grams
inside it, the one with the smallest hash (the first of equals). The choice
depends on the string alone, so equal strings have equal anchors at equal
offsets, and it is enough to order the suffixes that begin at anchors. A
segment is an anchor with the bytes of all windows it serves: up to LEFT bytes
before the anchor and up to WINDOW bytes from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from shopfloor.llm.tokens import _BYTE, _PRIME, mix64, powers

WINDOW = 50
TOKEN = 16
LEFT = WINDOW - TOKEN


@dataclass
class Segments:
    """``buf[start[i]:start[i] + size[i]]`` are the bytes of segment ``i``, ``left[i]``
    of them before its anchor; it serves ``size[i] - WINDOW + 1`` windows. Segments
    of one buffer overlap. Equal segments have equal ``hash``."""

    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray
    left: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.left)

    def tokens(self) -> np.ndarray:
        """Leading tokens of the anchors' suffixes, comparable as byte strings."""
        rows = np.lib.stride_tricks.sliding_window_view(self.buf, TOKEN) if len(self) else self.buf.reshape(0, TOKEN)
        return rows[self.start + self.left].view(f"S{TOKEN}").ravel()

    def bytes_of(self, which: np.ndarray) -> np.ndarray:
        """The bytes of some segments, one after another."""
        start, size = self.start[which], self.size[which]
        out = np.empty(int(size.sum()), np.uint8)
        at = ends(size)
        for lo in range(0, len(which), _SEGMENTS):  # index arrays stay small
            hi = lo + _SEGMENTS
            out[at[lo]:at[min(hi, len(which))]] = self.buf[flat(start[lo:hi], size[lo:hi])]
        return out

    @classmethod
    def concat(cls, parts: list["Segments"]) -> "Segments":
        base = ends(np.array([len(p.buf) for p in parts]))
        return cls(np.concatenate([p.buf for p in parts]),
                   np.concatenate([p.start + b for p, b in zip(parts, base)]),
                   *(np.concatenate([getattr(p, k) for p in parts]) for k in ("size", "left", "hash")))


def ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[i], ..., start[i] + size[i] - 1 of all i, one after another."""
    at = ends(size)
    return np.arange(at[-1]) + np.repeat(start - at[:-1], size)


_SEGMENTS = 1 << 12


_INVERSE = pow(int(_PRIME), -1, 1 << 64)
_UNDO = np.ones(1, dtype=np.uint64)


def _undo(n: int) -> np.ndarray:
    """Powers of the inverse of the hash's factor."""
    global _UNDO
    if n > len(_UNDO):
        p = np.full(n, _INVERSE, dtype=np.uint64)
        p[0] = 1
        _UNDO = np.multiply.accumulate(p)
    return _UNDO[:n]


def segments(texts: list[bytes]):
    """(segments, text index, offset of the first window in that text)."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = ends(np.array([len(t) for t in texts], np.int64))
    none = np.zeros(0, np.int64)
    nothing = Segments(buf, none, none, none, none.astype(np.uint64)), none, none
    if len(buf) < WINDOW:
        return nothing
    x = _BYTE[buf]
    h, width, factor = x, 1, int(_PRIME)
    while width < TOKEN:  # hashes of twice as many bytes
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    v = (mix64(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, reach = 1, LEFT + 1
    while 2 * width <= reach:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < reach:
        v = np.minimum(v[:width - reach], v[reach - width:])
    inside = np.ones(len(v), dtype=bool)  # windows that end in the text they start in
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        inside[max(lo, hi - WINDOW + 1):hi] = False
    pos = np.flatnonzero(inside)
    if not len(pos):
        return nothing
    anchor = (v[pos] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(first, len(pos))) + WINDOW - 1
    start, left = pos[first], anchor[first] - pos[first]
    # sums of byte * factor ** place up to each place, moved to place 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(len(x)))])
    own = (sums[start + size] - sums[start]) * _undo(len(x))[start]
    text = np.searchsorted(at, start, side="right") - 1
    return Segments(buf, start, size, left, mix64(own + (size * 64 + left).astype(np.uint64) * _PRIME)), text, start - at[text]


_BLOCK = 1 << 20


def same_bytes(s: Segments, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments ``a[i]`` and ``b[i]`` are equal, byte by byte."""
    out = (s.size[a] == s.size[b]) & (s.left[a] == s.left[b])
    todo = np.flatnonzero(out)
    part = np.cumsum(s.size[a[todo]]) // _BLOCK
    for i in np.split(todo, np.flatnonzero(np.diff(part)) + 1):
        if len(i):
            x = s.bytes_of(a[i]) != s.bytes_of(b[i])
            out[i] = ~np.logical_or.reduceat(x, ends(s.size[a[i]])[:-1])
    return out


# the first k of a word's eight bytes
_FIRST = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], dtype=np.uint64)


def words(buf: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, n: int) -> list[np.ndarray]:
    """``n`` eight-byte words of each string ``buf[start], buf[start + step], ...`` of
    ``size`` bytes, zeros after its end; step is 1 or -1."""
    pad = np.zeros(8 * n + 8, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, buf, pad]), 8)
    out = []
    for k in range(n):
        at = start + len(pad) + (8 * k if step > 0 else -8 * k - 7)
        w = rows[at].view(">u8" if step > 0 else "<u8").ravel().astype(np.uint64)
        out.append(w & _FIRST[np.clip(size - 8 * k, 0, 8)])
    return out


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over words: (order, common bytes with the predecessor).

    All rows are split by their first word; only rows equal so far are split by
    the next one. The first entry of the second result is -1.
    """
    n = len(keys[0])
    order = np.arange(n)
    head = np.zeros(n, dtype=bool)  # begins a group of rows equal so far
    head[:1] = True
    common = np.full(n, -1, dtype=np.int16)
    for k, key in enumerate(keys):
        group = np.cumsum(head)
        single = head & np.append(head[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            break
        sub = order[tied]
        order[tied] = sub[np.lexsort((key[sub], group[tied]))]
        w = key[order[tied]]
        at = tied[1:]
        new = (w[1:] != w[:-1]) & ~head[at]
        x = (w[1:] ^ w[:-1])[new]
        same = np.zeros(len(x), dtype=np.int16)
        for byte in range(1, 8):
            same += x < np.uint64(1 << (64 - 8 * byte))
        common[at[new]] = 8 * k + same
        head[at[new]] = True
    common[~head] = 8 * len(keys)
    return order, common


def earlier(s: Segments, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that some segment of a smaller owner has too: (segment, offset of
    the window in it), ascending.

    Suffixes from the anchors are ordered, and so are the prefixes before them,
    read backwards. A window of l bytes before its anchor equals another one if
    the suffixes share WINDOW - l bytes and the prefixes l; both are ranges of
    the two orders.
    """
    n = len(s)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    anchor = s.start + s.left
    r_order, r_common = multikey_order(words(s.buf, anchor, s.size - s.left, 1, -(-WINDOW // 8)))
    l_order, l_common = multikey_order(words(s.buf, anchor - 1, s.left, -1, -(-LEFT // 8)))

    def reach(order, common):
        out = np.empty(n, np.int16)
        out[order] = np.maximum(common, np.append(common[1:], np.int16(-1)))
        return out

    # a window of l bytes before its anchor: least <= l <= most
    r_reach, l_reach = reach(r_order, r_common), reach(l_order, l_common)
    least = np.maximum(s.left - (s.size - WINDOW), WINDOW - r_reach).astype(np.int16)
    most = np.minimum(s.left, l_reach).astype(np.int16)
    some = np.flatnonzero(least <= most)
    segs, offsets = [], []
    for l in range(LEFT + 1):  # noqa: E741
        c = some[(least[some] <= l) & (l <= most[some])]
        if len(c) < 2:
            continue
        offset = s.left - l
        rank = np.empty(n, np.int32)
        rank[r_order] = np.cumsum(r_common < WINDOW - l, dtype=np.int32)
        key = rank[c].astype(np.int64) * n
        rank[l_order] = np.cumsum(l_common < l, dtype=np.int32)
        key += rank[c]
        o = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[o]) != 0]))
        smallest = np.minimum.reduceat(owner[c[o]], first)
        later = np.empty(len(c), dtype=bool)
        later[o] = owner[c[o]] > np.repeat(smallest, np.diff(np.append(first, len(c))))
        segs.append(c[later])
        offsets.append(offset[c[later]])
    if not segs:
        return none, none
    seg, off = np.concatenate(segs), np.concatenate(offsets)
    o = np.lexsort((off, seg))
    return seg[o], off[o]


def merged(group: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Union of the intervals of each group (a small integer), touching ones joined:
    (group, start, stop), ascending."""
    if not len(group):
        return group, start, stop
    o = np.lexsort((start, group))
    group, start, stop = group[o], start[o], stop[o]
    # group offsets keep one running maximum of the ends inside its group
    span = int(stop.max()) + 2
    high = np.maximum.accumulate(stop + group * span)
    new = np.concatenate([[True], (start + group * span)[1:] > high[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], high[last] - group[first] * span
