"""Language-model scoring: a hierarchical Pitman-Yor bigram model.

Model. A word is drawn in the restaurant of its context, the word before it;
all context restaurants share one parent, the unigram restaurant, whose own
parent is uniform over the V training words and one unknown word. Contexts are
hashed to ``2 ** CONTEXT_BITS`` restaurants (a parameter of the model, like
the order): words of one hash class share a restaurant, and the probabilities
of every restaurant still sum to one.

Sampling. Seatings are sampled by Gibbs: a sweep re-seats the customers of
every dish given the tables of all restaurants after the sweep before, the
tables of the children are the customers of the parent, and the parent is then
re-seated given these. A step re-seats a whole dish: its number of tables is
drawn from the exact conditional distribution, whatever its number of customers
(see ``Seating``), so no step depends on how the dish was seated before and the
root needs no memory either. The first ``BURN_IN`` sweeps are dropped and the
predictive probabilities of the others are averaged. Discounts are estimated from
the counts, d = n1 / (n1 + 2 n2).

Execution. One shuffle deals all tokens (word, context, document) out by word;
its files serve every sweep and the scoring. Seatings are never stored: a task
replays its sweeps from its own tokens, with seeds fixed by bucket and sweep,
so a lost executor costs a recomputation and changes nothing. What tasks share
are sums per restaurant (vectors of fixed length, added up in a tree) and the
numbers of frequent words. Words of more than a quarter of a partition's share
(found on a sample; at most ``MAX_HOT``, only their place depends on it) are
dealt by context too, and pairs of two such words by document, so neither a
word nor a pair gathers in one task.

Defined cases: a null text counts as empty (its end is still a token); a null
doc_id reads as the empty text, whose crc32 is 0, so it is held out; rows that
repeat a doc_id are one document of several texts, whose numbers add up;
without training texts every word is unknown, N = V = 0 and the score is 0;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common
from shopfloor.llm.tokens import BLANK_SEPARATED, mix64, scan

CONTEXT_BITS = 18
STRENGTH = 1.0        # of a context restaurant
ROOT_STRENGTH = 50.0
SWEEPS, BURN_IN = 3, 1
TABLED = 64           # customers of a dish up to which Stirling numbers are tabled
SUMMED = 64           # tables up to which the distribution of a larger dish is summed
MAX_HOT = 256
SAMPLE = 1 / 16       # of the rows, to find frequent words
FLUSH_TOKENS = 1 << 20
SPLIT = 8             # buckets per partition
SEED = 1009
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
NO_ID = -(1 << 63)


# ---- tokens --------------------------------------------------------------

def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context word, text) of every token; each text ends in END."""
    w = scan(texts, BLANK_SEPARATED)
    n = np.diff(w.ptr) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    last = np.cumsum(n) - 1
    word = np.empty(len(doc), dtype=np.uint64)
    inner = np.ones(len(doc), dtype=bool)
    inner[last] = False
    word[inner], word[last] = w.ids, END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[last - n + 1] = START
    return word, before, doc


def context_class(before: np.ndarray) -> np.ndarray:
    return (mix64(before ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint32)


@dataclass
class Placement:
    """Where tokens go: frequent words (ascending), their context classes, the bucket count."""

    hot: np.ndarray
    buckets: int
    classes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.classes = np.unique(context_class(np.append(self.hot, START)))

    def hot_index(self, word: np.ndarray) -> np.ndarray:
        """Index among the frequent words, -1 for others."""
        if not len(self.hot):
            return np.full(len(word), -1, dtype=np.int16)
        at = np.searchsorted(self.hot, word)
        np.minimum(at, len(self.hot) - 1, out=at)
        at[self.hot[at] != word] = -1
        return at.astype(np.int16)

    def frequent_class(self, cls: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << CONTEXT_BITS, dtype=bool)
        table[self.classes] = True
        return table[cls]

    def place(self, word, cls, hot, doc_id) -> np.ndarray:
        spot = word.copy()
        h = np.flatnonzero(hot >= 0)
        if len(h):
            mixed = word[h] ^ (cls[h].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            both = self.frequent_class(cls[h])
            mixed[both] ^= mix64(doc_id[h][both].astype(np.int64).view(np.uint64) + np.uint64(1))
            spot[h] = mix64(mixed)
        return spot


def _pack(word, hot, cls, doc, ids, held) -> bytes:
    """A block: tokens in ascending order of their place (frequent words apart)."""
    docs, doc = np.unique(doc, return_inverse=True)
    order = np.argsort(hot >= 0, kind="stable")
    n_rare = int((hot < 0).sum())
    rare = word[order[:n_rare]]
    first = np.flatnonzero(np.concatenate([[True], rare[1:] != rare[:-1]])) if n_rare else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, n_rare))
    ids, held = ids[docs], held[docs]
    table = zlib.compress(np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes() + np.packbits(held).tobytes(), 1)
    small = len(docs) <= 1 << 16
    head = np.array([len(word), n_rare, len(first), len(docs), len(table), small], dtype="<i8")
    return b"".join([
        head.tobytes(), table, rare[first].astype("<u8").tobytes(), runs.astype("<u4").tobytes(),
        hot[order[n_rare:]].astype("<u2").tobytes(),
        cls[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(),
        doc[order].astype("<u2" if small else "<u4").tobytes()])


@dataclass
class Block:
    """A packed block's tokens: words as runs, then frequent ones by index; all but
    the documents are views of the packed bytes."""

    n: int
    first: np.ndarray   # the word of each run, ascending
    runs: np.ndarray
    hot: np.ndarray
    three: np.ndarray   # bytes of the context classes
    doc: np.ndarray
    ids: np.ndarray
    held: np.ndarray

    def classes(self) -> np.ndarray:
        t = self.three
        return t[:, 0].astype(np.int64) | t[:, 1].astype(np.int64) << 8 | t[:, 2].astype(np.int64) << 16


def _unpack(data: bytes) -> Block:
    n, n_rare, n_first, n_docs, n_table, small = (int(x) for x in np.frombuffer(data, "<i8", 6))
    at = 48
    table = zlib.decompress(data[at:at + n_table])
    at += n_table
    ids = np.cumsum(np.frombuffer(table, "<i8", n_docs))
    held = np.unpackbits(np.frombuffer(table, np.uint8, offset=8 * n_docs), count=n_docs).astype(bool)

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    first, runs = take("<u8", n_first), take("<u4", n_first)
    return Block(n, first, runs, take("<u2", n - n_rare), take(np.uint8, 3 * n).reshape(-1, 3),
                 take("<u2" if small else "<u4", n), ids, held)


def _blocks(place: Placement):
    """Arrow rows (doc_id, held, text) to rows (bucket, block)."""

    def flush(held_rows):
        word, cls, doc, ids, held = (np.concatenate(x) for x in zip(*held_rows))
        held_rows.clear()
        hot = place.hot_index(word)
        bucket = place.place(word, cls, hot, ids[doc])
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        bucket >>= np.uint64(32)
        bucket *= np.uint64(place.buckets)
        bucket >>= np.uint64(32)
        cuts = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
        of = bucket[cuts].astype(np.int32)
        del bucket
        ends = np.append(cuts[1:], len(order))
        for k in range(0, len(cuts), 256):
            blocks = [_pack(word[o], hot[o], cls[o], doc[o], ids, held)
                      for o in (order[a:z] for a, z in zip(cuts[k:k + 256], ends[k:k + 256]))]
            yield pa.RecordBatch.from_arrays([pa.array(of[k:k + 256]), pa.array(blocks, pa.binary())],
                                             ["bucket", "block"])

    def run(batches):
        held_rows, size, n_docs = [], 0, 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.array(b.column(1).to_pylist(), dtype=bool)
            texts = common.as_bytes(b.column(2))
            for lo, hi in common.chunks(texts):
                word, before, doc = tokens(texts[lo:hi])
                held_rows.append((word, context_class(before), doc + np.int32(n_docs), ids[lo:hi], held[lo:hi]))
                size += len(word)
                n_docs += hi - lo
                if size >= FLUSH_TOKENS:
                    yield from flush(held_rows)
                    held_rows, size, n_docs = [], 0, 0
        if held_rows:
            yield from flush(held_rows)

    return run


def frequent_words(docs: DataFrame, partitions: int) -> np.ndarray:
    """Words of more than a quarter of a partition's share of a sample's tokens."""

    def count(batches):
        for b in batches:
            texts = common.as_bytes(b.column(0))
            for lo, hi in common.chunks(texts):
                word, _, _ = tokens(texts[lo:hi])
                w, c = np.unique(word, return_counts=True)
                often = c * 16 * partitions >= len(word)  # a task's local share, leniently
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(w[often], 0).astype(np.uint64).view(np.int64)),
                     pa.array(np.append(c[often], 0)), pa.array(np.append(np.zeros(int(often.sum()), int), len(word)))],
                    ["w", "c", "total"])

    rows = (docs.sample(SAMPLE, seed=SEED).select("text").mapInArrow(common.lean(count), "w long, c long, total long")
            .groupBy("w").agg(F.sum("c").alias("c"), F.sum("total").alias("total")))
    total = rows.agg(F.sum("total")).first()[0] or 0
    top = (rows.where(F.col("c") * (4 * partitions) >= total).where("c > 0")
           .orderBy(F.desc("c"), "w").limit(MAX_HOT).collect())
    return np.sort(np.array([r.w for r in top], dtype=np.int64).view(np.uint64))


# ---- seating -------------------------------------------------------------

_MATRIX = 1 << 18  # cells of a block of distributions


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Elementwise, for positive numbers."""
    up = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):  # Stirling's series from 8 on
        small = x < 8
        up[small] -= np.log(x[small])
        x[small] += 1
    z = 1 / (x * x)
    return up + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x


def _stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t) for c, t up to TABLED."""
    out = np.full((TABLED + 1, TABLED + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(TABLED + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, TABLED):
            stay = np.where(t <= c, out[c] + np.log(np.maximum(c - d * t, 0)), -np.inf)
            out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


_TABLES: dict[float, np.ndarray] = {}


def _drawn(log_w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column of each row, with probability proportional to exp(log_w)."""
    w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
    upto = np.cumsum(w, axis=1)
    return np.minimum((upto < (u * upto[:, -1])[:, None]).sum(axis=1), log_w.shape[1] - 1)


def _tilted(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables by the tilted compound Poisson form of
    the Gibbs partition: the tilt 1 - u solves a (1 - u) u^(d - 1) = c."""
    lo, hi = np.full(len(c), -700.0), np.full(len(c), -1e-13)
    want = np.log(c) - np.log(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = np.log(-np.expm1(mid)) + (d - 1) * mid > want
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    u = np.exp(lo)
    mean = a / d * (1 - u ** d)
    return mean, np.maximum(mean - c * u / (u + (1 - u) * (1 - d)), 0), u


def _many(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of more than TABLED customers. P(t) is proportional to
    (a / d)^t / t! times the coefficient of x^c in (1 - (1 - x)^d)^t, a finite sum of
    t terms, summed where at most SUMMED tables are likely; beyond, the number is
    drawn from the normal limit (its mean is right to a fifth of its deviation)."""
    mean, var, u = _tilted(c.astype(float), a, d)
    sd = np.sqrt(var)
    # one customer group beyond the tilt takes the rest while u is small
    t = np.clip(np.rint(mean + (1 - u) ** 2 + sd * rng.standard_normal(len(c))), 1, c).astype(np.int64)
    draws = rng.random(len(c))
    few = np.flatnonzero(mean + 2 + 8 * np.sqrt(var + 1) <= SUMMED)
    k = np.arange(1, SUMMED + 1)
    fact = np.concatenate([[0.0], np.cumsum(np.log(k))])
    choose = np.where(k[None, :] <= k[:, None], fact[k][:, None] - fact[k][None, :] - fact[np.maximum(k[:, None] - k[None, :], 0)], -np.inf)
    signed = np.where(k % 2, 1.0, -1.0) * np.sin(np.pi * d * k)
    for part in np.array_split(few, max(1, -(-len(few) * SUMMED // _MATRIX))):
        if not len(part):
            continue
        kinds, at = np.unique(c[part], return_inverse=True)
        x = kinds.astype(float)[:, None]
        g = signed * np.exp(_log_gamma((d * k + 1.0))[None, :] + _log_gamma(x - d * k) - _log_gamma(x + 1) + np.log(x))
        with np.errstate(divide="ignore"):
            coefficient = np.log(np.maximum(g @ np.exp(choose).T, 0))[at]
        t[part] = 1 + _drawn(k * np.log(a[part] / d)[:, None] - fact[k] + coefficient, draws[part])
    return t


class Seating:
    """Customers of many dishes at tables, a dish's tables apart from others'.

    ``c``: customers per dish, ``t``: its tables. Given the weight a of a new table,
    a seating of a dish with t tables has a probability proportional to a^t times the
    product of its tables' (1 - d)(2 - d)...(size - 1 - d); summed over seatings that is
    a^t S_d(c, t). A Gibbs step re-seats all customers of a dish at once: it draws t
    from that distribution, whatever c is (which customer sits where matters to
    nothing else).
    """

    def __init__(self, c: np.ndarray):
        self.c = c = np.asarray(c, dtype=np.int64)
        self.t = np.minimum(c, 1)
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(2, TABLED + 2))
        self.groups = [(k, order[a:z]) for k, a, z in zip(range(2, TABLED + 1), cuts, cuts[1:]) if z > a]
        self.many = order[cuts[-1]:]

    def sweep(self, a: np.ndarray, d: float, rng: np.random.Generator) -> None:
        """Re-seat every dish once; ``a``: weight of a new table per dish."""
        if d not in _TABLES:
            _TABLES.clear()
            _TABLES[d] = _stirling(d)
        log_s, log_a = _TABLES[d], np.log(a)  # draws go to dishes of two customers or more
        for k, dishes in self.groups:
            t = np.arange(1, k + 1)
            for lo in range(0, len(dishes), max(1, _MATRIX // k)):
                o = dishes[lo:lo + max(1, _MATRIX // k)]
                self.t[o] = 1 + _drawn(log_s[k, 1:k + 1] + t * log_a[o][:, None], rng.random(len(o)))
        if len(self.many):
            self.t[self.many] = _many(self.c[self.many], a[self.many], d, rng)


# ---- shared numbers ------------------------------------------------------

@dataclass
class Shared:
    """What every task needs: corpus totals and, per sweep (0: before any), the
    tables of each context class and of the root, and of frequent words."""

    place: Placement
    n: int = 0
    v: int = 0
    d: float = 0.5
    d0: float = 0.5
    customers: np.ndarray = None            # per context class
    hot_count: np.ndarray = None            # training tokens of each frequent word
    pair_keys: np.ndarray = None            # frequent word * classes + class, ascending
    pair_count: np.ndarray = None
    tables: list = field(default_factory=list)       # per sweep: tables per class
    root: list = field(default_factory=list)         # per sweep: (customers, tables) of the root
    hot_customers: list = field(default_factory=list)  # per sweep: root customers of frequent words
    hot_tables: list = field(default_factory=list)     # ... and their root tables
    pair_tables: list = field(default_factory=list)    # tables of pairs of frequent words

    def parent(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's probability of words with so many root customers and tables."""
        total, all_tables = self.root[sweep]
        rest = (ROOT_STRENGTH + self.d0 * all_tables) / (self.v + 1)
        return (np.maximum(customers - self.d0 * tables, 0) + rest) / (ROOT_STRENGTH + total)

    def new_table(self, sweep: int, cls: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.d * self.tables[sweep][cls]) * parent

    def root_weight(self, sweep: int) -> float:
        return (ROOT_STRENGTH + self.d0 * self.root[sweep][1]) / (self.v + 1)

    def pair_index(self, hot: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Index of (frequent word, class) among counted pairs, -1 if uncounted."""
        if not len(self.pair_keys):
            return np.full(len(hot), -1)
        key = hot.astype(np.int64) << CONTEXT_BITS | cls
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, at, -1)


def _distinct(key: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the index of each key among them (np.unique, whose
    inverse takes twice the memory)."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    distinct = ranked[new]
    del ranked
    at = np.empty(len(key), kind)
    at[order] = np.cumsum(new, dtype=kind) - kind(1)
    return distinct, at


class Bucket:
    """The tokens of one bucket, as distinct (word, class) pairs."""

    def __init__(self, blocks: list[bytes], place: Placement):
        got = [_unpack(x) for x in blocks]
        n = sum(g.n for g in got)
        small = np.int32 if n < 1 << 31 else np.int64
        self.doc_ids, where = np.unique(np.concatenate([g.ids for g in got]), return_inverse=True)
        present = np.flatnonzero(sum(np.bincount(g.hot, minlength=len(place.hot)) for g in got))
        self.words = np.unique(np.concatenate([place.hot[present], *(g.first for g in got)]))
        hot_at = np.searchsorted(self.words, place.hot)
        # Arrays of all tokens are what a worker's memory goes to: few at a time, and small.
        key, self.doc, train = np.empty(n, np.int64), np.empty(n, small), np.empty(n, bool)
        at = docs = 0
        for g in got:
            own = slice(at, at + g.n)
            key[own] = np.concatenate([np.repeat(np.searchsorted(self.words, g.first), g.runs), hot_at[g.hot]])
            key[own] <<= CONTEXT_BITS  # pairs in the order of (word, class): the key sorts by word first
            key[own] |= g.classes()
            self.doc[own] = where[docs:docs + len(g.ids)][g.doc]
            train[own] = ~g.held[g.doc]
            at, docs = at + g.n, docs + len(g.ids)
        del got, where
        pairs, self.pair = _distinct(key, small)
        del key
        self.word = pairs >> CONTEXT_BITS
        self.cls = pairs & ((1 << CONTEXT_BITS) - 1)
        self.count = np.bincount(self.pair[train], minlength=len(pairs))
        self.hot = place.hot_index(self.words)
        pair_hot = self.hot[self.word]
        self.spread = (pair_hot >= 0) & place.frequent_class(self.cls)  # dealt by document
        self.pair_hot = pair_hot
        self.own = ~self.spread

    def stats(self, place: Placement) -> list[np.ndarray]:
        """Sums of the counting job, see ``_count``."""
        c, k = self.count, 1 << CONTEXT_BITS
        seen = self.own & (c > 0)
        h = len(place.hot)
        rare = self.hot < 0
        by_word = np.bincount(self.word, weights=c, minlength=len(self.words))
        kinds = np.bincount(self.word[seen], minlength=len(self.words))
        hot_words = np.flatnonzero(~rare)
        hot_count, hot_kinds = np.zeros(h, np.int64), np.zeros(h, np.int64)
        hot_count[self.hot[hot_words]] = by_word[hot_words]
        hot_kinds[self.hot[hot_words]] = kinds[hot_words]
        pair_count = np.zeros((h, len(place.classes)), np.int64)
        s = np.flatnonzero(self.spread)
        pair_count[self.pair_hot[s], np.searchsorted(place.classes, self.cls[s])] = c[s]
        own = c[self.own]
        rare_kinds = kinds[rare]
        return [np.array([c.sum(), (by_word[rare] > 0).sum(), (own == 1).sum(), (own == 2).sum(),
                          (rare_kinds == 1).sum(), (rare_kinds == 2).sum()]),
                np.bincount(self.cls, weights=c, minlength=k).astype(np.int64),
                np.bincount(self.cls[seen], minlength=k), hot_count, hot_kinds, pair_count]

    def replay(self, shared: Shared, sweeps: int, bucket: int):
        """Yields, after each sweep from 0 (before any), the tables per pair, and
        root customers and tables per word."""
        own = np.flatnonzero(self.own & (self.count > 0))
        seating = Seating(self.count[own])
        tables = np.zeros(len(self.count))
        rare = np.flatnonzero(self.hot < 0)
        hot = np.flatnonzero(self.hot >= 0)
        pair = shared.pair_index(self.pair_hot, self.cls)
        spread = np.flatnonzero(self.spread & (pair >= 0))
        customers, root = np.zeros(len(self.words)), np.zeros(len(self.words))
        for s in range(sweeps + 1):
            rng = np.random.default_rng([SEED, s, bucket])
            if s:
                parent = shared.parent(s - 1, customers, root)
                a = shared.new_table(s - 1, self.cls[own], parent[self.word[own]])
                seating.sweep(a, shared.d, rng)
            tables[own] = seating.t
            tables[spread] = shared.pair_tables[s][pair[spread]] if s < len(shared.pair_tables) else 0
            customers = np.bincount(self.word[own], weights=seating.t, minlength=len(self.words))
            parents = Seating(customers[rare].astype(np.int64))
            if s:
                parents.sweep(np.full(len(rare), shared.root_weight(s - 1)), shared.d0, rng)
            root = np.zeros(len(self.words))
            root[rare] = parents.t
            yield tables, customers, root
            if len(hot) and s < len(shared.hot_customers):
                customers[hot] = shared.hot_customers[s][self.hot[hot]]
                root[hot] = shared.hot_tables[s][self.hot[hot]]

    def sums(self, shared: Shared, sweep: int, bucket: int) -> list[np.ndarray]:
        """Sums of a sweep: tables per class, (root customers, tables) of rare
        words, root customers of frequent words (own pairs only)."""
        for tables, customers, root in self.replay(shared, sweep, bucket):
            pass
        h = np.zeros(len(shared.place.hot))
        rare = self.hot < 0
        h[self.hot[~rare]] = customers[~rare]
        own = np.flatnonzero(self.own)
        return [np.bincount(self.cls[own], weights=tables[own], minlength=1 << CONTEXT_BITS),
                np.array([customers[rare].sum(), root[rare].sum()]), h]

    def scores(self, shared: Shared, bucket: int):
        """(doc_id, tokens, known, base, score) of this bucket's tokens."""
        total = np.zeros(len(self.count))
        count = self.count.astype(float)
        pair = shared.pair_index(self.pair_hot, self.cls)
        s = np.flatnonzero(self.spread)
        count[s] = np.where(pair[s] >= 0, shared.pair_count[pair[s]] if len(shared.pair_count) else 0, 0)
        used = 0
        hot = np.flatnonzero(self.hot >= 0)
        for k, (tables, customers, root) in enumerate(self.replay(shared, SWEEPS, bucket)):
            if k <= BURN_IN:
                continue
            customers, root = customers.copy(), root.copy()
            customers[hot] = shared.hot_customers[k][self.hot[hot]]
            root[hot] = shared.hot_tables[k][self.hot[hot]]
            parent = shared.parent(k, customers, root)[self.word]
            total += ((np.maximum(count - shared.d * tables, 0) + shared.new_table(k, self.cls, parent))
                      / (STRENGTH + shared.customers[self.cls]))
            used += 1
        log_p = np.log10(total / used)
        known = np.bincount(self.word[self.own], weights=self.count[self.own], minlength=len(self.words))
        known[hot] = shared.hot_count[self.hot[hot]]
        base = np.log10((known + 0.1) / (shared.n + 0.1 * (shared.v + 1)))
        n = len(self.doc_ids)
        per_pair = ((known > 0)[self.word], base[self.word], log_p)
        return (self.doc_ids, np.bincount(self.doc, minlength=n),
                *(np.bincount(self.doc, weights=x[self.pair], minlength=n) for x in per_pair))


def _by_bucket(rows):
    held: dict[int, list[bytes]] = {}
    for r in rows:
        held.setdefault(r[0], []).append(bytes(r[1]))
    for b in sorted(held):
        yield b, held.pop(b)


def _add(x, y):
    return [a + b for a, b in zip(x, y)]


def _sum(tokens_rdd, one):
    """Vectors of all buckets, added within tasks and then in a tree."""

    def per_task(rows):
        total = None
        for b, blocks in _by_bucket(rows):
            v = one(b, blocks)
            total = v if total is None else _add(total, v)
        if total is not None:
            yield total

    summed = tokens_rdd.mapPartitions(common.lean(per_task))
    return summed.treeReduce(_add, depth=4)  # a few vectors reach the driver, whatever the partitions


class HpyLanguageModel:
    """Fits on the training rows of ``docs(doc_id, text)`` and scores all rows."""

    def __init__(self, docs: DataFrame):
        spark = self.spark = docs.sparkSession
        parts = common.parts(spark)
        held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
        d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        held.alias("held"), common.text_or_empty().alias("text"))
        self.place = Placement(frequent_words(d, parts), SPLIT * parts)
        # The RDD keeps the files of this one shuffle for every sweep.
        self.tokens = (d.mapInArrow(common.lean(_blocks(self.place)), "bucket int, block binary")
                       .repartition(parts, "bucket").rdd)
        self.shared = self._fit()

    def _sweep_sums(self, shared: Shared, sweep: int):
        spread = self.spark.sparkContext.broadcast(shared)
        return _sum(self.tokens, lambda b, x: Bucket(x, spread.value.place).sums(spread.value, sweep, b))

    def _fit(self) -> Shared:
        place = self.place
        spread = self.spark.sparkContext.broadcast(place)
        if self.tokens.isEmpty():
            return None
        totals, customers, kinds, hot_count, hot_kinds, pairs = _sum(
            self.tokens, lambda b, x: Bucket(x, spread.value).stats(spread.value))
        hot, at = np.nonzero(pairs)
        pair_count = pairs[hot, at]
        pair_cls = place.classes[at].astype(np.int64)
        kinds = kinds + np.bincount(pair_cls, minlength=1 << CONTEXT_BITS)
        hot_kinds = hot_kinds + np.bincount(hot, minlength=len(place.hot)).astype(np.int64)
        discount = lambda n1, n2: float(np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.05, 0.95))
        s = Shared(place, int(totals[0]), int(totals[1] + (hot_count > 0).sum()),
                   discount(totals[2] + (pair_count == 1).sum(), totals[3] + (pair_count == 2).sum()),
                   discount(totals[4], totals[5]), customers, hot_count,
                   hot.astype(np.int64) << CONTEXT_BITS | pair_cls, pair_count)
        # Before any sweep: one table per kind of customer, one root table per word.
        s.tables.append(kinds.astype(float))
        s.root.append((float(kinds.sum()), float(s.v)))
        s.hot_customers.append(hot_kinds.astype(float))
        s.hot_tables.append((hot_count > 0).astype(float))
        s.pair_tables.append(np.ones(len(pair_count)))
        seating = Seating(pair_count)
        for k in range(1, SWEEPS + 1):
            rng = np.random.default_rng([SEED, k, place.buckets])  # no bucket has this number
            parent = s.parent(k - 1, s.hot_customers[-1], s.hot_tables[-1])
            seating.sweep(s.new_table(k - 1, pair_cls, parent[hot]), s.d, rng)
            s.pair_tables.append(seating.t.copy())
            tables, root, hot_customers = self._sweep_sums(s, k)
            tables = tables + np.bincount(pair_cls, weights=seating.t, minlength=1 << CONTEXT_BITS)
            hot_customers = hot_customers + np.bincount(hot, weights=seating.t, minlength=len(place.hot))
            parents = Seating(hot_customers.astype(np.int64))
            parents.sweep(np.full(len(place.hot), s.root_weight(k - 1)), s.d0, rng)
            s.tables.append(tables)
            s.root.append((float(root[0] + hot_customers.sum()), float(root[1] + parents.t.sum())))
            s.hot_customers.append(hot_customers)
            s.hot_tables.append(parents.t.astype(float))
        return s

    def score(self) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score of every document."""
        out = "doc_id long, n_tokens long, n_known long, base_score double, score double"
        if self.shared is None:
            return self.spark.createDataFrame([], out)
        spread = self.spark.sparkContext.broadcast(self.shared)

        parts = common.parts(self.spark)
        ranges = SPLIT * parts

        def per_task(rows):
            """Sums per document of this task's tokens, packed by range of documents."""
            held = [[], [], [], [], []]
            for b, blocks in _by_bucket(rows):
                for h, x in zip(held, Bucket(blocks, spread.value.place).scores(spread.value, b)):
                    h.append(x)
            if held[0]:
                whole = []
                for h in held:
                    whole.append(np.concatenate(h))
                    h.clear()
                ids, *sums = _by_document(*whole)
                del whole
                to = (mix64(ids.view(np.uint64)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order].astype(np.int64), prepend=-1))
                for a, z in zip(cuts, np.append(cuts[1:], len(order))):
                    o = order[a:z]
                    yield int(to[o[0]]), b"".join(x[o].astype(k).tobytes() for x, k in zip((ids, *sums), _SUMS))

        def unpack(batches):
            held: dict[int, list] = {}
            for b in batches:
                for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n = len(data) // 40
                    held.setdefault(r, []).append([np.frombuffer(data, k, n, 8 * n * i) for i, k in enumerate(_SUMS)])
            for r in list(held):
                ids, tokens_, known, base, score = _by_document(*(np.concatenate(x) for x in zip(*held.pop(r))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), *(pa.array(np.rint(x).astype(np.int64)) for x in (tokens_, known)),
                     pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        packed = self.spark.createDataFrame(self.tokens.mapPartitions(common.lean(per_task)), "range int, data binary")
        return packed.repartition(parts, "range").mapInArrow(common.lean(unpack), out)


_SUMS = ("<i8", "<f8", "<f8", "<f8", "<f8")


def _by_document(ids, *sums):
    own, at = np.unique(ids, return_inverse=True)
    return own, *(np.bincount(at, weights=x, minlength=len(own)) for x in sums)


def op1_hpylm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = HpyLanguageModel(common.table(spark, sf_dir, "documents"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return (model.score().withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
            .select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                    F.lit(model.shared.n if model.shared else 0).cast("long").alias("train_tokens"),
                    "base_score", "score"))
