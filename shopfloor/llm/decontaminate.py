"""Benchmark decontamination: a prefix-filtered set join.

A benchmark item is the set of its windows of ``WINDOW`` consecutive words (an
item of fewer words is one window). A window is the set of its positioned
``SHINGLE``-word shingles; a document contains the window only if it holds all
of them, so the necessary prefix is one shingle: the rarest. Rarity is the
document frequency of the benchmark's shingles over all documents. Documents
join the prefix shingles, a candidate must fit between the document's first
and last word at the shingle's offset (positional and length bounds), and
survivors are verified word by word on their bytes.

The benchmark is the stated query set: it is taken in blocks of bounded size
(``BLOCK_BYTES``), each broadcast to one pass over all documents.

Defined cases: null texts have no words; documents and items without words
hit nothing; repeated item rows of one item_id are one item and a null item_id
reads as the empty string; every document row gives one row, repeated or not;
an empty benchmark contaminates nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common
from shopfloor.llm.tokens import ALPHANUMERIC, Words, ngram_ids, scan

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20
_SLOTS = 1 << 18  # of the presence table that screens shingles before the search


def _shingles(ids: np.ndarray, n_words: int) -> np.ndarray:
    return ngram_ids(ids, SHINGLE) if n_words >= SHINGLE else ids


class Block:
    """The windows of some benchmark items, with an index by prefix shingle."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names = [i for i, _ in items]
        w = scan([t for _, t in items], ALPHANUMERIC)
        self.ids = w.ids
        self.words = [w.buf[a:z].tobytes() for a, z in zip(w.start, w.end)]
        win = [(i, a + s, min(WINDOW, n)) for i in range(len(items))
               for a, n in [(int(w.ptr[i]), int(w.ptr[i + 1] - w.ptr[i]))] if n
               for s in range(max(1, n - WINDOW + 1))]
        self.item, self.at, self.size = (np.array(x, dtype=np.int64) for x in zip(*win)) if win else (
            np.zeros(0, np.int64),) * 3
        per = [_shingles(self.ids[a:a + k], k) for a, k in zip(self.at, self.size)]
        self.vocabulary = np.unique(np.concatenate(per)) if per else np.zeros(0, np.uint64)
        self._per = per

    def choose_prefixes(self, frequency: np.ndarray) -> None:
        """The rarest shingle of each window; ties go to the smaller id, then offset."""
        key, offset = [], []
        for s in self._per:
            f = frequency[np.searchsorted(self.vocabulary, s)]
            j = int(np.lexsort((s, f))[0])
            key.append(s[j])
            offset.append(j)
        order = np.argsort(np.array(key, dtype=np.uint64), kind="stable")
        self.window = order
        self.offset = np.array(offset, dtype=np.int64)[order]
        self.prefix, self.first = np.unique(np.array(key, dtype=np.uint64)[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.present = present(self.prefix)
        del self._per

    def __len__(self) -> int:
        return len(self.item)


def present(keys: np.ndarray) -> np.ndarray:
    t = np.zeros(_SLOTS, dtype=bool)
    t[(keys & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    return t


def find(ids: np.ndarray, keys: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``ids`` that are in sorted ``keys``, and their indexes there."""
    pos = np.flatnonzero(screen[(ids & np.uint64(_SLOTS - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, ids[pos]), max(len(keys) - 1, 0))
    ok = keys[at] == ids[pos] if len(keys) else np.zeros(len(pos), bool)
    return pos[ok], at[ok]


def occurrences(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, window) of every occurrence of a window in the texts."""
    doc = w.doc()
    found = []
    short = np.any(block.size < SHINGLE)
    for ids, narrow in ((ngram_ids(w.ids, SHINGLE), False), (w.ids, True)):
        if narrow and not short:
            continue
        pos, key = find(ids, block.prefix, block.present)
        n = block.last[key] - block.first[key]
        if not n.sum():
            continue
        entry = np.repeat(block.first[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        win = block.window[entry]
        begin = np.repeat(pos, n) - block.offset[entry]
        size = block.size[win]
        d = doc[np.repeat(pos, n)]
        ok = ((size < SHINGLE) == narrow) & (begin >= w.ptr[d]) & (begin + size <= w.ptr[d + 1])
        begin, win, size, d = begin[ok], win[ok], size[ok], d[ok]
        for k in range(WINDOW):
            inside = k < size
            same = w.ids[np.where(inside, begin + k, 0)] == block.ids[np.where(inside, block.at[win] + k, 0)]
            ok = same | ~inside
            begin, win, size, d = begin[ok], win[ok], size[ok], d[ok]
        found.append((d, begin, win))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    d, begin, win = (np.concatenate(x) for x in zip(*found))
    exact = np.fromiter((all(w.buf[w.start[b + k]:w.end[b + k]].tobytes() == block.words[a + k] for k in range(n))
                         for b, a, n in zip(begin, block.at[win], block.size[win])), dtype=bool, count=len(begin))
    return d[exact], begin[exact], win[exact]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                            common.text_or_empty().alias("t")).orderBy("i", "t")
    for i, t in rows.toLocalIterator():
        held.append((i, t.encode()))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequencies(docs: DataFrame, block: Block) -> np.ndarray:
    """Document frequency over all documents of the block's shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, present(block.vocabulary),
                                                       bool(np.any(block.size < SHINGLE))))

    def count(batches):
        keys, screen, short = shared.value
        total = np.zeros(len(keys), dtype=np.int64)
        for b in batches:
            texts = common.as_bytes(b.column(0))
            for lo, hi in common.chunks(texts):
                w = scan(texts[lo:hi], ALPHANUMERIC)
                doc = w.doc()
                for ids in (ngram_ids(w.ids, SHINGLE), w.ids) if short else (ngram_ids(w.ids, SHINGLE),):
                    pos, key = find(ids, keys, screen)
                    total += np.bincount(np.unique(doc[pos] * len(keys) + key) % max(len(keys), 1),
                                         minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "n"])

    rows = docs.select("text").mapInArrow(common.lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(len(block.vocabulary), dtype=np.int64)
    for k, n in rows.toLocalIterator():  # at most the block's shingles
        out[k] = n
    return out


_STATE = "doc_id long, text string, hits binary, items array<string>, text_hash long"


def _probe(docs: DataFrame, block: Block):
    """A function of batches that adds the block's hits: a bitmap of hit words and the
    items found."""
    block.choose_prefixes(_frequencies(docs, block))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        blk = shared.value
        for b in batches:
            texts = common.as_bytes(b.column(1))
            hits, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in common.chunks(texts):
                w = scan(texts[lo:hi], ALPHANUMERIC)
                d, begin, win = occurrences(w, blk)
                edge = np.zeros(len(w.ids) + 1, dtype=np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + blk.size[win], -1)
                hit = np.cumsum(edge[:-1]) > 0
                for i in np.unique(d):
                    own = hit[w.ptr[i]:w.ptr[i + 1]]
                    if hits[lo + i]:
                        own = own | np.unpackbits(np.frombuffer(hits[lo + i], np.uint8), count=len(own)).astype(bool)
                    hits[lo + i] = np.packbits(own).tobytes()
                for i, k in {(int(i), int(k)) for i, k in zip(d, blk.item[win])}:
                    items[lo + i] = [*items[lo + i], blk.names[k]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())),
                 b.column(4)], ["doc_id", "text", "hits", "items", "text_hash"])

    return run


def _digest(batches):
    for b in batches:
        texts = common.as_bytes(b.column(1))
        n_words: list[int] = []
        for lo, hi in common.chunks(texts):
            n_words += np.diff(scan(texts[lo:hi], ALPHANUMERIC).ptr).tolist()
        n_hit = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in b.column(2).to_pylist()]
        items = [sorted(set(x)) for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array(items, pa.list_(pa.string())),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
             b.column(4)], ["doc_id", "n_words", "n_hit", "items", "items_sha256", "text_hash"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids of the items with
    an occurring window, sorted), items_sha256, text_hash."""
    d = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"),
                    F.lit(None).cast("binary").alias("hits"),
                    F.array().cast("array<string>").alias("items"),
                    common.text_hash(F.col("text")).alias("text_hash"))
    probe = None  # of the last block so far
    for items in _blocks(benchmark):
        block = Block(items)
        if not len(block):
            continue
        if probe:  # one block's worker at a time; the texts travel with their hits
            d = common.written(d.mapInArrow(common.lean(probe), _STATE), "decontaminate")
        probe = _probe(d, block)

    def run(batches):  # one worker a task for the last block and the digest
        return _digest(probe(batches) if probe else batches)

    return d.mapInArrow(common.lean(run), "doc_id long, n_words long, n_hit long, items array<string>, "
                                          "items_sha256 string, text_hash long")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without any benchmark window."""
    return common.without_rows(docs, decontaminate(docs, benchmark).where("n_hit > 0").select("doc_id", "text_hash"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, 10 AS k, array_to_string(list_slice(w, s, s + 9), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS s FROM i WHERE len(w) >= 10)
  UNION SELECT item_id, len(w) AS k, array_to_string(w, ' ') AS g FROM i WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT k FROM iw),
dg AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, dg.k, item_id FROM dg JOIN iw ON dg.k = iw.k AND dg.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
