"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word (a run of non-blank bytes, A-Z lower-cased) is the bag of its character
n-grams, word edges included, so a misspelling shares most of its vectors with
the word. The n-grams hash into a table of embeddings; a text is the average
of its n-gram vectors; a softmax over two classes scores it. Embeddings and
softmax are trained jointly in numpy by gradient descent.

Training takes a bounded sample, ``TRAIN_ROWS`` labelled rows (the smallest by
a hash of the text's id, so the sample is the same wherever rows lie), the
only limit here: every text is scored whole. The fitted model is a vector of
``2 ** TABLE_BITS`` numbers (the softmax is linear, so a text's logit is the
average of its n-grams' logits), broadcast as half a megabyte.

Defined cases: a null text counts as empty; a text without words has the score
of the bias alone; rows whose label is null are not learned from; a repeated
doc_id in the labels counts each row; without both classes in the sample the
score is the sample's share of label 1 (0.5 if there is no sample); repeated
documents are scored alike; a null doc_id is held out and its label not learned
from; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common
from shopfloor.llm.tokens import BLANK_SEPARATED, _BYTE, mix64, powers, scan

TRAIN_ROWS = 5000    # whose bags the driver holds, about 20 kB each
TABLE_BITS = 17
DIMENSIONS = 8
NGRAMS = (3, 5, 7)  # in bytes
MIN_TEXTS = 5        # an n-gram of fewer sample texts has the zero vector
EPOCHS = 8
RATE = 800.0         # of the embeddings, whose gradients carry a factor 1 / n-grams
SOFT_RATE = 0.02
TOXIC_WEIGHT = 1.0   # of label 1 rows in the loss
_SPACE = 32


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all n-grams of the texts, and each one's text."""
    w = scan(texts, BLANK_SEPARATED)
    size = w.end - w.start
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Each word's bytes and one blank; a blank also begins the sequence.
    total = int(size.sum()) + len(size) + 1
    b = np.full(total, _SPACE, dtype=np.uint8)
    at = np.concatenate([[1], 1 + np.cumsum(size + 1)])[:-1]
    inside = np.ones(total, dtype=bool)
    inside[0] = False
    inside[at + size] = False
    b[inside] = w.buf[BLANK_SEPARATED[w.buf]]
    doc = np.zeros(total, dtype=np.int64)
    doc[1:] = np.repeat(w.doc(), size + 1)
    doc[0] = doc[1]
    x = _BYTE[b]
    p = powers(max(NGRAMS))
    blank = b == _SPACE
    slots, owner = [], []
    h = x.copy()
    clean = np.ones(total, dtype=bool)  # no blank strictly inside the n-gram
    for n in range(2, max(NGRAMS) + 1):
        m = total - n + 1
        if m <= 0:
            break
        h = h[:m] + x[n - 1:] * p[n - 1]
        if n > 2:
            clean = clean[:m] & ~blank[n - 2:total - 1]
        else:
            clean = clean[:m]
        if n in NGRAMS:
            # the owner is the text of the n-gram's second byte: its first may be the blank before
            keep = np.flatnonzero(clean)
            slots.append((mix64(h[keep] + np.uint64(n)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
            owner.append(doc[keep + 1])
    return (np.concatenate(slots), np.concatenate(owner)) if slots else (np.zeros(0, np.int64),) * 2


class Model:
    """``logit`` of each table slot and the ``bias``; picklable and small."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit.astype(np.float32), float(bias)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in common.chunks(texts):
            slots, owner = subwords(texts[lo:hi])
            n = np.bincount(owner, minlength=hi - lo)
            s = np.bincount(owner, weights=self.logit[slots], minlength=hi - lo)
            out[lo:hi] = s / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


class _Bags:
    """Bags of texts in blocks (large arrays go back to the system when freed)."""

    def __init__(self, texts: Iterable[bytes], size: int):
        self.spread = np.zeros(size, dtype=np.int64)  # texts of each n-gram
        self.blocks: list[list] = []
        held: list[tuple] = []
        for t in texts:
            slots, _ = subwords([t])
            u, c = np.unique(slots, return_counts=True)
            self.spread[u] += 1
            held.append((u.astype(np.int32), (c / max(len(slots), 1)).astype(np.float32)))
            if len(held) == 256:
                self._keep(held)
                held = []
        self._keep(held)

    def _keep(self, held: list[tuple]) -> None:
        if held:
            at = np.concatenate([[0], np.cumsum([len(u) for u, _ in held])])
            self.blocks.append([at, np.concatenate([u for u, _ in held]), np.concatenate([c for _, c in held])])

    def only(self, wanted: np.ndarray) -> None:
        """Drop the other n-grams from all bags."""
        for b in self.blocks:
            at, u, c = b
            ok = wanted[u]
            b[:] = [np.concatenate([[0], np.cumsum(ok)])[at], u[ok], c[ok]]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, u, c = self.blocks[i >> 8]
        a, z = at[i & 255], at[(i & 255) + 1]
        return u[a:z], c[a:z]


def train(texts: Iterable[bytes], labels, seed: int = 7) -> Model:
    """Joint gradient descent on embeddings and softmax, one text a step in random
    order. ``labels`` are read when the texts are used up."""
    size = 1 << TABLE_BITS
    bags = _Bags(texts, size)
    y = np.asarray(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size), prior)
    shared = bags.spread >= MIN_TEXTS
    bags.only(shared)
    rng = np.random.default_rng(seed)
    emb = np.zeros((size, DIMENSIONS), dtype=np.float32)
    soft = rng.normal(0, 1 / np.sqrt(DIMENSIONS), (2, DIMENSIONS)).astype(np.float32)
    bias = np.array([0.0, prior], dtype=np.float32)
    weight = np.array([1.0, TOXIC_WEIGHT], dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(y)):
            u, c = bags[i]
            mean = c @ emb[u]
            z = soft @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the logits
            p *= weight[y[i]]
            emb[u] -= (rate * c)[:, None] * (p @ soft)[None, :]
            soft -= SOFT_RATE * np.outer(p, mean)
            bias -= SOFT_RATE * p
    return Model(np.where(shared, emb @ (soft[1] - soft[0]), 0), bias[1] - bias[0])


def fold(doc_id) -> "F.Column":
    """A null id reads as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents outside the held-out fold."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_ROWS))
    sample = (docs.select("doc_id", common.text_or_empty().alias("text"))
              .join(F.broadcast(known), "doc_id")  # at most TRAIN_ROWS rows
              .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic"))
    labels_seen: list[int] = []

    def texts():
        for t, y in sample.select("text", "toxic").toLocalIterator():
            labels_seen.append(y)
            yield t.encode()

    return train(texts(), labels_seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(shared.value.scores(common.as_bytes(b.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run), "doc_id long, score double")


def civil_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(common.as_bytes(b.column(at))) < threshold))

    return docs.mapInArrow(common.lean(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
