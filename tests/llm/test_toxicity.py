import zlib

import numpy as np
import pytest

from shopfloor.llm import toxicity
from tests.llm.helpers import documents


def test_subwords_do_not_cross_words():
    slots, owner = toxicity.subwords([b"Ab cd", b"", b"ab  cd", b"x"])
    assert sorted(slots[owner == 0]) == sorted(slots[owner == 2])
    assert (owner == 1).sum() == 0 and (owner == 3).sum() == 1  # " x "
    both = [set(toxicity.subwords([t])[0].tolist()) for t in (b"abcdef", b"abcxef")]
    assert both[0] & both[1] and both[0] - both[1]


def test_held_out_accuracy():
    duckdb = pytest.importorskip("duckdb")
    rows = duckdb.connect().sql("SELECT d.doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN "
                                "'/root/testdata/sf0.1/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows])
    y = np.array([t for *_, t in rows])
    texts = [x.encode() for _, x, _ in rows]
    train = np.flatnonzero(~held)
    model = toxicity.train([texts[i] for i in train], y[train])
    s = model.scores([t for t, h in zip(texts, held) if h])
    yh = y[held]
    assert ((s >= 0.5) == yh).mean() > 0.93
    assert (s[yh == 1] >= 0.5).mean() > 0.8 and (s[yh == 0] >= 0.5).mean() < 0.05
    assert np.median(s[yh == 1]) > 0.8


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("bcdfghlmnprstv"), 6)) for _ in range(400)]
    texts, y = [], []
    for k in range(600):
        w = rng.choice(vocab, 40).tolist()
        if k % 2:
            w[rng.integers(40)] = "wretchedness"
        texts.append(" ".join(w).encode())
        y.append(k % 2)
    m = toxicity.train(texts, np.array(y))
    clean = rng.choice(vocab, 39).tolist()
    score = lambda w: float(m.scores([" ".join([*clean, w]).encode()])[0])
    assert score("wretchedness") > 0.5 > score(vocab[0])
    assert score("wretchednes") > score(vocab[0]) and score("wretchednezs") > score(vocab[0])


def test_defined_cases(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (None, "a b c"), (5, "a b c"), (5, "a b c")],
                     clashing=True)
    m = toxicity.train([b"bad word", b"good day", b"bad bad", b"nice day"] * 5, np.array([1, 0, 1, 0] * 5))
    got = toxicity.score(docs, m).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] and by[5] == by[None] and all(0 <= s <= 1 for s in by.values())
    kept = toxicity.civil_documents(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert toxicity.score(documents(spark, []), m).count() == 0


def test_fit_without_both_classes(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(20)])
    schema = "doc_id long, quality int, toxic int"
    none = toxicity.fit(docs, spark.createDataFrame([], schema))
    assert none.scores([b"x"])[0] == 0.5
    ones = toxicity.fit(docs, spark.createDataFrame([(k, 1, 1) for k in range(20)] + [(None, 1, 0), (3, 0, None)], schema))
    assert ones.scores([b"x"])[0] > 0.99


def test_held_out_rows_are_not_learned_from(spark):
    docs = documents(spark, [(k, "bad word" if k % 2 else "nice day") for k in range(60)])
    labels = [(k, 0, k % 2) for k in range(60)]
    flipped = [(k, 0, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, _, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert np.array_equal(a.logit, b.logit) and a.bias == b.bias


def test_a_null_id_is_held_out(spark):
    """As everywhere, a null id reads as the empty text, whose crc32 is 0."""
    from pyspark.sql import functions as F
    rows = documents(spark, [(None, "a"), (1, "b")]).select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows}[None] is True and all(r.h is not None for r in rows)
