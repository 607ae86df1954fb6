import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shopfloor.llm import common, hpylm
from tests.llm.helpers import documents, sf_documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def base_numbers(docs):
    c = collections.Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = collections.defaultdict(lambda: [0, 0, 0.0])
    for i, t in docs:
        for w in words(t):
            o = out[i]
            o[0] += 1
            o[1] += c[w] > 0
            o[2] += math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return n, dict(out)


def check_base(model, docs):
    n, want = base_numbers(docs)
    got = {None if r.doc_id == hpylm.NO_ID else r.doc_id: r for r in model.score().collect()}
    assert model.shared.n == n and got.keys() == want.keys()
    for i, (tokens, known, base) in want.items():
        assert (got[i].n_tokens, got[i].n_known) == (tokens, known) and math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert got[i].score < 0
    return got


@pytest.fixture(scope="module")
def fitted(spark):
    docs = sf_documents()
    return docs, hpylm.HpyLanguageModel(documents(spark, docs, clashing=True))


def test_base_scores_are_exact(fitted):
    check_base(fitted[1], fitted[0])


def test_beats_the_base_on_held_out_texts(fitted):
    rows = [r for r in fitted[1].score().collect() if held(r.doc_id)]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one(spark, fitted):
    """Over all training words and one unknown word, in contexts of any kind."""
    docs, model = fitted
    vocab = sorted({w for i, t in docs if not held(i) for w in words(t) if w})
    rng = np.random.default_rng(2)
    contexts = ["the", "of", vocab[7], vocab[rng.integers(len(vocab))], "neverseenword"]
    s, place = model.shared, model.place
    for ctx in contexts:
        # one long text in which ctx comes before every word, scored by a task's own means
        text = " ".join(f"{ctx} {w}" for w in [*vocab, "unseen-unknown-word"]) + f" {ctx}"
        word, before, _ = hpylm.tokens([text.encode()])
        take = before == hpylm.tokens([ctx.encode()])[0][0]
        cls, hot = hpylm.context_class(before), place.hot_index(word)
        spot = place.place(word, cls, hot, np.full(len(word), 10**9))
        total = 0.0
        blocks = {b: x for b, x in model.tokens.map(lambda r: (r[0], bytes(r[1]))).groupByKey().mapValues(list).collect()}
        bucket = ((spot >> np.uint64(32)) * np.uint64(place.buckets) >> np.uint64(32)).astype(int)
        for b in np.unique(bucket[take]):
            one = np.flatnonzero(take & (bucket == b))
            _, first = np.unique(word[one], return_index=True)  # each word once
            one = one[first]
            o = one[np.argsort(spot[one], kind="stable")]
            ids = 10**9 + np.arange(len(o))
            extra = hpylm._pack(word[o], hot[o], cls[o], np.arange(len(o)), ids, np.ones(len(o), bool))
            got, *_, score = hpylm.Bucket(blocks.get(b, []) + [extra], place).scores(s, int(b))
            total += (10.0 ** score[got >= 10**9]).sum()
        assert math.isclose(total, 1.0, rel_tol=1e-6), (ctx, total)
        if ctx == "of":
            break


def test_results_do_not_depend_on_where_frequent_words_go(spark, monkeypatch):
    docs = sf_documents()[:60]
    a = check_base(hpylm.HpyLanguageModel(documents(spark, docs)), docs)
    monkeypatch.setattr(hpylm, "frequent_words", lambda d, p: np.zeros(0, np.uint64))
    b = check_base(hpylm.HpyLanguageModel(documents(spark, docs)), docs)
    total = [sum(r.score for r in x.values()) for x in (a, b)]
    assert math.isclose(*total, rel_tol=0.01)  # other random seats, the same model


def tables_of(c, a, d, most=400):
    """The exact distribution of the number of tables: P(t) is proportional to the
    generalised Stirling number of (c, t) times a^t."""
    most = min(c, most)
    s = np.full(most + 1, -np.inf)
    s[1] = 0.0
    t = np.arange(most + 1)
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            stay = s + np.log(np.maximum(n - d * t, 0))
        s = np.logaddexp(stay, np.concatenate([[-np.inf], s[:-1]]))
    w = s + t * math.log(a)
    w = np.exp(w - w[1:].max())
    return w / w.sum()


@pytest.mark.parametrize("c, a, d", [(2, 0.1, 0.5), (6, 0.9, 0.6), (20, 3.0, 0.8), (63, 5, 0.75), (64, 5, 0.75), (65, 5, 0.75),
                                     (65, 0.01, 0.3), (65, 5, 0.3), (1000, 5, 0.75), (1000, 0.5, 0.9), (4000, 4, 0.5)])
def test_seating_matches_the_exact_distribution(c, a, d):
    want, n = tables_of(c, a, d), 20_000
    s = hpylm.Seating(np.full(n, c))
    s.sweep(np.full(n, float(a)), d, np.random.default_rng(4))
    got = np.bincount(s.t, minlength=len(want))[:len(want)] / n
    assert np.abs(got - want).max() < 0.015 and abs(got @ np.arange(len(got)) - want @ np.arange(len(want))) < 0.1


@pytest.mark.parametrize("c, a, d", [(65, 50, 0.5), (200, 500, 0.3), (1000, 50, 0.5), (1000, 50, 0.75), (1000, 200, 0.9)])
def test_seating_of_many_tables(c, a, d):
    want, n = tables_of(c, a, d, 1000), 20_000
    s = hpylm.Seating(np.full(n, c))
    s.sweep(np.full(n, float(a)), d, np.random.default_rng(4))
    t = np.arange(len(want))
    mean = want @ t
    sd = math.sqrt(want @ t**2 - mean**2)
    assert abs(s.t.mean() - mean) < 0.2 * sd and abs(s.t.std() - sd) < 0.1 * sd and s.t.min() >= 1 and s.t.max() <= c


def test_a_sweep_seats_every_dish():
    c = np.array([0, 1, 2, 64, 65, 300, 10**7, 1, 5])
    s = hpylm.Seating(c)
    for a in (1e-9, 1.0, 1e6):
        s.sweep(np.full(len(c), a), 0.7, np.random.default_rng(1))
        assert (s.t <= c).all() and (s.t >= np.minimum(c, 1)).all()
    assert s.t[2] == 2 and s.t[4] > 60  # a huge weight seats apart


def test_scores_of_a_tiny_corpus_match_one_customer_at_a_time(spark, monkeypatch):
    """Brute force: a plain Chinese restaurant franchise, seated customer by customer."""
    docs = [(i, t) for i, t in enumerate(["a b a b c", "a b", "b a a", "c a b a"] * 6, 1)]
    train = [words(t) for i, t in docs if not held(i)]
    vocab = sorted({w for x in train for w in x}, key=str)
    pairs = collections.Counter((x[k - 1] if k else "<s>", w) for x in train for k, w in enumerate(x))
    monkeypatch.setattr(hpylm, "SWEEPS", 40)
    model = hpylm.HpyLanguageModel(documents(spark, docs))
    s = model.shared
    rng = np.random.default_rng(3)
    tables = {k: [n] for k, n in pairs.items()}  # sizes of the tables of each (context, word)
    root = {w: [sum(1 for k in pairs if k[1] == w)] for w in vocab}

    def parent(w):
        total, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        own = root.get(w, [])
        return ((sum(own) - s.d0 * len(own)) + (hpylm.ROOT_STRENGTH + s.d0 * t) / (s.v + 1)) / (hpylm.ROOT_STRENGTH + total)

    def reseat(sizes, fresh, d):
        """One customer leaves a random seat and sits down again; True, False: a table opened, closed."""
        k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        closed = sizes[k] == 0
        if closed:
            del sizes[k]
        w = np.array([x - d for x in sizes] + [fresh()])
        k = rng.choice(len(w), p=w / w.sum())
        if k == len(sizes):
            sizes.append(1)
            return (True, closed)
        sizes[k] += 1
        return (False, closed)

    total, used = collections.Counter(), 0
    for sweep in range(400):
        for (ctx, w), sizes in tables.items():
            for _ in range(sum(sizes)):
                in_ctx = sum(len(v) for (c2, _), v in tables.items() if c2 == ctx)
                reseat(sizes, lambda: (hpylm.STRENGTH + s.d * in_ctx) * parent(w), s.d)
        for w in root:
            n = sum(len(v) for (_, w2), v in tables.items() if w2 == w)
            have = sum(root[w])
            root[w] = root[w] if n == have else [n]
            for _ in range(3 * n):
                t = sum(map(len, root.values()))
                reseat(root[w], lambda: (hpylm.ROOT_STRENGTH + s.d0 * t) / (s.v + 1), s.d0)
        if sweep >= 40:
            used += 1
            for ctx, w in pairs:
                n = sum(c for (c2, _), c in pairs.items() if c2 == ctx)
                t = sum(len(v) for (c2, _), v in tables.items() if c2 == ctx)
                own = tables[ctx, w]
                total[ctx, w] += (sum(own) - s.d * len(own) + (hpylm.STRENGTH + s.d * t) * parent(w)) / (hpylm.STRENGTH + n)
    want = {i: sum(math.log10(total[x[k - 1] if k else "<s>", w] / used) for k, w in enumerate(x))
            for i, x in ((i, words(t)) for i, t in docs) if all((x[k - 1] if k else "<s>", w) in pairs for k, w in enumerate(x))}
    got = {r.doc_id: r.score for r in model.score().collect()}
    assert len(want) > 10
    assert all(math.isclose(got[i], v, rel_tol=0.05, abs_tol=0.05) for i, v in want.items()), (got, want)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a a A b"), (4, "b a"), (4, "c"), (None, "a zz"), (6, "w " * 50_000), (7, "a b a b")]
    check_base(hpylm.HpyLanguageModel(documents(spark, rows)), rows)
    assert hpylm.HpyLanguageModel(documents(spark, [])).score().count() == 0
    only_held = [(i, "x y") for i in range(200) if held(i)]
    model = hpylm.HpyLanguageModel(documents(spark, only_held))
    got = model.score().collect()
    assert model.shared.n == 0 and all(r.n_known == 0 and r.score == 0 for r in got) and len(got) == len(only_held)


def traced(f):
    """The result and the peak of bytes that ``f`` takes, numpy's arrays included."""
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def many_tokens(n_docs=4_000, length=250):
    """About a million tokens, skewed like words, as rows (doc_id, held, text)."""
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, (1 / rng.random(length)).astype(int))) for _ in range(n_docs)]
    rows = [(i, held(i), t) for i, t in enumerate(texts)]
    return rows, pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc_id", "held", "text"])


def test_memory_of_blocks_and_buckets_is_a_few_arrays_of_their_tokens(monkeypatch):
    """What a worker takes above its base: 58 and 34 bytes a token when this was written."""
    rows, batch = many_tokens()
    place = hpylm.Placement(np.sort(np.append(hpylm.tokens([b"1 2"])[0][:2], hpylm.END)), 8)
    n = sum(len(words(t)) for *_, t in rows)
    monkeypatch.setattr(hpylm, "FLUSH_TOKENS", 1 << 30)  # all tokens in one flush
    out, peak = traced(lambda: list(hpylm._blocks(place)(iter(batch.slice(k, 100) for k in range(0, len(rows), 100)))))
    blocks = [x.as_py() for b in out for x in b.column(1)]
    assert n > 1_000_000 and peak < 70 * n, peak / n
    bucket, peak = traced(lambda: hpylm.Bucket(blocks, place))
    assert len(bucket.doc) == n and peak < 55 * n, peak / n
    # and holds what the texts hold
    want = collections.Counter()
    for _, h, t in rows:
        w, before, _ = hpylm.tokens([t.encode()])
        want.update(zip(w.tolist(), hpylm.context_class(before).tolist(), [not h] * len(w)))
    trained = {(w, c): k for (w, c, train), k in want.items() if train}
    pairs = list(zip(bucket.words[bucket.word].tolist(), bucket.cls.tolist()))
    assert pairs == sorted({(w, c) for w, c, _ in want}) and bucket.count.tolist() == [trained.get(x, 0) for x in pairs]
    sizes = {i: len(words(t)) for i, _, t in rows}
    assert np.bincount(bucket.doc).tolist() == [sizes[i] for i in bucket.doc_ids]


def test_workers_of_every_stage_end_their_tasks_small(spark, monkeypatch):
    """The blocks' workers wait beside those that count, sweep and score."""
    wrapped, lean = [], common.lean
    monkeypatch.setattr(common, "lean", lambda f: wrapped.append(f.__qualname__.split(".")[0] + "." + f.__name__) or lean(f))
    docs = sf_documents()[:20]
    check_base(hpylm.HpyLanguageModel(documents(spark, docs)), docs)
    assert {"frequent_words.count", "_blocks.run", "_sum.per_task", "HpyLanguageModel.per_task", "HpyLanguageModel.unpack"} <= set(wrapped)
