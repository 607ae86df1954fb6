import collections
import random
import re

import numpy as np
import pyarrow as pa

from shopfloor.llm import components, near_dup
from tests.llm.helpers import documents, sf_documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        both = collections.Counter(j for x in s for j in where[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}


def near_copies(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    docs, k = [], 0
    for g in range(60):
        base = rng.choices(vocab, k=rng.randint(5, 400))
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append((k, " ".join(t)))
            k += 1
    rng.shuffle(docs)
    return docs


def test_near_copies_against_brute_force(spark):
    docs = near_copies()
    assert run(documents(spark, docs, clashing=True)) == brute(docs)


def test_given_documents(spark):
    docs = sf_documents()
    assert run(documents(spark, docs)) == brute(docs)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (6, "a b c d e"), (7, "a b c d e f"),
            (8, long), (9, long + " y"), (None, "solo words of no id"), (10, "a b c d e")]
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (7, 2, 7, True), (8, 19996, 8, True), (9, 19997, 8, False), (None, 1, None, True), (10, 1, 6, False)], key=repr)
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_stage(spark):
    df = documents(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, "else")], clashing=True)
    out = near_dup.distinct_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(600, 680)] + [
        tuple(map(int, e)) for e in rng.integers(1000, 1100, (60, 2))] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_similarity_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.similar(a, a[:75]) and not near_dup.similar(a, a[:74])


def test_unconfirmed_pairs_hide_no_candidate():
    """Rows 0, 1, 2 in a row at 60 equal minhashes each: the pair (0, 2) is a candidate of its own."""
    low = np.zeros((3, near_dup.HASHES), np.uint8)
    low[1:, -4:] = 1
    low[2:, -8:-4] = 1
    low = np.concatenate([low[:1], low, low[:1]])  # regions at the ends of a part are crowds
    keys = [bytes([k]) * 33 for k in (0, 1, 1, 1, 2)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array([1, 5, 7, 9, 11]), pa.array([r.tobytes() for r in low], pa.binary())],
        ["key", "node", "low"])
    got = [(a, b) for x in near_dup._candidates([batch]) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist())
           if b is not None]
    assert sorted(got) == [(5, 7), (5, 9), (7, 9)]


def test_crowd_of_one_template_against_brute_force(spark):
    """Texts of one template, pairwise about 0.70 alike, and a few true pairs among them."""
    rng = random.Random(11)
    frame = [f"t{k}" for k in range(160)]
    docs = [(k, " ".join(frame + [f"u{k}x{i}" for i in range(34)])) for k in range(2000)]
    for k in range(60):  # at 0.77 to an own text
        w = docs[k * 30][1].split()
        docs.append((5000 + k, " ".join(w[:-25] + [f"v{k}x{i}" for i in range(25)])))
    number = collections.defaultdict(lambda: len(number))
    sets = [(i, {number[x] for x in shingles(t)}) for i, t in docs]
    name = {i: i for i, _ in docs}
    for at, (i, s) in enumerate(sets):
        for j, o in sets[:at]:
            if 100 * (n := len(s & o)) >= 75 * (len(s) + len(o) - n):
                name[i] = name[j]  # each text has one true partner at most
    assert run(documents(spark, docs)) == {i: (len(s), name[i], name[i] == i) for i, s in sets}
    assert sum(i != c for i, c in name.items()) == 60


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(near_dup, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    got = near_dup._overlaps(sets[:15], sets[15:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]


def test_near_copies_of_a_null_id(spark):
    """A text of a null id is linked, and chains run through it."""
    w = [f"n{k}" for k in range(100)]
    rows = [(7, " ".join(w)), (None, " ".join(w[:-10] + [f"p{k}" for k in range(10)])),
            (9, " ".join([f"r{k}" for k in range(10)] + w[10:-10] + [f"p{k}" for k in range(10)]))]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {7: (7, True), None: (7, False), 9: (7, False)}


def test_near_copies_whose_ids_are_all_null(spark):
    """One text of the component stays; texts of null ids apart from it all stay."""
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-2], "y", "z"])
    df = documents(spark, [(None, a), (None, b), (None, c), (None, "something else that is long enough"), (None, ""), (None, None)])
    got = near_dup.near_duplicates(df).collect()
    assert sorted(r.kept for r in got if r.n_shingles > 50) == [False, False, True]
    assert all(r.kept for r in got if r.n_shingles < 50)
    kept = [r.text for r in near_dup.distinct_documents(df).collect()]
    assert len(kept) == 4 and sum(t in (a, b, c) for t in kept) == 1
