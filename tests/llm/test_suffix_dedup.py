import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shopfloor.llm import common, suffix_dedup, suffixes
from shopfloor.llm.suffixes import WINDOW
from tests.llm.helpers import documents, sf_documents


def brute(rows):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row, straight from the contract."""
    first = {}
    for i, t in rows:
        k = -(2**63) if i is None else i
        b = (t or "").encode()
        for p in range(len(b) - WINDOW + 1):
            w = b[p:p + WINDOW]
            first[w] = min(first.get(w, k), k)
    out = []
    for i, t in rows:
        k = -(2**63) if i is None else i
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            if first[b[p:p + WINDOW]] < k:
                gone[p:p + WINDOW] = b"\1" * WINDOW
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                   for r in suffix_dedup.deduplicated(df, **kw).collect()), key=str)


def passages(n, seed=3):
    """Texts that share passages, lines, runs and whole copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(6)] + ["-" * 90, " " * 300, "ab" * 80]
    texts = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 4))]
        parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        if i % 3 == 0:
            parts.append(shared[0])  # a passage of a third of all texts
        texts.append(rnd.choice(["", " ", "\n"]).join(parts))
        if i % 7 == 0 and texts:
            texts.append(rnd.choice(texts))
    return texts


def test_against_brute_force(spark):
    rows = [(i * 3 % 997, t) for i, t in enumerate(passages(120))]
    rows += [(2000, None), (2001, ""), (2002, "x" * 49), (2003, "x" * 50), (2004, "x" * 51), (2005, "x" * 50),
             (2006, "\0" * 60), (2007, "a\0" * 60), (2008, "\0" * 55)]
    assert run(documents(spark, rows, clashing=True)) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = passages(10, 5)
    rows = [(None, t[0]), (None, t[1]), (1, t[0]), (1, t[0]), (1, t[0] + t[2]), (2, t[1] + t[0]), (2, t[2]), (-5, t[2])]
    assert run(documents(spark, rows)) == brute(rows)


def test_long_text_and_hot_tokens_over_many_buckets(spark):
    """Splitters from every document, a bucket per 1 KB: tokens of the shared passage span buckets."""
    rows = [(i, t) for i, t in enumerate(passages(150, 8))]
    big = "".join(random.Random(1).choices("abcdefgh ", k=30_000))
    rows += [(900, big * 20 + "=" * 200_000), (901, big[5_000:9_000] + "tail"), (899, big[:100])]
    df = documents(spark, rows)
    cuts = suffix_dedup.splitters(suffix_dedup.keyed(df), 1152, 1)
    assert len(cuts) > 50 and len(set(cuts.tolist())) < len(cuts) - 2
    small = [r for r in rows if r[0] != 900]
    assert run(documents(spark, small), bucket_bytes=1152, sampled=1) == brute(small)
    got = {r[0]: r for r in run(df, bucket_bytes=1152, sampled=1)}
    assert got[900][1:4] == (800_000, 2_000, 20)  # its own repeats stay
    assert got[901][1:3] == (4_004, 4_000) and got[899][2] == 0


def test_given_documents(spark):
    rows = sf_documents()
    assert run(documents(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert run(documents(spark, [])) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\0"), max_size=400) | st.text(st.sampled_from("a"), max_size=300), max_size=6))
def test_every_window_has_one_segment(texts):
    raw = [t.encode() for t in texts]
    s, doc, pos = suffixes.segments(raw)
    got = [(int(d), int(p) + k) for d, p, n in zip(doc, pos, s.size) for k in range(n - WINDOW + 1)]
    assert sorted(got) == [(i, p) for i, t in enumerate(raw) for p in range(len(t) - WINDOW + 1)]
    for i in range(len(s)):
        assert s.bytes_of(np.array([i])).tobytes() == raw[doc[i]][pos[i]:pos[i] + s.size[i]]
        assert 0 <= s.left[i] <= suffixes.LEFT
        same = [j for j in range(len(s)) if s.hash[j] == s.hash[i]]
        assert suffixes.same_bytes(s, np.array(same), np.full(len(same), i)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text(st.sampled_from("ab"), min_size=50, max_size=140)), min_size=1,
                max_size=8), st.integers(0, 2))
def test_windows_of_smaller_owners(docs, period):
    raw = [(t * 3)[:len(t)] if period else t for _, t in docs]
    raw = [t.encode() for t in raw]
    s, doc, pos = suffixes.segments(raw)
    owner = np.array([i for i, _ in docs])[doc]
    seg, off = suffixes.earlier(s, owner)
    got = sorted(zip(doc[seg].tolist(), (pos[seg] + off).tolist()))
    first = {}
    for (i, _), t in zip(docs, raw):
        for p in range(len(t) - WINDOW + 1):
            first[t[p:p + WINDOW]] = min(i, first.get(t[p:p + WINDOW], i))
    want = [(d, p) for d, ((i, _), t) in enumerate(zip(docs, raw)) for p in range(len(t) - WINDOW + 1)
            if first[t[p:p + WINDOW]] < i]
    assert got == sorted(want)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=40))
def test_multikey_order(strings):
    buf = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    at = suffixes.ends(np.array([len(s) for s in strings]))
    order, common_bytes = suffixes.multikey_order(suffixes.words(buf, at[:-1], np.diff(at), 1, 4))
    padded = [s.ljust(32, b"\0") for s in strings]
    assert [padded[i] for i in order] == sorted(padded)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert common_bytes[k] == next((i for i in range(32) if a[i] != b[i]), 32)


def test_long_texts_are_read_in_slices():
    t = bytes(random.Random(2).choices(b"abcd", k=3 * common.CHUNK_BYTES // 2))
    got = sorted((int(p) + k) for s, doc, pos in suffix_dedup._kernel_chunks([b"short", t])
                 for p, n in zip(pos, s.size) for k in range(n - WINDOW + 1))
    assert got == list(range(len(t) - WINDOW + 1))


def test_words_read_backwards():
    buf = np.frombuffer(b"abcdefghijkl", np.uint8)
    got = suffixes.words(buf, np.array([11, 2, 0]), np.array([10, 3, 0]), -1, 2)
    whole = [b"".join(int(w[i]).to_bytes(8, "big") for w in got) for i in range(3)]
    assert whole == [b"lkjihgfedc".ljust(16, b"\0"), b"cba".ljust(16, b"\0"), bytes(16)]


def test_equal_hashes_of_unequal_segments():
    """Segments are told apart by their bytes, not by their hash."""
    texts = [t.encode() for t in passages(12, 4)]
    s, doc, pos = suffixes.segments(texts)
    s.hash[:] = 0
    zero = np.zeros(len(doc), np.int64)
    rows = list(suffix_dedup.pack([(s, doc, zero, pos)], np.array([], dtype="S16"), 3))
    spans, rest = suffix_dedup.decide([r[1] for r in rows if r[1] is not None])
    assert list(rest) == []
    spans += [suffix_dedup._unsqueezed(r[3]) for r in rows if r[1] is None]
    gone = {}
    for ids, _, start, stop in spans:
        for d, a, z in zip(ids.tolist(), start.tolist(), stop.tolist()):
            gone.setdefault(d, set()).update(range(a, z))
    want = brute([(i, t.decode()) for i, t in enumerate(texts)])
    assert sorted((i, len(gone.get(i, ()))) for i in range(len(texts))) == sorted((w[0], w[2]) for w in want)


def test_homes_of_ids_in_steps():
    homes = suffix_dedup.prime_from(200)
    assert homes == 211 and suffix_dedup.prime_from(2) == 2 and suffix_dedup.prime_from(1) == 2
    ids = np.arange(0, 400_000, 20)
    got = np.bincount(suffix_dedup._home(ids, np.zeros_like(ids), homes), minlength=homes)
    assert got.min() > 0 and got.max() < 2 * len(ids) / homes
