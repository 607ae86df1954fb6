import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopfloor.llm import prefix_trie
from shopfloor.llm.perfect_hash import NodeTable

SCHEMA = "conv_id long, turn long, role string, text string, depth long, d1 long, len string, band int, owner long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 8, "x", 7, 6) for r in rows], SCHEMA)


def brute(rows, shared=True):
    """Nodes straight from the contract: (conv_id, depth, ...) -> everything."""
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if shared else 0
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path[c] = tuple(own.get(base, [])[:h] + turns[h:]) if shared else tuple(turns)
    members, ending = {}, {}
    for c in sorted(path):
        for d in range(len(path[c]) + 1):
            members.setdefault(path[c][:d], []).append(c)
        ending.setdefault(path[c], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids.get(node, [])]
        own_bytes = len(node[-1][1].encode()) if node else 0
        total[node] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[node]) - 1) * own_bytes)
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(kids.get(n, [])), *total[n],
                   hashlib.sha256(",".join(map(str, ending.get(n, []))).encode()).hexdigest()) for n in members)


def run(rows_and_lengths):
    out = prefix_trie.trie(*rows_and_lengths).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def conversations(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        rows.append((c, 0, "system", "the very common first turn"))
        for t in range(1, rnd.randint(1, 12)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["ja", "né", "ok", "x" * 30])))
    return rows


def test_against_brute_force(spark):
    rows = conversations(150)
    rows += [(1000, t, "user", "alone") for t in range(3)]
    assert run(prefix_trie.with_shared_heads(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (-7, 1, None, None), (-7, None, "user", ""), (-5, 0, "user", "base"),
            (3, 1, "b", "tie"), (3, 1, "a", "tie"), (3, 1, "a", "tie"), (3, None, "z", "first"), (0, 5, "user", "é" * 5000),
            (0, -200, "u", "early"), (4, 0, "user", "short"), (12, 0, "u", "no base"), (2**40, 1, "u", "big id"), (1, 1, "", "\0")]
    assert run(prefix_trie.with_shared_heads(frame(spark, rows))) == brute(rows)
    assert run(prefix_trie.plain(frame(spark, rows))) == brute(rows, shared=False)


def test_one_long_conversation_and_copies(spark):
    """Paths of several bands and blocks; their copies and forks meet in one node each."""
    rnd = random.Random(5)
    long = [("user", rnd.choice(["a", "bb", "ccc"])) for _ in range(700)]
    rows = [(c, t, *x) for c in (2, 9, 40) for t, x in enumerate(long)]
    rows += [(50, t, *(x if t < 600 else ("user", "fork"))) for t, x in enumerate(long)]
    rows += [(c, t, "user", "copy") for c in range(100, 180) for t in range(3)]
    assert run(prefix_trie.plain(frame(spark, rows))) == brute(rows, shared=False)
    assert run(prefix_trie.with_shared_heads(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert run(prefix_trie.with_shared_heads(frame(spark, []))) == []
    assert run(prefix_trie.plain(frame(spark, [(None, 1, "user", "x")]))) == []


def test_colliding_digests_are_made_anew(spark, monkeypatch):
    rows = conversations(8)
    real, seeds = prefix_trie._paths, []

    def paths(r, lengths, seed):
        seeds.append(seed)
        p = real(r, lengths, seed)
        return p.withColumns({"d1": p["d1"] % 3, "d2": p["d2"] % 2}) if seed == 0 else p

    monkeypatch.setattr(prefix_trie, "_paths", paths)
    assert run(prefix_trie.plain(frame(spark, rows))) == brute(rows, shared=False)
    assert seeds == [0, 1]

    def stuck(r, lengths, seed):
        p = real(r, lengths, seed)
        return p.withColumns({"d1": p["d1"] % 3, "d2": p["d2"] % 2})

    monkeypatch.setattr(prefix_trie, "_paths", stuck)
    with pytest.raises(RuntimeError, match="collide"):
        prefix_trie.verified(*prefix_trie.plain(frame(spark, rows)))


def test_shards_of_any_size_add_up(monkeypatch):
    """Paths dealt over small shards give the sums of one shard."""
    monkeypatch.setattr(prefix_trie, "BAND", 4)
    rows, names = [], "conv_id depth d1 d2 p1 p2 adds leaf child parent".split()
    for c in range(40):
        for d in range(c % 11 + 1):
            node = hash((c // 8 if d < 5 else c, d)) if d else 0
            up = hash((c // 8 if d < 6 else c, d - 1)) if d > 1 else 0
            rows.append((c, d, node, 7, up, 7, c + d, d == c % 11, 1, -(1 << 63)))

    def total(limit, step):
        monkeypatch.setattr(prefix_trie, "SHARD_ROWS", limit)
        cols = [np.array(x, np.int64) for x in zip(*rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k:k + step]) for c in cols], names) for k in range(0, len(rows), step)]
        out, shards = {}, 0
        for b in prefix_trie._shards(batches):
            shards += 1
            for r in b.to_pylist():
                old = out.get((r["d1"], r["d2"]), (0, 0, 0))
                out[r["d1"], r["d2"]] = (old[0] + r["n_convs"], old[1] + r["n_leaves"], old[2] + r["saved_tokens"])
        return out, shards

    whole, one = total(10**6, 10**6)
    for limit, step in ((1, 1), (9, 4), (30, 50)):
        got, shards = total(limit, step)
        assert got == whole and shards > 3 and one == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-2**63, 2**63 - 1) | st.integers(0, 3), st.integers(-2**63, 2**63 - 1) | st.integers(0, 3)),
                max_size=200, unique=True))
def test_perfect_hash_is_minimal_and_verified(keys):
    a, b = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    table = NodeTable(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(len(keys)))
    other = [(x, y) for x in range(-2, 5) for y in range(-2, 5) if (x, y) not in set(keys)]
    c, d = (np.array([k[i] for k in other], np.int64) for i in (0, 1))
    assert (table.slots(c, d) == -1).all()


def test_perfect_hash_refuses_repeats():
    with pytest.raises(ValueError, match="distinct"):
        NodeTable(np.array([1, 1, 4]), np.array([2, 2, 5]))
