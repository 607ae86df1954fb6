import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shopfloor.llm import exact_dedup
from shopfloor.llm.quotient_filter import CountingQuotientFilter as Cqf
from tests.llm.helpers import documents


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 9), max_size=30), max_size=5))
def test_filters_merge_losslessly(lists):
    merged = Cqf.merge([Cqf.of(np.array(x, np.uint64)) for x in lists])
    flat = [v for x in lists for v in x]
    assert dict(zip(merged.fingerprints().tolist(), merged.count.tolist())) == {v: flat.count(v) for v in flat}
    again = Cqf.merge([Cqf.from_bytes(f.to_bytes()) for _, f in merged.split(7)])
    assert again.fingerprints().tolist() == merged.fingerprints().tolist()
    assert merged.counts(np.array([1 << 63, *flat], np.uint64)).tolist() == [flat.count(v) for v in [1 << 63, *flat]]


def run(df):
    return {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(df).collect()}


def test_groups_nulls_and_ties(spark):
    rows = [(1, "a"), (2, "a"), (7, "a"), (3, "A"), (4, None), (5, ""), (6, "a "), (None, "z"), (8, "z"), (9, "w"), (9, "w")]
    got = run(documents(spark, rows, clashing=True))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(1, "a"): (7, 3, False), (2, "a"): (7, 3, False), (7, "a"): (7, 3, True), (3, "A"): (3, 1, True),
            (4, ""): (5, 2, False), (5, ""): (5, 2, True), (6, "a "): (6, 1, True), (None, "z"): (8, 2, False),
            (8, "z"): (8, 2, True), (9, "w"): (9, 2, True)}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {(i, sha(t)): v for (i, t), v in want.items()}
    assert exact_dedup.exact_dedup(documents(spark, rows)).count() == len(rows)


def test_stage_keeps_one_row_per_text_and_all_columns(spark):
    rows = [(1, "a"), (2, "a"), (4, None), (5, ""), (9, "w"), (9, "w"), (9, "v"), (None, "q"), (None, "q")]
    df = documents(spark, rows, clashing=True)
    out = exact_dedup.unique_documents(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "q"), (2, "a"), (5, ""), (9, "v"), (9, "w")]


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    assert exact_dedup.unique_documents(documents(spark, [])).count() == 0


def test_colliding_fingerprints_stay_apart(spark, monkeypatch):
    """Byte verification: with one fingerprint for all texts nothing is merged."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(5).cast("long"))
    got = exact_dedup.exact_dedup(documents(spark, [(1, "a"), (2, "b"), (3, "b")])).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in got} == {1: (1, True), 2: (3, False), 3: (3, True)}
