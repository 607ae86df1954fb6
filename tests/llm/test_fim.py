import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shopfloor.llm import fim
from tests.llm.helpers import documents


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(i, text):
    """The contract over Python strings, whose units are code points."""
    text = text or ""
    s = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(s[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, e = text[:a], text[a:z], text[z:]
    spm = h4 % 100 < 20
    out = f"<S>{e}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{e}<M>{m}"
    return n, "spm" if spm else "psm", a, z - a, sha(out), sha(text)


def run(df):
    return fim.restored(fim.arranged(df)).collect()


def key(r):
    return (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)


def test_against_strings(spark):
    odd = ["", None, "a", "é", "日本語テキスト", "😀" * 50, "x<P>y", "<", "<S", "M>", "<<<<PSM>>>", "a\n b\x00c", "é<M>"]
    rows = [(100 * k + j, t) for k in range(12) for j, t in enumerate(odd)]
    rows += [(None, "kein Name"), (7, "same"), (7, "same"), (7, "other"), (-3, "minus"), (2**62, "ü" * 300_000)]
    got = run(documents(spark, rows, clashing=True))
    assert sorted(map(str, ((r.doc_id, *key(r)) for r in got))) == sorted(str((i, *brute(i, t))) for i, t in rows)
    texts = sorted((r.doc_id or 0, r.text) for r in got)
    assert texts == sorted((i or 0, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert run(documents(spark, [])) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>PSMaé😀"), max_size=14), *[st.integers(0, 2**32 - 1)] * 4)
def test_inverse_permutation_restores(text, h1, h2, h3, h4):
    raw = text.encode()
    table, n, form, p, m = fim.arrange(raw, h1, h2, h3, h4)
    assert fim.restore(table.bytes(), form).bytes() == raw
    assert n == len(text) and table.sha256() == hashlib.sha256(table.bytes()).hexdigest()
    if form != "plain":
        # cutting and arranging split and permute descriptors and copy nothing
        assert sorted(table.pieces)[-3:] == [(1, 0, 3), (1, 3, 3), (1, 6, 3)]
        assert sum(x[2] for x in table.pieces if x[0] == 0) == len(raw) and table.buffers[0] is raw
        assert sorted(np.argsort(fim.ARRANGEMENTS[form])) == list(range(6))
