"""Shared bits of the training-data operators' tests."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use internally.
CLASHING = ", fp long, node long, kept boolean, keep_id long, text_hash long, _id long, _hash long, n long, score double"


def documents(spark, rows, clashing=False):
    """rows: (doc_id, text) -> a documents frame, optionally with clashing extra columns."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    if clashing:
        return spark.createDataFrame([(*r, 1, 2, False, 3, 4, 5, 6, 7, 0.5) for r in full], DOCS + CLASHING)
    return spark.createDataFrame(full, DOCS)


def sf_documents():
    """(doc_id, text) of the small documents table."""
    duckdb = pytest.importorskip("duckdb")
    return duckdb.connect().sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
