"""Result delivery (SK4): rows as JSON documents.

The reference answers each request with ``res.json(rows)``; here a result
DataFrame is turned into one JSON document per row on the executors
(``to_json(struct(*))``) and written as JSON lines, or keyed by a column the
way the nested machine record is keyed by ``machine_uid``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def json_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON text per row; with ``key``, ``(key, json)`` pairs."""
    doc = F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json")
    return df.select(F.col(key), doc) if key else df.select(doc)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, written in parallel by the executors."""
    df.write.mode(mode).json(path)
