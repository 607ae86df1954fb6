"""Sequences as mergeable segments: figures of successive rows without a window over all of them.

Most metrics are sums over *pairs* of a row and its successor in a device's
history: a gap times a speed, the time spent in a state, a flag that flips. A
segment is one row per (keys, bucket of time) that holds, for every sequence,
its first row, its last row and the figures of the pairs inside. Segments that
do not overlap in time merge exactly: the pair that is missing between two of
them is (last row of the earlier, first row of the later). So

* ``segment`` cuts rows into segments: one sort of the rows by (keys, bucket),
  one window, one aggregate, whatever the number of sequences and figures;
* ``close`` adds to every segment the figures of the pair that leaves it, by a
  window per key over segments. There are at most (time span / bucket) segments
  per key however many readings it has, so a hot key is no hot task;
* segments may be stored and appended per batch (``sources.rollup``).

A sequence (``Sequence``) may leave rows out (readings without a line speed);
the successor is then the next row that belongs to it. Rows of equal time follow
each other by their values, so nothing depends on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence as Seq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Sequence:
    """Rows that follow each other, and figures of a row and its successor.

    ``rows`` tells which rows belong (an SQL condition; None: all); ``values`` are the columns the
    figures read; ``sums`` / ``tops`` map a figure's name to a function of (row,
    successor), two structs of ``ts`` and the values, whose non-null results are
    summed or whose largest is kept.
    """

    name: str
    rows: str | None = None
    values: tuple[str, ...] = ()
    sums: Mapping[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    tops: Mapping[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    @property
    def first(self) -> str:
        return f"{self.name}_first"

    @property
    def last(self) -> str:
        return f"{self.name}_last"

    def figures(self):
        for name, f in self.sums.items():
            yield name, f, F.sum, _plus
        for name, f in self.tops.items():
            yield name, f, F.max, F.greatest


def _plus(a: Column, b: Column) -> Column:
    """Sum of two figures, null only if both are."""
    return F.coalesce(a + b, a, b)


def _next(c: Column, name: str, keys: Seq[str], order: Seq[str]) -> Column:
    """The next non-null ``c`` (a column named ``name``) in the order of ``order``."""
    by = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"lead(`{name}`) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY {', '.join(f'`{o}`' for o in order)})")


def segment(rows: DataFrame, keys: Seq[str], bucket: Seq[str], sequences: Seq[Sequence],
            also: Seq[Column] = ()) -> DataFrame:
    """One row per (keys, bucket): the sequences' ends and figures, and the aggregates ``also``.

    ``bucket`` names columns that cut each key's history into spans of time.
    """
    by = [*keys, *bucket]
    values = list(dict.fromkeys(v for s in sequences for v in s.values))
    out = rows
    for s in sequences:
        own = F.struct("ts", *values)
        out = out.withColumn(f"__{s.name}", own if s.rows is None else F.when(F.expr(s.rows), own))
    for s in sequences:
        out = out.withColumn(f"__{s.name}_next", _next(F.col(f"__{s.name}"), f"__{s.name}", by, ["ts", *values]))
    aggs = list(also)
    for s in sequences:
        row, after = F.col(f"__{s.name}"), F.col(f"__{s.name}_next")
        aggs += [F.min(row).alias(s.first), F.max(row).alias(s.last)]
        pair = row.isNotNull() & after.isNotNull()
        aggs += [agg(F.when(pair, f(row, after))).alias(name) for name, f, agg, _ in s.figures()]
    return out.groupBy(*by).agg(*aggs)


def close(segments: DataFrame, keys: Seq[str], sequences: Seq[Sequence], order: str) -> DataFrame:
    """Segments whose figures include the pair of their last row and its successor in a
    later segment of the same keys; ``order`` names a column that orders segments."""
    out = segments
    for s in sequences:
        out = out.withColumn(f"__{s.name}_next", _next(F.col(s.first), s.first, keys, [order]))
    done = {}
    for s in sequences:
        row, after = F.col(s.last), F.col(f"__{s.name}_next")
        pair = row.isNotNull() & after.isNotNull()
        for name, f, _, merge in s.figures():
            done[name] = merge(F.col(name), F.when(pair, f(row, after)))
    return out.withColumns(done).drop(*[f"__{s.name}_next" for s in sequences])
