"""Event-in-window range join without a nested loop.

``events.ts BETWEEN windows.start AND windows.end`` (plus equality keys) has
no equi-join key of its own, so Spark would plan a nested-loop join.  Binning
both sides by a calendar unit gives one: every window is listed once per bin
it overlaps (``explode(sequence(bin(start), bin(end)))``), every event joins
the windows of its own bin on the equality keys plus the bin, and the range
is a residual filter of that hash join.  A window ending before it starts
overlaps no bin and matches nothing, as with ``BETWEEN``.

With windows much shorter than a bin (shifts within a day) each window is
listed once; the window side is small and is broadcast by the planner / AQE
when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_BIN = "__rj_bin"


def _bin(c: Column, unit: str) -> Column:
    if unit == "day":
        return F.to_date(c)
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def range_join(events: DataFrame, windows: DataFrame, on: Sequence[str], ts: str,
               start: str, end: str, unit: str = "day") -> DataFrame:
    """Inner join of events to the windows containing them (closed range)."""
    step = F.expr("INTERVAL 1 DAY") if unit == "day" else F.expr(f"INTERVAL 1 {unit.upper()}")
    lo, hi = _bin(F.col(start), unit), _bin(F.col(end), unit)
    bins = F.when(F.col(end) >= F.col(start), F.sequence(lo, hi, step))
    w = windows.select("*", F.explode(bins).alias(_BIN))
    e = events.withColumn(_BIN, _bin(F.col(ts), unit))
    return (e.join(w, on=[*on, _BIN], how="inner")
            .where(F.col(ts).between(F.col(start), F.col(end)))
            .drop(_BIN))
