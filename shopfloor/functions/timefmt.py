"""Calendar buckets and labels over TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ("hour", "day", "week", "month")


def trunc_ntz(unit: str, ts: Column) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ (Spark returns TIMESTAMP)."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def pg_week_label(ts: Column) -> Column:
    """PostgreSQL ``TO_CHAR(ts, 'YYYY-WW')``: week = (day_of_year - 1) / 7 + 1."""
    week = F.floor((F.dayofyear(ts) - 1) / 7) + 1
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def period_label(unit: str, ts: Column) -> Column:
    """Labels of the per-period OEE (``TO_CHAR(DATE_TRUNC(unit, ts), mask)``)."""
    t = trunc_ntz(unit, ts)
    if unit == "hour":
        return F.date_format(t, "yyyy-MM-dd HH")
    if unit == "day":
        return F.date_format(t, "yyyy-MM-dd")
    if unit == "week":
        return pg_week_label(t)
    if unit == "month":
        return F.date_format(t, "yyyy-MM")
    raise ValueError(f"unit must be one of {UNITS}, got {unit!r}")


def interval_label(unit: str, ts: Column) -> Column:
    """Labels of the per-interval OEE; the hour label ends in ``:00``."""
    if unit == "hour":
        return F.date_format(trunc_ntz("hour", ts), "yyyy-MM-dd HH:00")
    return period_label(unit, ts)


def iso_millis(ts: Column) -> Column:
    """``TO_CHAR(ts, 'YYYY-MM-DD"T"HH24:MI:SS.MS"Z"')``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_kolkata(ts: Column) -> Column:
    """UTC wall clock to Asia/Kolkata wall clock, still NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), ts)
