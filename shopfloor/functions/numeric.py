"""Numeric helpers (all built-in expressions, so they stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the wire-weight formula: pi as written by the reference,
# steel density 7860 kg/m^3, diameter in mm (hence /1000/2 for the radius).
PI_APPROX = 3.14159
DENSITY = 7860.0


def round_half_up(c: Column, scale: int) -> Column:
    """PostgreSQL ``ROUND(numeric, s)``: half away from zero, as a double.

    Rounding is done in DECIMAL so it does not depend on binary
    representation (``round(1.005, 2)`` is 1.01, as in PostgreSQL).
    """
    return F.round(c.cast("decimal(38,12)"), scale).cast("double")


def micros_between(a: Column, b: Column) -> Column:
    """``b - a`` in microseconds (bigint) for NTZ timestamps."""
    return F.timestamp_diff("MICROSECOND", a, b)


def to_minutes(micros: Column) -> Column:
    return micros.cast("double") / 60_000_000.0


def wire_weight(diameter: Column, length: Column) -> Column:
    """Weight of ``length`` metres of wire of ``diameter`` mm, in tonnes.

    Same operation order as the reference: ``(pi * (d/1000/2)^2 * L * rho) / 1000``.
    ``length`` may be a product (minutes * speed); pass it pre-multiplied.
    """
    return (F.lit(PI_APPROX) * F.pow(diameter / 1000.0 / 2.0, 2) * length * F.lit(DENSITY)) / 1000.0


def ratio_half_up(num: Column, den: Column, scale: int) -> Column:
    """``ROUND(num / den, scale)`` for a non-negative integer ``num`` and a
    positive integer ``den``, computed exactly in integers (half away from
    zero, like PostgreSQL numeric rounding); NULL when ``den`` is 0 or NULL."""
    k = 10 ** scale
    d = F.when(den != 0, den.cast("bigint"))
    a = F.lit(2 * k) * num.cast("bigint") + d
    b = F.lit(2) * d
    return F.call_function("div", a, b).cast("double") / float(k)


def hours_2dp(micros: Column) -> Column:
    """``ROUND(seconds / 3600, 2)`` from a non-negative microsecond sum."""
    return ratio_half_up(micros, F.lit(3_600_000_000), 2)
