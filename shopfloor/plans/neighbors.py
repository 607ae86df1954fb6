"""Exact ``LEAD`` / ``LAG`` over very long, skewed sequences.

Every duration metric needs the next reading of the same sequence
(``LEAD(timestamp) OVER (PARTITION BY device ORDER BY timestamp)``).  A window
partitioned by device alone puts a device's whole history into one task; with
one device holding a third of all rows that task never finishes.

The sequence is therefore cut into time buckets (an hour by default):

1. a window partitioned by ``keys + bucket`` gives the neighbours of every
   row except the first / last row of each bucket ("edge" rows);
2. only edge rows are re-windowed, partitioned by ``keys`` alone: they are at
   most two per non-empty bucket, so this window is small whatever the data
   volume.  Ordered by the sequence column, the successor of a bucket's last
   row among the edge rows is the first row of the next non-empty bucket --
   its true successor -- and symmetrically for predecessors;
3. interior rows and corrected edge rows are unioned back.

No join and no aggregate is needed; the big side is shuffled once, by
``keys + bucket``.  The result equals the single-window form for any bucket
width, provided ``order`` is non-null.  Rows of equal ``order`` follow each
other by the values that lead or lag, so the result does not depend on how
rows arrive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_B = "__nb_bucket"
_NEXT_O = "__nb_next_order"
_PREV_O = "__nb_prev_order"


def with_neighbors(df: DataFrame, keys: Sequence[str], order: str, bucket: Column,
                   lead: Mapping[str, str] | None = None,
                   lag: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``lead`` / ``lag`` columns (``{new_name: source_column}``).

    ``keys`` are the window's partition columns, ``order`` its ordering
    column, ``bucket`` a column expression monotone in ``order``
    that splits each sequence (e.g. ``date_trunc('hour', ts)``).
    """
    lead = dict(lead or {})
    lag = dict(lag or {})
    keys = list(keys)
    if not lead and not lag:
        return df
    cols = list(df.columns)

    by = [order, *sorted({*lead.values(), *lag.values()} - {order})]
    w = Window.partitionBy(*keys, _B).orderBy(*by)
    inner = df.withColumn(_B, bucket).select(
        *cols,
        F.lead(order).over(w).alias(_NEXT_O), F.lag(order).over(w).alias(_PREV_O),
        *[F.lead(src).over(w).alias(name) for name, src in lead.items()],
        *[F.lag(src).over(w).alias(name) for name, src in lag.items()])
    out = [*cols, *lead, *lag]

    interior = inner.where(F.col(_NEXT_O).isNotNull() & F.col(_PREV_O).isNotNull()).select(*out)

    edge = inner.where(F.col(_NEXT_O).isNull() | F.col(_PREV_O).isNull())
    we = Window.partitionBy(*keys).orderBy(*by)
    fixed = edge.select(
        *cols,
        *[F.when(F.col(_NEXT_O).isNull(), F.lead(src).over(we)).otherwise(F.col(name)).alias(name)
          for name, src in lead.items()],
        *[F.when(F.col(_PREV_O).isNull(), F.lag(src).over(we)).otherwise(F.col(name)).alias(name)
          for name, src in lag.items()])
    return interior.unionByName(fixed)


def sequence_bucket(unit: str, ts: str = "ts") -> Column:
    """Bucket column for ``with_neighbors``: the stored ``seq_bucket`` when the
    unit is the store's (co-located scan, no shuffle), else ``date_trunc``."""
    from shopfloor.sources.telemetry import SEQ_UNIT
    if unit == SEQ_UNIT:
        return F.col("seq_bucket")
    return F.date_trunc(unit, F.col(ts))
