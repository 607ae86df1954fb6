"""Stored minutes: the mergeable (device, minute) rows of ``oee.minutes_of``.

A rollup is a folder the caller names; every batch of readings appends files to
it. A batch brings, for each minute it touches, the minute's row computed from
all readings of that minute, with the batch's number: the row with the largest
number counts. So late readings that fall between stored ones are exact, a batch
applied twice changes nothing, and a batch that fails leaves nothing behind
(Spark publishes a job's files when it commits). Minutes that no batch touches
again are never read or written again.

Files are partitioned by day. Picking the newest row of a minute needs no
exchange of its own: it is a window per device over minutes, which is the window
that ``plans.segments.close`` works in too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shopfloor.functions.timefmt import trunc_ntz
from shopfloor.params import Params

DEV = "deviceuid"


def touched_minutes(batch: DataFrame) -> DataFrame:
    """The (device, minute) pairs of a batch of ``device_data`` rows."""
    return batch.select(DEV, trunc_ntz("minute", F.col("timestamp")).alias("minute")).distinct()


def append(batch: DataFrame, readings: DataFrame, path: str, number: int, minutes_of) -> None:
    """Add batch ``number`` to the rollup at ``path``.

    ``batch`` holds the new rows of ``device_data``, ``readings`` all rows
    accepted so far, these included; of them only the touched minutes are
    parsed. ``minutes_of`` makes the rows (``oee.rollup_rows``).
    """
    first, last = (batch.select(f("timestamp")).scalar() for f in (F.min, F.max))
    minute = trunc_ntz("minute", F.col("timestamp"))
    rows = (readings.where((F.col("timestamp") >= trunc_ntz("minute", first))
                           & (F.col("timestamp") < trunc_ntz("minute", last) + F.expr("INTERVAL 1 MINUTE")))
            .withColumn("minute", minute)
            .join(touched_minutes(batch), on=[DEV, "minute"], how="left_semi").drop("minute"))
    (minutes_of(rows).withColumn("batch", F.lit(number).cast("long")).withColumn("day", F.to_date("minute"))
     .repartition("day").sortWithinPartitions(DEV, "minute")
     .write.mode("append").partitionBy("day").parquet(path))


def read(spark, path: str) -> DataFrame:
    """The newest row of every (device, minute)."""
    rows = spark.read.parquet(path)
    w = Window.partitionBy(DEV).orderBy("minute", F.desc("batch"))
    before = F.lag("minute").over(w)
    return rows.withColumn("__before", before).where("__before is null or __before <> minute").drop("__before", "batch")


def minutes_in_range(tables, params: Params) -> DataFrame:
    """Stored minutes of the request range and device.

    A stored minute cannot be cut, so a given start must be a whole minute and a
    given end the last microsecond of one.
    """
    m = read(tables.spark, tables.rollup)
    if params.start is not None:
        if params.start[17:] not in ("", "00"):
            raise ValueError(f"a rollup needs a start on a whole minute, got {params.start!r}")
        m = m.where((F.col("minute") >= F.to_timestamp_ntz(F.lit(params.start)))
                    & (F.col("day") >= F.lit(params.start[:10]).cast("date")))
    if params.end is not None:
        if params.end[17:] != "59.999999":
            raise ValueError(f"a rollup needs an end at the last microsecond of a minute, got {params.end!r}")
        m = m.where((F.col("minute") <= F.to_timestamp_ntz(F.lit(params.end)))
                    & (F.col("day") <= F.lit(params.end[:10]).cast("date")))
    if params.device is not None:
        m = m.where(F.col(DEV) == F.lit(params.device))
    return m
