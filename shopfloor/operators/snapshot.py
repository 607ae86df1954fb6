"""Last value per device (M4 without a scan of readings).

The snapshot holds the newest reading of every device. A batch of readings is
merged by one aggregate over (snapshot, the batch's newest per device): newest by
time, ties by value, so the order of batches does not matter and a batch merged
twice changes nothing. It is stored as a dimension (``sources.dimensions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopfloor.operators import status
from shopfloor.operators.oee import company_machines
from shopfloor.params import Params
from shopfloor.sources import dimensions, telemetry as tm
from shopfloor.sources.fixtures import Tables

VALUES = ("ts", "mc_text", "act_speed", "target_speed")


def newest(device_data: DataFrame) -> DataFrame:
    """The newest reading per device, from raw readings: (machine_id, ts, values)."""
    rows = tm.typed(tm.parse(device_data))
    return _newest(rows.select(F.col("deviceuid").alias("machine_id"), *VALUES))


def _newest(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("machine_id").agg(F.max(F.struct(*VALUES)).alias("r"))
            .select("machine_id", *[F.col(f"r.{v}").alias(v) for v in VALUES]))


def merged(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return _newest(snapshot.unionByName(batch))


def add(spark, path: str, number: int, device_data: DataFrame) -> bool:
    """Merge a batch of raw readings into the snapshot at ``path``; False if the batch
    number is already merged."""
    if not dimensions.batches(spark, path):
        dimensions.publish(newest(device_data), path, number)
        return True
    return dimensions.apply(spark, path, number, lambda old: merged(old, newest(device_data)))


def machine_status_latest(t: Tables, p: Params, path: str) -> DataFrame:
    """``status.machine_status_latest`` from the snapshot; ``as_of`` defaults to its
    newest reading."""
    s = dimensions.read(t.spark, path)
    now = F.to_timestamp_ntz(F.lit(p.as_of)) if p.as_of is not None else s.select(F.max("ts")).scalar()
    since = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(p.status_window_minutes))
    code = status.latest_code(F.col("mc_text"), F.col("act_speed"), F.col("target_speed"))
    live = s.where(F.col("ts") >= since).select("machine_id", code.alias("status"))
    return (company_machines(t, p).select("machine_uid", "machine_id").join(live, on="machine_id", how="left")
            .select("machine_uid", "machine_id", F.coalesce(F.col("status"), F.lit(status.OFFLINE)).alias("status")))
