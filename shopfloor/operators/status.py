"""Live machine status from the last minutes of telemetry (M3, M4).

The status window is ``[as_of - 15 min, +inf)``; ``as_of`` replaces
``NOW()`` and defaults to the newest reading (an in-plan scalar subquery).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.operators.catalog import machine_catalog
from shopfloor.operators.oee import company_machines
from shopfloor.params import Params
from shopfloor.sources import telemetry as tm
from shopfloor.sources.fixtures import Tables

# Status codes of the reference.
STOPPED, RUNNING, OFFLINE, IDLE, SLOW, UNKNOWN = 0, 1, 2, 3, 4, 5


def as_of(t: Tables, p: Params):
    """``NOW()``: the given instant, else the newest reading (scalar subquery)."""
    if p.as_of is not None:
        return F.to_timestamp_ntz(F.lit(p.as_of))
    return tm.latest_ts(t)


def recent(t: Tables, p: Params) -> DataFrame:
    """Typed readings of the status window (no request range applies)."""
    since = as_of(t, p) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(p.status_window_minutes))
    df = tm.typed_since(t, since)
    if p.device is not None:
        df = df.where(F.col("deviceuid") == F.lit(p.device))
    return df


def status_by_max(t: Tables, p: Params) -> DataFrame:
    """Per device: code from the window's maxima, first matching rule wins."""
    g = (recent(t, p).groupBy(F.col("deviceuid").alias("machine_id"))
         .agg(F.max("mc_status").alias("mc"), F.max("act_speed").alias("speed"),
              F.max("target_speed").alias("target")))
    code = (F.when(F.col("mc") == 0, F.lit(STOPPED))
            .when((F.col("mc") == 1) & (F.col("speed") == 0), F.lit(IDLE))
            .when((F.col("mc") == 1) & (F.col("speed") < F.lit(0.5) * F.col("target")), F.lit(SLOW))
            .when(F.col("mc") == 1, F.lit(RUNNING))
            .otherwise(F.lit(UNKNOWN)))
    return g.select("machine_id", code.alias("status_code"))


def machine_status(t: Tables, p: Params) -> DataFrame:
    """Catalog plus status; machines without recent readings are offline."""
    cat = machine_catalog(t, p)
    st = status_by_max(t, p)
    return (cat.join(st, on="machine_id", how="left")
            .select(*cat.columns,
                    F.coalesce(F.col("status_code"), F.lit(OFFLINE)).alias("machine_status")))


def latest_code(mc_text: Column, speed: Column, target: Column) -> Column:
    """Code of one reading (text comparisons, missing status -> offline)."""
    return (F.when(mc_text.isNull(), F.lit(OFFLINE))
            .when(mc_text == "0", F.lit(STOPPED))
            .when((mc_text == "1") & (speed == 0), F.lit(IDLE))
            .when((mc_text == "1") & (speed < F.lit(0.5) * target), F.lit(SLOW))
            .when(mc_text == "1", F.lit(RUNNING))
            .otherwise(F.lit(OFFLINE)))


def status_latest_by_device(t: Tables, p: Params) -> DataFrame:
    g = (recent(t, p).groupBy(F.col("deviceuid").alias("machine_id"))
         .agg(F.max_by(F.struct("mc_text", "act_speed", "target_speed"), "ts").alias("r")))
    return g.select("machine_id",
                    latest_code(F.col("r.mc_text"), F.col("r.act_speed"), F.col("r.target_speed"))
                    .alias("status"))


def machine_status_latest(t: Tables, p: Params) -> DataFrame:
    """Status from the newest reading of the window only."""
    return (company_machines(t, p).select("machine_uid", "machine_id")
            .join(status_latest_by_device(t, p), on="machine_id", how="left")
            .select("machine_uid", "machine_id",
                    F.coalesce(F.col("status"), F.lit(OFFLINE)).alias("status")))
