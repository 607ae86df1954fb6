"""Home-page composites (M8, M9, M25): one plan per page instead of the
reference's N+1 requests or parallel queries merged in the client."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopfloor.functions.numeric import round_half_up
from shopfloor.operators import oee, production, status
from shopfloor.operators.catalog import machine_catalog
from shopfloor.operators.sequences import REELS_OF_ALL
from shopfloor.params import Params
from shopfloor.plans.segments import close, segment
from shopfloor.sources import telemetry as tm
from shopfloor.sources.fixtures import Tables
from shopfloor.sources.sinks import json_rows

DEV = "deviceuid"


def _year_and_reels(t: Tables, p: Params) -> DataFrame:
    """v1 produced length and reel count per device, from one pass over the readings.

    Length: months of the *current* year (year of ``as_of``) whose month number lies
    between the months of start and end, rounded to an integer; ranges across a year
    end give 0, as in the reference. Reels: every reading of the device (any time)
    paired with every 0->1 flip in range, i.e. ``rows(device) * flips(device)`` -- a
    product of two counts rather than the pairs; flips are between any two readings.
    """
    hours = segment(oee.telemetry(t, p), [DEV], ["seq_bucket"], [REELS_OF_ALL],
                    [F.max("month_production").alias("hi"), F.min("month_production").alias("lo")])
    start, end = tm.bounds(t, p)
    shown = (F.year("month_start") == F.year(status.as_of(t, p))) & F.month("month_start").between(F.month(start), F.month(end))
    months = (close(hours, [DEV], [REELS_OF_ALL], "seq_bucket")
              .groupBy(DEV, F.trunc("seq_bucket", "month").alias("month_start"))
              .agg((F.max("hi") - F.min("lo")).alias("d"), F.sum("flips").alias("flips")))
    made = months.groupBy(DEV).agg(round_half_up(F.sum(F.when(shown, F.col("d"))), 0).alias("produced_length"),
                                   F.sum("flips").alias("flips"))
    rows = tm.typed_all(t).groupBy(DEV).agg(F.count(F.lit(1)).alias("n"))
    return made.join(rows, on=DEV, how="left").select(
        DEV, "produced_length", (F.col("flips") * F.col("n")).alias("produced_reels"))


def company_overview(t: Tables, p: Params) -> DataFrame:
    cat = machine_catalog(t, p)
    st = status.status_latest_by_device(t, p).withColumnRenamed("machine_id", DEV)
    j = (cat.withColumn(DEV, F.col("machine_id"))
         .join(st, on=DEV, how="left").join(_year_and_reels(t, p), on=DEV, how="left"))
    return j.select(*cat.columns,
                    F.coalesce(F.col("status"), F.lit(status.OFFLINE)).alias("status"),
                    F.coalesce(F.col("produced_length"), F.lit(0.0)).alias("produced_length"),
                    F.coalesce(F.col("produced_reels"), F.lit(0)).cast("bigint").alias("produced_reels"))


def company_overview_oee(t: Tables, p: Params) -> DataFrame:
    """Overview plus the rounded OEE summary of every machine (one grouped
    job instead of one HTTP request per machine)."""
    ov = company_overview(t, p)
    o = oee.oee_device_rounded(t, p).drop("machine_uid")
    return ov.join(o, on="machine_id", how="left")


def machine_complete_nested(t: Tables, p: Params) -> DataFrame:
    """The nested record, delivered as one JSON document per machine."""
    return json_rows(machine_complete(t, p, nested=True), key="machine_uid")


def machine_complete(t: Tables, p: Params, nested: bool = False) -> DataFrame:
    """Machine record + production + OEE per machine.  ``nested=True`` gives
    the reference's shape (three struct columns keyed by ``machine_uid``)."""
    ms = status.machine_status(t, p)
    prod = production.machine_production(t, p)
    o = oee.oee_company(t, p).drop("machine_id")
    if nested:
        return (ms.select("machine_uid", F.struct(*ms.columns).alias("machine_data"))
                .join(prod.select("machine_uid", F.struct(*prod.columns).alias("production_data")),
                      on="machine_uid", how="left")
                .join(o.select("machine_uid", F.struct(*o.columns).alias("oee_data")),
                      on="machine_uid", how="left"))
    return ms.join(prod, on="machine_uid", how="left").join(o, on="machine_uid", how="left")
