"""Produced length and reel changes (M5-M7), as sums over minutes (see ``oee.minutes_of``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopfloor.functions.numeric import round_half_up
from shopfloor.functions.timefmt import trunc_ntz
from shopfloor.operators.oee import company_machines, minutes
from shopfloor.operators.sequences import REELS
from shopfloor.params import Params
from shopfloor.plans.segments import close
from shopfloor.sources.fixtures import Tables

DEV = "deviceuid"


def month_lengths(m: DataFrame, *sums) -> DataFrame:
    """Per device and month: spread of the monthly production counter (null for months
    without one), and the given aggregates."""
    return (m.groupBy(DEV, trunc_ntz("month", F.col("minute")).alias("month_start"))
            .agg(F.when(F.sum("n_prod") > 0, F.max("prod_max") - F.min("prod_min")).alias("production_length"),
                 F.sum("n_prod").alias("n_prod"), *sums))


def monthly_production(t: Tables, p: Params) -> DataFrame:
    m = month_lengths(minutes(t, p)).where(F.col("n_prod") > 0)
    return m.select(F.col(DEV).alias("machine_id"), "month_start",
                    round_half_up(F.col("production_length"), 6).alias("production_length"))


def reel_transitions(t: Tables, p: Params) -> DataFrame:
    """Devices with a reel: readings whose flag went from '0' to '1'."""
    m = close(minutes(t, p, REELS), [DEV], [REELS], "minute")
    return (m.groupBy(DEV).agg(F.sum("flips").cast("bigint").alias("produced_reels"))
            .where(F.col("produced_reels") > 0).select(F.col(DEV).alias("machine_id"), "produced_reels"))


def machine_production(t: Tables, p: Params) -> DataFrame:
    """Per machine: produced length (sum over months) and reels, zero if none."""
    m = close(minutes(t, p, REELS), [DEV], [REELS], "minute")
    made = (month_lengths(m, F.sum("flips").alias("flips")).groupBy(DEV)
            .agg(F.sum("production_length").alias("len"), F.sum("flips").alias("reels")))
    machines = company_machines(t, p).select("machine_uid", F.col("machine_id").alias(DEV))
    return (machines.join(made, on=DEV, how="left")
            .select("machine_uid",
                    round_half_up(F.coalesce(F.col("len"), F.lit(0.0)), 6).alias("produced_length"),
                    F.coalesce(F.col("reels"), F.lit(0)).cast("bigint").alias("produced_reels")))
