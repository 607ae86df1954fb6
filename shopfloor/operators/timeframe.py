"""Production / idle minutes and down / production / setup hours per shift
or calendar interval (M18-M22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions.numeric import hours_2dp, micros_between, round_half_up
from shopfloor.functions.timefmt import iso_millis, to_kolkata, trunc_ntz
from shopfloor.operators.oee import company_machines, minutes, telemetry
from shopfloor.operators.sequences import ACTIVITY, STATES
from shopfloor.params import Params
from shopfloor.plans.rangejoin import range_join
from shopfloor.plans.segments import close, segment
from shopfloor.sources import telemetry as tm
from shopfloor.sources.fixtures import Tables

DEV = "deviceuid"


def production_idle_time(t: Tables, p: Params) -> DataFrame:
    """Per machine: production and idle minutes, each gap capped at 15 min.

    A reading counts toward production when running and (speed > 0 or speed
    below half the target); toward idle when stopped, running at speed 0, or
    followed by a gap over 15 minutes -- a reading may count in both.  The
    last reading of a device has no gap and is skipped.
    """
    m = close(minutes(t, p, ACTIVITY), [DEV], [ACTIVITY], "minute")
    agg = m.groupBy(DEV).agg(F.sum("production_us").alias("p_us"), F.sum("idle_us").alias("i_us"))
    machines = company_machines(t, p).select("machine_uid", F.col("machine_id").alias(DEV))
    whole = lambda c: (F.coalesce(c, F.lit(0)).cast("double") / 60_000_000.0)
    return (machines.join(agg, on=DEV, how="left")
            .select("machine_uid", F.col(DEV).alias("machine_id"),
                    round_half_up(whole(F.col("p_us")), 6).alias("total_production_time"),
                    round_half_up(whole(F.col("i_us")), 6).alias("total_idle_time")))


# ----------------------------------------------------------------- shifts

def _dy(d: Column) -> Column:
    """``UPPER(TO_CHAR(d, 'DY'))``: MON, TUE, ..."""
    return F.upper(F.date_format(d, "EEE"))


def _at(d: Column, clock: Column) -> Column:
    """``TO_TIMESTAMP(date || ' ' || '06:00 AM', 'YYYY-MM-DD HH12:MI AM')``."""
    return F.to_timestamp_ntz(F.concat_ws(" ", d.cast("string"), clock), F.lit("yyyy-MM-dd h:mm a"))


def calendar_days(t: Tables, p: Params) -> tuple[Column, Column]:
    """First and last date of the request."""
    start, end = tm.bounds(t, p)
    return F.to_date(start), F.to_date(end)


def shift_calendar(t: Tables, p: Params) -> DataFrame:
    """Valid shift instances: every date of the range whose weekday appears in
    the shift's day list, minus the tenant's holidays (text date equal to
    ``YYYY-MM-DD``; ISO date-time holidays never match, as in the reference).
    Overnight shifts end before they start and so match no reading."""
    s = t.shifts
    if p.company is not None:
        s = s.where(F.col("company_id") == F.lit(p.company))
    days = F.sequence(*calendar_days(t, p), F.expr("INTERVAL 1 DAY"))
    inst = (s.select("*", F.explode(days).alias("shift_date"))
            .where(F.upper(F.col("shift_days")).contains(_dy(F.col("shift_date")))))
    if p.holiday_match == "strict":
        hol = t.holidays.select("company_id", F.col("holiday_date").alias("_hd"))
        inst = inst.withColumn("_hd", F.col("shift_date").cast("string"))
    elif p.holiday_match == "date":
        from shopfloor.operators.catalog import holiday_day
        hol = t.holidays.select("company_id", holiday_day(F.col("holiday_date")).alias("_hd"))
        inst = inst.withColumn("_hd", F.col("shift_date"))
    else:
        raise ValueError(f"holiday_match must be 'strict' or 'date', got {p.holiday_match!r}")
    inst = inst.join(hol, on=["company_id", "_hd"], how="left_anti").drop("_hd")
    return inst.select("company_id", "shift_id", "shift_name", "start_time", "end_time", "shift_date",
                       _at(F.col("shift_date"), F.col("start_time")).alias("shift_start"),
                       _at(F.col("shift_date"), F.col("end_time")).alias("shift_end"))


STATE_COLUMNS = ("downtime", "production_time", "setup_time")


def _state_sums(rows: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """Gap after each reading split by state (``sequences.STATES``), successors taken
    within ``keys``, summed per ``group`` (default ``keys``)."""
    hours = segment(rows, [*keys, *[g for g in group or () if g not in keys]], ["seq_bucket"], [STATES])
    return (close(hours, keys, [STATES], "seq_bucket").groupBy(*(group or keys))
            .agg(*[F.sum(c).alias(c) for c in STATES.sums]))


def _hours(keys: list[str]) -> list[Column]:
    return [*keys,
            hours_2dp(F.coalesce(F.col("down_us"), F.lit(0))).alias("downtime"),
            hours_2dp(F.coalesce(F.col("prod_us"), F.lit(0))).alias("production_time"),
            hours_2dp(F.coalesce(F.col("setup_us"), F.lit(0))).alias("setup_time")]


def _shift_states(t: Tables, p: Params) -> DataFrame:
    """Per machine and shift instance: state durations (zeros without data).

    The event-in-shift range join is binned by date (``plans.rangejoin``):
    readings, tagged with their machine's tenant, join the tenant's calendar
    on (tenant, date) with the time range as a residual filter -- a hash join
    against a small calendar, never a nested loop.  Successors are
    taken within the instance (device, shift, date), as in the reference;
    instances without readings keep zeros via the final left join.
    """
    cal = shift_calendar(t, p)
    owners = company_machines(t, p).select(F.col("machine_id").alias(DEV), "company_id")
    # Whole days of the range (a shift on the last date runs past the end).
    rows = tm.typed_in_days(t, p).select(DEV, "ts", "seq_bucket", "mc_text", "act_speed")
    windows = cal.select("company_id", "shift_date", "shift_id", "shift_start", "shift_end")
    hit = (range_join(rows.join(owners, on=DEV, how="inner"), windows,
                      on=["company_id"], ts="ts", start="shift_start", end="shift_end")
           .drop("shift_start", "shift_end", "company_id"))
    keys = [DEV, "shift_id", "shift_date"]
    sums = _state_sums(hit, keys)
    inst = owners.join(cal, on="company_id", how="inner")
    return inst.join(sums, on=keys, how="left")


def shift_timeframe(t: Tables, p: Params) -> DataFrame:
    """Hours per shift instance labelled with the shift date (midnight, ISO)."""
    j = _shift_states(t, p)
    label = iso_millis(F.col("shift_date").cast("timestamp_ntz")).alias("interval_key")
    return (j.select(F.col(DEV).alias("machine_id"), "shift_name", label, "shift_date",
                     "down_us", "prod_us", "setup_us")
            .select(*_hours(["machine_id", "shift_name", "interval_key", "shift_date"]))
            .orderBy("machine_id", "shift_name", "shift_date").drop("shift_date"))


def shift_timeframe_midpoint(t: Tables, p: Params) -> DataFrame:
    """Same hours, labelled with the midpoint of the shift's start and end."""
    j = _shift_states(t, p)
    half = (micros_between(F.col("shift_start"), F.col("shift_end")) / 2).cast("bigint")
    mid = F.timestamp_add("MICROSECOND", half, F.col("shift_start"))
    return (j.select(F.col(DEV).alias("machine_id"), "shift_name",
                     iso_millis(mid).alias("interval_key"), "shift_date",
                     "down_us", "prod_us", "setup_us")
            .select(*_hours(["machine_id", "shift_name", "interval_key", "shift_date"]))
            .orderBy("machine_id", "shift_name", "shift_date").drop("shift_date"))


# Interval names accepted by the time-frame request.
INTERVAL_UNITS = {"Hour": "hour", "Day": "day", "Week": "week", "Month": "month"}


def machine_time_frame(t: Tables, p: Params, interval: str) -> DataFrame:
    """The time-frame request: ``'Shift'`` gives hours per shift instance,
    a calendar name hours per Asia/Kolkata bucket.  Any other name yields a
    NULL bucket (one group per device), like a ``CASE`` without ``ELSE``."""
    if interval == "Shift":
        return shift_timeframe(t, p)
    return interval_timeframe(t, p, INTERVAL_UNITS.get(interval))


def interval_timeframe(t: Tables, p: Params, unit: str | None) -> DataFrame:
    """Hours per Asia/Kolkata calendar bucket.  Successors are taken within
    the local hour whatever the bucket (reference behaviour), so a gap that
    crosses an hour boundary is not counted even for day/week/month.
    ``unit=None`` puts every reading of a device in one NULL bucket."""
    if unit not in ("hour", "day", "week", "month", None):
        raise ValueError(f"unknown interval {unit!r}")
    rows = (telemetry(t, p).select(DEV, "ts", "seq_bucket", "mc_text", "act_speed")
            .withColumn("local", to_kolkata(F.col("ts"))))
    rows = rows.withColumn("local_hour", trunc_ntz("hour", F.col("local")))
    key = trunc_ntz(unit, F.col("local")) if unit else F.lit(None).cast("timestamp_ntz")
    rows = rows.withColumn("interval_key", key)
    # The sequence bucket (UTC hour) splits each local hour in two: the
    # window stays on the store's co-located buckets and neighbours are still
    # exact within the local hour.
    sums = _state_sums(rows, [DEV, "local_hour"], [DEV, "interval_key"])
    return (sums.select(*_hours([F.col(DEV).alias("machine_id"), "interval_key"]))
            .orderBy("machine_id", "interval_key"))

