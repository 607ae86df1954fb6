"""Availability, produced / ideal wire weight and OEE (M10-M17).

Every variant is one pass over the readings: each is parsed once, for the
keys the variant needs, and falls into one row per (device, minute) -- status
counts, the span and top speed of the readings with a line speed, the
diameters, and the drawn weight as a mergeable segment (``plans.segments``).
Days, periods and devices are sums of minutes:

* availability is a ratio of sums over minutes;
* the actual weight turns a line speed into a length by the gap to the next
  reading, inside the minute or in the device's next one;
* the target weight multiplies an ideal length by the weight factor of every
  distinct wire diameter.

``minutes_of`` is also what ``sources.rollup`` stores and appends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions.numeric import micros_between, round_half_up, to_minutes, wire_weight
from shopfloor.functions.timefmt import interval_label, period_label, trunc_ntz
from shopfloor.operators.sequences import ACTIVITY, DRAWN, REELS, SPEED
from shopfloor.params import Params
from shopfloor.plans.segments import close, segment
from shopfloor.sources import rollup, telemetry as tm
from shopfloor.sources.fixtures import Tables

DEV = "deviceuid"


def _f(c) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def _nullif0(c: Column) -> Column:
    return F.when(c != 0, c)


def company_machines(t: Tables, p: Params) -> DataFrame:
    m = t.machine
    if p.company is not None:
        m = m.where(F.col("company_id") == F.lit(p.company))
    if p.machine_uid is not None:
        m = m.where(F.col("machine_uid") == F.lit(p.machine_uid))
    if p.device is not None:
        m = m.where(F.col("machine_id") == F.lit(p.device))
    return m


def telemetry(t: Tables, p: Params) -> DataFrame:
    """Typed telemetry in range, restricted to the requested tenant's devices."""
    base = tm.typed_in_range(t, p)
    if p.company is not None or p.machine_uid is not None:
        ids = company_machines(t, p).select(F.col("machine_id").alias(DEV))
        base = base.join(ids, on=DEV, how="left_semi")
    return base


# --------------------------------------------------------------------------
# One row per (device, minute)
# --------------------------------------------------------------------------

SEQUENCES = (SPEED, DRAWN, ACTIVITY, REELS)


def minutes_of(base: DataFrame, sequences=SEQUENCES) -> DataFrame:
    """Readings to (device, minute) rows: status counts, readings with a line speed,
    diameters, months' counter, and the ends and inner sums of the given sequences. A
    query's columns are all that is parsed, sorted and summed."""
    mc, both = F.col("has_mc"), F.col("has_mc") & F.col("has_line_speed")
    up, down = F.col("mc_status") == 1, F.col("mc_status") == 0
    # seq_bucket is implied by the minute; grouping by it too lets the store's
    # (device, seq_bucket) buckets be read unshuffled.
    return segment(base.withColumn("minute", trunc_ntz("minute", F.col("ts"))), [DEV], ["seq_bucket", "minute"], sequences, [
        F.count_if(mc).alias("n"), F.count_if(mc & up).alias("up"), F.count_if(mc & down).alias("down"),
        F.count_if(both).alias("n_ls"), F.count_if(both & up).alias("up_ls"),
        F.min(F.when(both, F.col("ts"))).alias("first_ls"), F.max(F.when(both, F.col("ts"))).alias("last_ls"),
        F.max(F.when(both, F.col("line_speed"))).alias("vmax"),
        F.count_if(F.col("has_line_speed")).alias("n_speed"), F.count_if(F.col("has_diameter")).alias("n_dia"),
        F.collect_set(F.when(F.col("has_diameter"), F.col("diameter"))).alias("diameters"),
        F.count_if(F.col("has_month_production")).alias("n_prod"),
        F.max("month_production").alias("prod_max"), F.min("month_production").alias("prod_min")])


def rollup_rows(device_data: DataFrame) -> DataFrame:
    """Rows of a rollup from raw readings (see ``sources.rollup``)."""
    return minutes_of(tm.typed(tm.parse(device_data)))


def append_rollup(batch: DataFrame, readings: DataFrame, path: str, number: int) -> None:
    """Add a batch of raw readings to the rollup at ``path``."""
    rollup.append(batch, readings, path, number, rollup_rows)


def minutes(t: Tables, p: Params, *sequences) -> DataFrame:
    """The minutes of the request with the given sequences, from the caller's rollup if
    there is one."""
    if getattr(t, "rollup", None) is None:
        return minutes_of(telemetry(t, p), sequences)
    m = rollup.minutes_in_range(t, p)
    if p.company is not None or p.machine_uid is not None:
        m = m.join(company_machines(t, p).select(F.col("machine_id").alias(DEV)), on=DEV, how="left_semi")
    return m


def _set(name: str) -> Column:
    """Union of the rows' arrays."""
    return F.array_distinct(F.flatten(F.collect_list(name))).alias(name)


def _share(of: str, among: str) -> Column:
    return F.when(F.col(among) > 0, _f(of) / _f(among))


def _span() -> Column:
    return to_minutes(micros_between(F.col("first_ls"), F.col("last_ls")))


def _days(m: DataFrame) -> DataFrame:
    """Minutes to days per device: shares, ideal lengths at minute grain (scaled by the
    day's top speed) and at day grain, weight, diameters."""
    vmax, share = F.max("vmax"), F.sum("up_ls") / F.sum("n_ls")
    span = to_minutes(micros_between(F.min("first_ls"), F.max("last_ls")))
    return (m.groupBy(DEV, F.to_date("minute").alias("day"))
            .agg(F.sum(_share("up", "n")).alias("su"), F.sum(_share("down", "n")).alias("sd"),
                 (vmax * F.sum(_share("up_ls", "n_ls") * _span())).alias("minute_length"),
                 F.when(F.sum("n_ls") > 0, share * vmax * span).alias("day_length"),
                 F.sum("weight").alias("weight"),
                 F.sum("n_speed").alias("n_speed"), F.sum("n_dia").alias("n_dia"), _set("diameters")))


def _target(length: str) -> Column:
    """``Σ over distinct diameters of W(d, length)``; a null diameter weighs nothing."""
    return F.aggregate("diameters", F.lit(0.0), lambda acc, d: acc + wire_weight(d, F.col(length)))


def _availability(su: str = "su", sd: str = "sd") -> Column:
    """``Σ(up/n) / NULLIF(Σ(up/n) + Σ(down/n), 0) * 100``"""
    return F.col(su) / _nullif0(F.col(su) + F.col(sd)) * 100.0


def _devices(t: Tables, p: Params) -> DataFrame:
    return (_days(close(minutes(t, p, SPEED), [DEV], [SPEED], "minute")).groupBy(DEV)
            .agg(F.sum("su").alias("su"), F.sum("sd").alias("sd"), F.sum("minute_length").alias("minute_length"),
                 F.sum("day_length").alias("day_length"), F.sum("weight").alias("weight"),
                 F.sum("n_speed").alias("n_speed"), F.sum("n_dia").alias("n_dia"), _set("diameters")))


# --------------------------------------------------------------------------
# Availability (M10), actual weight (M11), target weight (M12)
# --------------------------------------------------------------------------

def availability(t: Tables, p: Params) -> DataFrame:
    a = (minutes(t, p).where(F.col("n") > 0).groupBy(DEV)
         .agg(F.sum(_share("up", "n")).alias("su"), F.sum(_share("down", "n")).alias("sd")))
    return a.select(F.col(DEV).alias("machine_id"), round_half_up(_availability(), 6).alias("availability"))


def actual_weight(t: Tables, p: Params) -> DataFrame:
    """Devices with two readings that carry a line speed."""
    return (_devices(t, p).where("n_speed > 1")
            .select(F.col(DEV).alias("machine_id"),
                    round_half_up(F.coalesce("weight", F.lit(0.0)), 6).alias("actual_weight")))


def target_weight(t: Tables, p: Params) -> DataFrame:
    """Devices with an ideal length and a diameter."""
    return (_devices(t, p).where("minute_length is not null and n_dia > 0")
            .select(F.col(DEV).alias("machine_id"),
                    round_half_up(_target("minute_length"), 6).alias("target_weight")))


# --------------------------------------------------------------------------
# OEE per machine (M13 safe form, M14 device form, M15 rounded form)
# --------------------------------------------------------------------------

def _per_device(t: Tables, p: Params, grain: str) -> DataFrame:
    """Per device: availability, target weight, actual weight."""
    length = f"{grain}_length"
    return _devices(t, p).select(
        DEV, _availability().alias("availability"), F.col("weight").alias("actual_weight"),
        F.when(F.col(length).isNotNull(), _target(length)).alias("target_weight"))


def _join_machines(t: Tables, p: Params, per_device: DataFrame) -> DataFrame:
    m = company_machines(t, p).select("machine_uid", "machine_id")
    return m.join(per_device.withColumnRenamed(DEV, "machine_id"), on="machine_id", how="left")


def oee_company(t: Tables, p: Params, grain: str = "minute") -> DataFrame:
    """Per machine of the tenant (all machines when ``p.company`` is None)."""
    j = _join_machines(t, p, _per_device(t, p, grain))
    a = F.coalesce(F.col("availability"), F.lit(0.0))
    act = F.coalesce(F.col("actual_weight"), F.lit(0.0))
    tgt = F.coalesce(F.col("target_weight"), F.lit(0.0))
    perf = F.when(tgt == 0, F.lit(0.0)).otherwise(act / _nullif0(tgt) * 100.0)
    if grain == "minute":
        quality = F.when(act == 0, F.lit(100.0)).otherwise(act / _nullif0(act) * 100.0)
    else:
        quality = F.lit(100.0)
    oee = F.when((a == 0) | (tgt == 0) | (act / _nullif0(tgt) == 0), F.lit(0.0)) \
        .otherwise(a * (act / _nullif0(tgt)))
    r6 = lambda c: round_half_up(c, 6)
    return j.select("machine_uid", "machine_id",
                    r6(a).alias("availability"), r6(act).alias("actual_weight"),
                    r6(tgt).alias("target_weight"), r6(perf).alias("performance"),
                    r6(quality).alias("quality"), r6(oee).alias("oee"))


def oee_device(t: Tables, p: Params) -> DataFrame:
    """Device form: target at day grain, quality fixed at 100, zero target -> 0."""
    return oee_company(t, p, grain="day")


def oee_device_rounded(t: Tables, p: Params) -> DataFrame:
    """One-row summary per machine, two decimals; availability stays NULL
    when the machine sent no status in range."""
    j = _join_machines(t, p, _per_device(t, p, "minute"))
    a = F.col("availability")
    act = F.coalesce(F.col("actual_weight"), F.lit(0.0))
    tgt = F.coalesce(F.col("target_weight"), F.lit(0.0))
    perf_raw = F.when(tgt == 0, F.lit(0.0)).otherwise(act / _nullif0(tgt) * 100.0)
    r2 = lambda c: round_half_up(c, 2)
    return j.select(
        "machine_uid", "machine_id",
        F.when((a == 0) | (perf_raw == 0), F.lit(0.0)).otherwise(r2(a * perf_raw / 100.0)).alias("oee"),
        r2(a).alias("availability"),
        F.when(tgt == 0, F.lit(0.0)).otherwise(r2(act / _nullif0(tgt) * 100.0)).alias("performance"),
        F.when(act == 0, F.lit(100.0)).otherwise(r2(act / _nullif0(act) * 100.0)).alias("quality"),
    )


# --------------------------------------------------------------------------
# OEE per calendar period (M16) and per interval (M17)
# --------------------------------------------------------------------------

def _oee_ratios(keys: list[Column], a: Column, act: Column, tgt: Column, quality: Column, oee: Column) -> list[Column]:
    r6 = lambda c: round_half_up(c, 6)
    return [*keys, r6(a).alias("availability"), r6(act).alias("actual_weight"), r6(tgt).alias("target_weight"),
            r6(F.when(tgt == 0, F.lit(0.0)).otherwise(act / _nullif0(tgt) * 100.0)).alias("performance"),
            quality.alias("quality"), r6(oee).alias("oee")]


def oee_by_period(t: Tables, p: Params, unit: str) -> DataFrame:
    """Per device and ``unit`` period; the gap after a reading is charged to
    that reading's period, the target span is the period's first to last
    reading.  With a zero target OEE is NULL unless availability is 0."""
    m = close(minutes(t, p, SPEED), [DEV], [SPEED], "minute").withColumn("period", period_label(unit, F.col("minute")))
    g = (m.groupBy(DEV, "period", F.to_date("minute").alias("day"))
         .agg(*[F.sum(c).alias(c) for c in ("n", "up", "down", "n_ls", "up_ls", "weight")],
              F.min("first_ls").alias("first_ls"), F.max("last_ls").alias("last_ls"), F.max("vmax").alias("vmax"), _set("diameters"))
         .groupBy(DEV, "period")
         .agg(*[F.sum(c).alias(c) for c in ("n", "up", "down", "n_ls", "up_ls", "weight")],
              F.min("first_ls").alias("first_ls"), F.max("last_ls").alias("last_ls"), F.max("vmax").alias("vmax"), _set("diameters"))
         .where(F.col("n") > 0)
         .select(DEV, "period", "diameters", "weight", _share("up", "n").alias("su"), _share("down", "n").alias("sd"),
                 (_share("up_ls", "n_ls") * F.col("vmax") * _span()).alias("length")))
    a = F.coalesce(_availability(), F.lit(0.0))
    act = F.coalesce(F.col("weight"), F.lit(0.0))
    tgt = F.coalesce(_target("length"), F.lit(0.0))
    ratio = act / _nullif0(tgt)
    quality = round_half_up(F.when(act == 0, F.lit(100.0)).otherwise(act / _nullif0(act) * 100.0), 6)
    oee = F.when((a == 0) | (ratio == 0), F.lit(0.0)).otherwise(a * ratio)
    return g.select(*_oee_ratios([F.col(DEV).alias("machine_id"), F.col("period")], a, act, tgt, quality, oee))


def oee_by_interval(t: Tables, p: Params, unit: str) -> DataFrame:
    """Per device and ``unit`` interval; successors only within the interval,
    target = same gaps at the interval's top line speed (performance <= 100)."""
    m = minutes(t, p, DRAWN).withColumn("interval", interval_label(unit, F.col("minute")))
    g = (close(m, [DEV, "interval"], [DRAWN], "minute").groupBy(DEV, "interval")
         .agg(*[F.sum(c).alias(c) for c in ("n", "up", "down", "drawn_weight", "unit_weight")],
              F.max("drawn_top").alias("drawn_top"))
         .where(F.col("n") > 0)
         .select(DEV, "interval", "drawn_weight", "unit_weight", "drawn_top", _share("up", "n").alias("su"), _share("down", "n").alias("sd")))
    a = F.coalesce(_availability(), F.lit(0.0))
    act = F.coalesce(F.col("drawn_weight"), F.lit(0.0))
    tgt = F.coalesce(F.col("unit_weight") * F.col("drawn_top"), F.lit(0.0))
    oee = F.when((a == 0) | (tgt == 0) | (act == 0), F.lit(0.0)).otherwise(a * (act / _nullif0(tgt)))
    return (g.select(*_oee_ratios([F.col(DEV).alias("machine_id"), F.col("interval")], a, act, tgt, F.lit(100.0), oee))
            .orderBy("machine_id", "interval"))
