"""Alarm breakdowns and reliability figures (M23, M24).

Alarm codes are payload keys named by a dimension table, so the reference
crosses every reading with every alarm and looks the key up by name.  Here the
payload map is filtered by the alarm table's codes, and only alarms actually
present in a reading produce a row.  Runs of one status (``alarm_runs``) are built
once; all figures are sums over runs.  Figures that depend on *absent* keys are
recovered from counts instead of materialising the absent pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from shopfloor.functions.numeric import hours_2dp, micros_between, ratio_half_up
from shopfloor.operators.oee import company_machines, telemetry
from shopfloor.params import Params
from shopfloor.sources.fixtures import Tables
from shopfloor.sources.telemetry import bounds

DEV = "deviceuid"


def alarm_runs(t: Tables, p: Params) -> DataFrame:
    """Runs of consecutive readings (within an hour) in which an alarm keeps its value.

    Columns: device, ``alarm_code`` (null: the run is of the readings themselves),
    ``alarm_status``, ``started`` and ``last`` reading, ``until`` (the reading after
    the run; null at the end of the history), ``n`` readings, ``gap_us`` and
    ``running_us`` (time to the next reading, all of it and while the machine runs),
    ``open`` / ``open_running`` (readings without a successor).

    The payload is read once, for the codes of the alarm table; a reading becomes a
    row per alarm it carries and one for itself. Neighbours are taken inside the hour;
    the one pair that leaves an hour is added between the hours' runs, a handful of
    rows per device and hour however many readings there are.
    """
    codes = t.alarms.agg(F.collect_set("alarm_code")).scalar()
    rows = telemetry(t, p).select(DEV, "ts", "seq_bucket", "mc_text", "payload_map", codes.alias("codes"))
    carried = F.map_entries(F.map_filter("payload_map", lambda k, v: v.isNotNull() & F.array_contains("codes", k)))
    none = F.lit(None).cast("string")
    itself = F.array(F.struct(none.alias("alarm_code"), none.alias("alarm_status")))
    alarms = F.transform(carried, lambda e: F.struct(e["key"].alias("alarm_code"), e["value"].alias("alarm_status")))
    rows = rows.select(DEV, "ts", "seq_bucket", "mc_text", F.concat(itself, alarms).alias("pairs"))
    hour = Window.partitionBy(DEV, "seq_bucket").orderBy("ts", "mc_text")
    rows = (rows.withColumn("next_ts", F.lead("ts").over(hour))
            .select(DEV, "ts", "seq_bucket", "next_ts", (F.col("mc_text") == "1").alias("running"), F.inline("pairs")))

    of_alarm = Window.partitionBy(DEV, "seq_bucket", "alarm_code").orderBy("ts", "alarm_status")
    goes_on = (F.lag("alarm_status").over(of_alarm).eqNullSafe(F.col("alarm_status"))
               & (F.lag("next_ts").over(of_alarm) == F.col("ts")))
    rows = rows.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("begins").over(of_alarm.rowsBetween(Window.unboundedPreceding, 0)))
    gap = micros_between(F.col("ts"), F.col("next_ts"))
    at_end = F.col("next_ts").isNull()
    runs = rows.groupBy(DEV, "seq_bucket", "alarm_code", "run").agg(
        F.min("alarm_status").alias("alarm_status"), F.min("ts").alias("started"), F.max("ts").alias("last"),
        F.max(F.when(~at_end, F.col("next_ts"))).alias("inner_until"), F.count(F.lit(1)).alias("n"),
        F.sum(gap).alias("gap_us"), F.sum(F.when(F.col("running"), gap)).alias("running_us"),
        F.count_if(at_end).alias("ends"), F.count_if(at_end & F.col("running")).alias("ends_running"))

    after = F.expr("lead(CASE WHEN alarm_code IS NULL THEN started END) IGNORE NULLS "
                   "OVER (PARTITION BY deviceuid ORDER BY seq_bucket, alarm_code NULLS FIRST, run)")
    runs = runs.withColumn("next_hour", after)
    leaves = (F.col("ends") > 0) & F.col("next_hour").isNotNull()
    leap = F.when(leaves, micros_between(F.col("last"), F.col("next_hour")))
    plus = lambda c, x: F.coalesce(F.col(c) + x, F.col(c), x)
    stays = (F.col("ends") > 0) & F.col("next_hour").isNull()
    return runs.select(
        DEV, "alarm_code", "alarm_status", "started", "last",
        F.when(F.col("ends") > 0, F.col("next_hour")).otherwise(F.col("inner_until")).alias("until"), "n",
        plus("gap_us", leap).alias("gap_us"),
        plus("running_us", F.when(F.col("ends_running") > 0, leap)).alias("running_us"),
        F.when(stays, F.col("ends")).otherwise(0).alias("open"),
        F.when(stays, F.col("ends_running")).otherwise(0).alias("open_running"))


def _of_alarm() -> WindowSpec:
    return Window.partitionBy(DEV, "alarm_code").orderBy("started", "last")


def _by_carriers(runs: DataFrame) -> DataFrame:
    """Runs of alarms with the status before and the start after, over the readings
    that carry the alarm; a status must be integer text (other text raises)."""
    return (runs.where(F.col("alarm_code").isNotNull())
            .where(F.col("alarm_status").cast("int").isNotNull())
            .withColumn("before", F.lag("alarm_status").over(_of_alarm()))
            .withColumn("next_started", F.lead("started").over(_of_alarm())))


def alarm_intervals(t: Tables, p: Params) -> DataFrame:
    """Per machine and alarm the periods of one status: from its first reading to the
    next reading that carries another status (the last one that carries the alarm, at
    the end), and the number of readings."""
    runs = _by_carriers(alarm_runs(t, p))
    new = F.when(F.col("before").eqNullSafe(F.col("alarm_status")), 0).otherwise(1)
    runs = runs.withColumn("new", new)
    runs = runs.withColumn("no", F.sum("new").over(_of_alarm().rowsBetween(Window.unboundedPreceding, 0)))
    return (runs.groupBy(DEV, "alarm_code", "no", "alarm_status")
            .agg(F.min("started").alias("started"),
                 F.max(F.coalesce("next_started", "last")).alias("ended"), F.sum("n").alias("readings"))
            .select(F.col(DEV).alias("machine_id"), "alarm_code", "alarm_status", "started", "ended", "readings"))


def alarm_breakdowns(t: Tables, p: Params) -> DataFrame:
    """Per machine and alarm: number of 0->1 flips, hours spent at '1', and
    the share of all flips / hours of the machine (rounded to integers).
    Neighbours are taken per alarm over the readings that carry it."""
    runs = _by_carriers(alarm_runs(t, p))
    on = F.col("alarm_status") == "1"
    flip = F.when((F.col("before") == "0") & on, 1).otherwise(0)
    spent = F.when(on, micros_between(F.col("started"), F.coalesce("next_started", "last"))).otherwise(0)
    agg = (runs.groupBy(DEV, "alarm_code").agg(F.sum(flip).alias("count"), F.sum(spent).alias("dur_us"))
           .where(F.col("count") > 0)
           .join(t.alarms.select("alarm_code", "alarm_description"), on="alarm_code", how="inner"))
    w = Window.partitionBy(DEV)
    agg = (agg.withColumn("total_count", F.sum("count").over(w))
           .withColumn("total_us", F.sum("dur_us").over(w)))
    return agg.select(
        F.col(DEV).alias("machine_id"), "alarm_code", "alarm_description",
        F.col("count").cast("bigint").alias("count"),
        F.coalesce(hours_2dp(F.col("dur_us")), F.lit(0.0)).alias("duration"),
        ratio_half_up(F.col("count") * 100, F.col("total_count"), 0).alias("cumulative_percent_count"),
        ratio_half_up(F.col("dur_us") * 100, F.col("total_us"), 0).alias("cumulative_percent_duration"))


def total_days(t: Tables, p: Params) -> Column:
    """``EXTRACT(DAY FROM end - start) + 1`` (whole days, toward zero)."""
    start, end = bounds(t, p)
    return F.timestamp_diff("DAY", start, end) + 1


def alarm_reliability(t: Tables, p: Params) -> DataFrame:
    """Per machine: flips per day, alarm-active seconds per day, mean running
    seconds without the alarm between flips, mean active seconds per flip.

    Every reading is paired with every alarm in the reference; a pair whose
    alarm is absent contributes only to the running time.  So the running
    time is ``A * (running gaps) - (running gaps of present pairs)`` with
    ``A`` the number of alarms, and SQL NULL rules of the sums are kept by
    counting the contributing pairs.  A flip needs the value '0' in the reading
    just before: the previous run of the alarm ends where this one starts.
    """
    n_alarms = t.alarms.select(F.count(F.lit(1))).scalar()
    runs = (alarm_runs(t, p).withColumn("before", F.lag("alarm_status").over(_of_alarm()))
            .withColumn("before_until", F.lag("until").over(_of_alarm())))
    reading, pair = F.col("alarm_code").isNull(), F.col("alarm_code").isNotNull()
    one = pair & (F.col("alarm_status") == "1")
    of = lambda rows, c: F.coalesce(F.sum(F.when(rows, F.col(c))), F.lit(0))
    flip = one & (F.col("before") == "0") & (F.col("before_until") == F.col("started"))
    d = runs.groupBy(DEV).agg(
        of(reading, "n").alias("n_rows"), of(reading, "running_us").alias("run_gap"),
        of(reading, "open_running").alias("n_last_run"), of(one, "n").alias("n_one"), of(one, "open").alias("n_one_open"),
        of(one, "gap_us").alias("active_us"), of(pair, "running_us").alias("present_run_gap"),
        of(pair, "open_running").alias("present_last_run"), F.count_if(flip).alias("flips"))
    pairs_total = F.col("n_rows") * n_alarms
    active = F.when(pairs_total - F.col("n_one_open") > 0, F.col("active_us"))
    uptime_nulls = F.col("n_last_run") * n_alarms - F.col("present_last_run")
    uptime = F.when(pairs_total - uptime_nulls > 0, F.col("run_gap") * n_alarms - F.col("present_run_gap"))
    per_dev = d.select(DEV, "flips", active.alias("active_us"), uptime.alias("uptime_us"))

    # below the join, so that the subqueries of the range are planned once
    days = F.col("days")
    m = company_machines(t, p).select("machine_uid", F.col("machine_id").alias(DEV), total_days(t, p).alias("days"))
    out = m.join(per_dev, on=DEV, how="left")
    flips = F.coalesce(F.col("flips"), F.lit(0))
    return out.select(
        "machine_uid", F.col(DEV).alias("machine_id"),
        ratio_half_up(flips, days, 2).alias("mean_alarm_count_per_day"),
        ratio_half_up(F.col("active_us"), days * 1_000_000, 2).alias("mean_alarm_duration_per_day"),
        ratio_half_up(F.col("uptime_us"), flips * 1_000_000, 2).alias("mean_time_between_alarms"),
        ratio_half_up(F.col("active_us"), flips * 1_000_000, 2).alias("mean_time_to_restart_on_alarm"))
