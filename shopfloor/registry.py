"""Registered queries: one fleet-wide DataFrame per analytics / maintenance op.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables with the default parameters of FIXTURES.md §3 (the full
time range of the data, every tenant, every machine).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.operators import (alarms, catalog, maintenance, oee, overview, production, snapshot, status, timeframe,
                                 upkeep)
from shopfloor.params import DEFAULT, Params
from shopfloor.session import checkpoint_dir
from shopfloor.sources import dimensions
from shopfloor.sources.fixtures import Tables

Query = Callable[[SparkSession, str], DataFrame]


def tables_for(spark: SparkSession, sf_dir: str, store: str | None = None, rollup: str | None = None) -> Tables:
    """The model tables of a data directory; nothing is kept between queries,
    so each query sees the data as it is when it runs."""
    return Tables(spark, sf_dir, store, rollup)


# One tenant, one machine: the scoped variants of fleet-wide queries.
TENANT = DEFAULT.with_(company="1")
MACHINE = DEFAULT.with_(company="1", machine_uid="M1", device="1")
SCOPED = {
    "machine_status": status.machine_status,
    "machine_status_latest": status.machine_status_latest,
    "machine_production": production.machine_production,
    "oee_company": oee.oee_company,
    "oee_device": oee.oee_device,
    "production_idle_time": timeframe.production_idle_time,
    "shift_timeframe": timeframe.shift_timeframe,
    "alarm_breakdowns": alarms.alarm_breakdowns,
    "alarm_reliability": alarms.alarm_reliability,
}


def _q(fn, *args, params: Params = DEFAULT, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tables_for(spark, sf_dir), params, *args, **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


# Metrics answered from a rollup of minutes.
ROLLED_UP = {
    "availability": (oee.availability,),
    "oee_company": (oee.oee_company,),
    "oee_by_period_day": (oee.oee_by_period, "day"),
    "oee_by_interval_hour": (oee.oee_by_interval, "hour"),
    "production_idle_time": (timeframe.production_idle_time,),
    "machine_production": (production.machine_production,),
}


def _from_rollup(fn, *args) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The readings arrive in two batches, every third reading late, so most
        minutes of the second batch are already stored."""
        raw = tables_for(spark, sf_dir).device_data
        late = F.pmod(F.xxhash64("data"), F.lit(3)) == 0
        path = _scratch(spark, "rollup")
        oee.append_rollup(raw.where(~late), raw.where(~late), path, 1)
        oee.append_rollup(raw.where(late), raw, path, 2)
        return fn(tables_for(spark, sf_dir, rollup=path), DEFAULT, *args)
    return run


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(table: str, change) -> Query:
    """A maintenance job as a write: the table is stored, the batch applied twice, and
    what is stored then is read."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables_for(spark, sf_dir)
        path = _scratch(spark, table)
        dimensions.publish(getattr(t, table), path, 0)
        for _ in range(2):
            dimensions.apply(spark, path, 1, lambda old: change(t, old))
        return dimensions.read(spark, path)
    return run


def _append(t: Tables, old: DataFrame) -> DataFrame:
    return maintenance.append_validated(old, t.support_requests, upkeep.REQUEST_REQUIRED)[0]


def _update(t: Tables, old: DataFrame) -> DataFrame:
    return maintenance.update_by_key(old, t.user_edits, "user_id", upkeep.USER_EDIT_COLUMNS, order="request_no")[0]


def _delete(t: Tables, old: DataFrame) -> DataFrame:
    return maintenance.delete_by_key(old, t.operator_deletes, "operator_id")


def _from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status from a snapshot that got the readings in three batches, newest first."""
    t = tables_for(spark, sf_dir)
    path = _scratch(spark, "snapshot")
    part = F.pmod(F.xxhash64("data"), F.lit(3))
    for number in (1, 2, 3):
        snapshot.add(spark, path, number, t.device_data.where(part == 3 - number))
    return snapshot.machine_status_latest(t, DEFAULT, path)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "availability": _q(oee.availability),
        "actual_weight": _q(oee.actual_weight),
        "target_weight": _q(oee.target_weight),
        "oee_company": _q(oee.oee_company),
        "oee_device": _q(oee.oee_device),
        "oee_device_rounded": _q(oee.oee_device_rounded),
    }
    for u in ("hour", "day", "week", "month"):
        out[f"oee_by_period_{u}"] = _q(oee.oee_by_period, u)
        out[f"oee_by_interval_{u}"] = _q(oee.oee_by_interval, u)
    out.update({
        "machine_lookup": _q(catalog.machine_lookup),
        "machine_record": _q(catalog.machine_record),
        "machine_catalog": _q(catalog.machine_catalog),
        "machine_status": _q(status.machine_status),
        "machine_status_latest": _q(status.machine_status_latest),
        "monthly_production": _q(production.monthly_production),
        "reel_transitions": _q(production.reel_transitions),
        "machine_production": _q(production.machine_production),
        "company_overview": _q(overview.company_overview),
        "company_overview_oee": _q(overview.company_overview_oee),
        "machine_complete": _q(overview.machine_complete),
        "holiday_list": _q(catalog.holiday_list),
        "shift_roster": _q(catalog.shift_roster),
        "user_company_profile": _q(catalog.user_company_profile),
        "user_company_profile_left": _q(catalog.user_company_profile, how="left"),
        "operators_by_machine": _q(catalog.operators_by_machine),
        "notification_rules": _q(catalog.notification_rules),
        "production_idle_time": _q(timeframe.production_idle_time),
        "shift_calendar": _q(timeframe.shift_calendar),
        "shift_timeframe": _q(timeframe.shift_timeframe),
        "shift_timeframe_midpoint": _q(timeframe.shift_timeframe_midpoint),
        "alarm_breakdowns": _q(alarms.alarm_breakdowns),
        "alarm_reliability": _q(alarms.alarm_reliability),
        "alarm_intervals": _q(alarms.alarm_intervals),
    })
    for name, (fn, *args) in ROLLED_UP.items():
        out[f"rollup_{name}"] = _from_rollup(fn, *args)
    for u in ("hour", "day", "week", "month"):
        out[f"interval_timeframe_{u}"] = _q(timeframe.interval_timeframe, u)
    for name, fn in SCOPED.items():
        out[f"{name}_tenant"] = _q(fn, params=TENANT)
        out[f"{name}_machine"] = _q(fn, params=MACHINE)
    out["stored_append"] = _stored("customer_support", _append)
    out["stored_update"] = _stored("user_info", _update)
    out["stored_delete"] = _stored("operators", _delete)
    out["snapshot_status_latest"] = _from_snapshot
    out["machine_complete_nested"] = _q(overview.machine_complete_nested)
    out["machine_catalog_json"] = _q(catalog.machine_catalog_json)
    for name in ("append_validated", "append_rejects", "update_by_key", "update_unmatched",
                 "delete_by_key", "insert_if_absent", "insert_if_absent_rejects", "update_if_unique",
                 "update_if_unique_rejects", "update_if_unique_unmatched", "update_if_unique_accepted",
                 "apply_log", "apply_log_rejects", "get_or_create_dim",
                 "update_guarded", "update_guarded_parts", "update_guarded_types", "update_guarded_rejects",
                 "add_machine", "add_machine_parts", "add_machine_types", "reconcile_set", "reconcile_set_counts"):
        out[name] = _q(getattr(upkeep, name))
    return out
