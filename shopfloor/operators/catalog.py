"""Dimension lookups: machines, images, calendar, people, stored rules
(M1, M2, M26-M30).

All are scans of dimension tables with key filters and joins to other
dimensions; the optional tenant / machine filters in ``Params`` are the
reference's tenant guard, ``None`` lists every tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.params import Params
from shopfloor.sources.fixtures import Tables
from shopfloor.sources.sinks import json_rows

CATALOG_COLUMNS = (
    "machine_uid", "machine_id", "machine_name", "machine_plant", "machine_model",
    "machine_customer", "machine_location", "machine_longitude", "machine_latitude",
    "machine_type_name", "company_id",
)


def _tenant(df: DataFrame, p: Params, col: str = "company_id") -> DataFrame:
    return df if p.company is None else df.where(F.col(col) == F.lit(p.company))


def machine_lookup(t: Tables, p: Params) -> DataFrame:
    """``machine_uid`` -> ``machine_id`` inside a tenant (the guard every
    per-device request runs first)."""
    m = _tenant(t.machine, p)
    if p.machine_uid is not None:
        m = m.where(F.col("machine_uid") == F.lit(p.machine_uid))
    return m.select("machine_uid", "machine_id", "company_id")


def machine_record(t: Tables, p: Params) -> DataFrame:
    """v1 lookup: every column of the machine, by uid only (no tenant guard)."""
    m = t.machine
    if p.machine_uid is not None:
        m = m.where(F.col("machine_uid") == F.lit(p.machine_uid))
    return m.select("*")


def first_image(t: Tables) -> DataFrame:
    """Image of the lowest part id per machine (``ORDER BY id LIMIT 1``)."""
    return (t.machine_parts.groupBy(F.col("machine_id").alias("machine_uid"))
            .agg(F.min_by("machine_image_path", "machine_part_id").alias("model_data")))


def machine_catalog(t: Tables, p: Params) -> DataFrame:
    """Machines with their type name and first part image ('' when none)."""
    m = _tenant(t.machine, p)
    if p.machine_uid is not None:
        m = m.where(F.col("machine_uid") == F.lit(p.machine_uid))
    m = m.join(t.machine_type, on="machine_type_id", how="inner")
    return (m.join(first_image(t), on="machine_uid", how="left")
            .select(*CATALOG_COLUMNS, F.coalesce(F.col("model_data"), F.lit("")).alias("model_data")))


def holiday_day(text: Column) -> Column:
    """Date of a stored holiday: plain ``YYYY-MM-DD`` or an ISO date-time
    ending in ``Z``."""
    # Plain dates first: most rows parse without the failing ISO attempt.
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
    return F.to_date(parsed)


def holiday_list(t: Tables, p: Params) -> DataFrame:
    """Holidays shown as DD/MM/YYYY, in date order."""
    h = _tenant(t.holidays, p)
    day = holiday_day(F.col("holiday_date"))
    return (h.select("holiday_id", "holiday_name",
                     F.date_format(day, "dd/MM/yyyy").alias("holiday_date"),
                     "holiday_image", "created_by", "company_id", day.alias("_day"))
            .orderBy("_day", "holiday_id").drop("_day"))


def shift_roster(t: Tables, p: Params) -> DataFrame:
    """Shifts with the first / last name of the user who created them."""
    s = _tenant(t.shifts, p)
    u = t.user_info.select(F.col("user_id").alias("created_by"), "first_name", "last_name")
    return s.join(u, on="created_by", how="inner").select(
        "shift_id", "shift_name", "start_time", "end_time", "shift_days",
        "first_name", "last_name", "company_id")


def user_company_profile(t: Tables, p: Params, how: str = "inner") -> DataFrame:
    """User profile joined to the company record (no credential columns).
    ``how='left'`` is the two-step lookup that keeps users without a company."""
    u = _tenant(t.user_info, p)
    return u.join(t.company_info, on="company_id", how=how).select(
        "user_id", "first_name", "last_name", "personal_email", "designation", "company_id",
        "verified", "block", "company_name", "company_email", "contact_no", "location")


def operators_by_machine(t: Tables, p: Params) -> DataFrame:
    o = _tenant(t.operators, p)
    if p.machine_uid is not None:
        o = o.where(F.col("machine_id") == F.lit(p.machine_uid))
    return o.select("operator_id", "operator_name", "machine_id", "created_by", "company_id")


def notification_rules(t: Tables, p: Params) -> DataFrame:
    """Stored alert rules; the JSON parameters are returned as stored."""
    r = t.notification_configuration
    if p.machine_uid is not None:
        r = r.where(F.col("machine_id") == F.lit(p.machine_uid))
    if p.company is not None:
        ids = _tenant(t.machine, p).select(F.col("machine_uid").alias("machine_id"))
        r = r.join(ids, on="machine_id", how="left_semi")
    return r.select("config_id", "warning_name", "machine_id", "parameters")


def machine_catalog_json(t: Tables, p: Params) -> DataFrame:
    """The catalog as one JSON document per machine (result delivery)."""
    return json_rows(machine_catalog(t, p), key="machine_uid")
