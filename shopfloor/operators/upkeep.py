"""Maintenance jobs over the model tables: each applies one derived change
set (``sources.fixtures.CHANGES``) with a T1-T8 operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopfloor.operators import maintenance as mt
from shopfloor.params import Params
from shopfloor.sources.fixtures import Tables

# Required request fields, as the reference validates them.
REQUEST_REQUIRED = ("request_subject", "division", "product_family", "machine_brand",
                    "type_of_request", "created_by", "machine_uid")
HOLIDAY_REQUIRED = ("holiday_name", "holiday_date", "company_id")
USER_EDIT_COLUMNS = ("first_name", "last_name", "designation")
HOLIDAY_EDIT_COLUMNS = ("holiday_name", "holiday_date", "holiday_image", "created_by")


def append_validated(t: Tables, p: Params) -> DataFrame:
    return mt.append_validated(t.customer_support, t.support_requests, REQUEST_REQUIRED)[0]


def append_rejects(t: Tables, p: Params) -> DataFrame:
    return mt.append_validated(t.customer_support, t.support_requests, REQUEST_REQUIRED)[1]


def update_by_key(t: Tables, p: Params) -> DataFrame:
    return mt.update_by_key(t.user_info, t.user_edits, "user_id", USER_EDIT_COLUMNS, order="request_no")[0]


def update_unmatched(t: Tables, p: Params) -> DataFrame:
    return mt.update_by_key(t.user_info, t.user_edits, "user_id", USER_EDIT_COLUMNS, order="request_no")[1]


def delete_by_key(t: Tables, p: Params) -> DataFrame:
    return mt.delete_by_key(t.operators, t.operator_deletes, "operator_id")


def _requested_holidays(t: Tables):
    return mt.insert_if_absent(t.holidays, t.holiday_requests, ["holiday_date", "company_id"],
                               "request_no", HOLIDAY_REQUIRED)


def insert_if_absent(t: Tables, p: Params) -> DataFrame:
    return _requested_holidays(t)[0]


def insert_if_absent_rejects(t: Tables, p: Params) -> DataFrame:
    return _requested_holidays(t)[1]


def _moved_holidays(t: Tables):
    return mt.update_if_unique(t.holidays, t.holiday_moves, "holiday_id", ["holiday_date", "company_id"],
                               HOLIDAY_EDIT_COLUMNS, "request_no")


def update_if_unique(t: Tables, p: Params) -> DataFrame:
    return _moved_holidays(t)[0]


def update_if_unique_rejects(t: Tables, p: Params) -> DataFrame:
    return _moved_holidays(t)[1]


def update_if_unique_unmatched(t: Tables, p: Params) -> DataFrame:
    return _moved_holidays(t)[2]


def update_if_unique_accepted(t: Tables, p: Params) -> DataFrame:
    return _moved_holidays(t)[3]


def _logged(t: Tables):
    return mt.apply_log(t.operators, t.operator_log, "operator_id", "request_no")


def apply_log(t: Tables, p: Params) -> DataFrame:
    return _logged(t)[0]


def apply_log_rejects(t: Tables, p: Params) -> DataFrame:
    return _logged(t)[1]


def get_or_create_dim(t: Tables, p: Params) -> DataFrame:
    return mt.get_or_create_dim(t.machine_type, t.type_requests, "machine_type_id", "machine_type_name")


def _guarded(t: Tables):
    return mt.update_guarded(t.machine, t.machine_parts, t.machine_type, t.machine_updates, "request_no")


def update_guarded(t: Tables, p: Params) -> DataFrame:
    return _guarded(t)[0]


def update_guarded_parts(t: Tables, p: Params) -> DataFrame:
    return _guarded(t)[1]


def update_guarded_types(t: Tables, p: Params) -> DataFrame:
    return _guarded(t)[2]


def update_guarded_rejects(t: Tables, p: Params) -> DataFrame:
    return _guarded(t)[3]


def _added(t: Tables):
    new = t.machine_updates.withColumn("machine_id", F.concat(F.lit("N"), F.col("machine_id")))
    return mt.add_machine(t.machine, t.machine_parts, t.machine_type, new)


def add_machine(t: Tables, p: Params) -> DataFrame:
    return _added(t)[0]


def add_machine_parts(t: Tables, p: Params) -> DataFrame:
    return _added(t)[1]


def add_machine_types(t: Tables, p: Params) -> DataFrame:
    return _added(t)[2]


def reconcile_set(t: Tables, p: Params) -> DataFrame:
    return mt.reconcile_set(t.operators, t.operator_roster, t.operator_machines)[0]


def reconcile_set_counts(t: Tables, p: Params) -> DataFrame:
    return mt.reconcile_set(t.operators, t.operator_roster, t.operator_machines)[1]
