"""Status codes (M3 from window maxima, M4 from the newest reading)."""

from __future__ import annotations

from shopfloor.operators import status
from shopfloor.params import Params
from tests.conftest import device_rows, hand_tables

P = Params(as_of="2024-01-01 01:00:00")


def _tables(spark):
    dd = device_rows(spark, [
        # 1: max status 1 with max speed 0 -> idle (3); newest row stopped -> latest 0
        ("1", "2024-01-01 00:50:00", '{"MC_STATUS":1,"Act Speed":0,"Target Speed":100}'),
        ("1", "2024-01-01 00:55:00", '{"MC_STATUS":0,"Act Speed":0,"Target Speed":100}'),
        # 2: slow (4), latest slow (4)
        ("2", "2024-01-01 00:50:00", '{"MC_STATUS":1,"Act Speed":10,"Target Speed":100}'),
        # 3: running (1); latest has no status -> offline (2)
        ("3", "2024-01-01 00:50:00", '{"MC_STATUS":1,"Act Speed":80,"Target Speed":100}'),
        ("3", "2024-01-01 00:59:00", '{"Act Speed":80}'),
        # 4: no status key in the window -> unknown (5)
        ("4", "2024-01-01 00:50:00", '{"Act Speed":80}'),
        # 5: only an old reading -> offline (2) in both forms
        ("5", "2024-01-01 00:10:00", '{"MC_STATUS":1,"Act Speed":80,"Target Speed":100}'),
    ])
    types = spark.createDataFrame([(0, "T0")], "machine_type_id int, machine_type_name string")
    parts = spark.createDataFrame([(1, "M1", "a.png")], "machine_part_id bigint, machine_id string, machine_image_path string")
    return hand_tables(spark, dd, machine_type=types, machine_parts=parts)


def test_status_codes(spark):
    t = _tables(spark)
    by_max = {r["machine_id"]: r["machine_status"] for r in status.machine_status(t, P).collect()}
    assert by_max == {"1": 3, "2": 4, "3": 1, "4": 5, "5": 2}
    latest = {r["machine_id"]: r["status"] for r in status.machine_status_latest(t, P).collect()}
    assert latest == {"1": 0, "2": 4, "3": 2, "4": 2, "5": 2}
    img = {r["machine_id"]: r["model_data"] for r in status.machine_status(t, P).collect()}
    assert img["1"] == "a.png" and img["2"] == ""


def test_catalog_filters(spark):
    from shopfloor.operators import catalog
    from shopfloor.registry import tables_for
    from tests.conftest import SMOKE
    t = tables_for(spark, SMOKE)
    rules = catalog.notification_rules(t, Params(company="1")).collect()
    owners = {r["machine_uid"] for r in t.machine.where("company_id = '1'").collect()}
    assert rules and all(r["machine_id"] in owners for r in rules)
    assert {r["config_id"] for r in rules} >= {"n1", "n2"}  # M1 and M4 belong to tenant 1
    ops = catalog.operators_by_machine(t, Params(machine_uid="M1")).collect()
    assert ops and {r["machine_id"] for r in ops} == {"M1"}
    one = catalog.machine_lookup(t, Params(company="1", machine_uid="M1")).collect()
    assert [(r["machine_uid"], r["machine_id"]) for r in one] == [("M1", "1")]
    assert catalog.machine_lookup(t, Params(company="2", machine_uid="M1")).count() == 0  # tenant guard
