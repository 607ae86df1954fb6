"""Payload parsing: key existence vs JSON null, keys with spaces."""

from __future__ import annotations

from shopfloor.sources import telemetry as tm
from tests.conftest import device_rows


def test_missing_key_vs_json_null(spark):
    dd = device_rows(spark, [
        ("1", "2024-01-01 00:00:00", '{"MC_STATUS": null, "Act Speed": 3.50}'),
        ("1", "2024-01-01 00:01:00", '{"Act Speed": 0}'),
        ("1", "2024-01-01 00:02:00", '{"MC_STATUS": 1, "P_DT_BOBIN_FORMER_CHANGE": "1"}'),
    ])
    rows = tm.typed(tm.parse(dd)).orderBy("ts").collect()
    assert [r["has_mc"] for r in rows] == [True, False, True]
    assert [r["mc_status"] for r in rows] == [None, None, 1.0]
    assert [r["mc_text"] for r in rows] == [None, None, "1"]
    assert rows[0]["act_speed"] == 3.5 and rows[1]["act_speed"] == 0.0
    assert rows[2]["bobbin"] == "1" and rows[2]["has_bobbin"]


def test_payload_map_keeps_all_keys(spark):
    dd = device_rows(spark, [("1", "2024-01-01 00:00:00", '{"E_DT_6": 1, "X": null, "a b": "t"}')])
    m = tm.payload_map(dd).collect()[0]["payload_map"]
    assert m == {"E_DT_6": "1", "X": None, "a b": "t"}
