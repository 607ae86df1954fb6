"""Alarm figures against a brute-force evaluation of the reference SQL."""

from __future__ import annotations

import json
from datetime import datetime

from shopfloor.operators import alarms
from shopfloor.params import Params
from shopfloor.registry import tables_for
from tests.conftest import SMOKE, device_rows, hand_tables

P = Params(start="2024-01-01 00:00:00", end="2024-01-03 00:00:00")
CODES = [("A1", "one"), ("A2", "two"), ("A9", "never")]
READINGS = [
    ("1", "2024-01-01 00:00:00", {"MC_STATUS": "1", "A1": 0, "A2": 0}),
    ("1", "2024-01-01 00:10:00", {"MC_STATUS": "1", "A1": 1}),
    ("1", "2024-01-01 01:30:00", {"MC_STATUS": "0", "A1": 1, "A2": None}),
    ("1", "2024-01-01 02:00:00", {"MC_STATUS": "1", "A1": 0, "A2": 1}),
    ("1", "2024-01-01 05:00:00", {"MC_STATUS": "1", "A1": 1, "A2": 0}),
    ("1", "2024-01-02 05:00:00", {"MC_STATUS": "1", "A2": 1}),
    ("2", "2024-01-01 00:00:00", {"MC_STATUS": "1"}),
]


def _half_up(num, den, scale):
    if den in (None, 0) or num is None:
        return None
    k = 10 ** scale
    return ((2 * k * num + den) // (2 * den)) / k


def _brute(device):
    rows = sorted([(datetime.fromisoformat(t), d) for dev, t, d in READINGS if dev == device])
    active, uptime, flips, any_active, any_up = 0, 0, 0, False, False
    for code, _ in CODES:
        for i, (ts, d) in enumerate(rows):
            v = None if d.get(code) is None else str(d[code])
            prev = None if i == 0 or rows[i - 1][1].get(code) is None else str(rows[i - 1][1][code])
            gap = None if i + 1 == len(rows) else int((rows[i + 1][0] - ts).total_seconds() * 1e6)
            term = (gap if v == "1" else 0)
            if term is not None:
                active += term
                any_active = True
            term = (gap if d.get("MC_STATUS") == "1" and v is None else 0)
            if term is not None:
                uptime += term
                any_up = True
            flips += 1 if (prev == "0" and v == "1") else 0
    active = active if any_active else None
    uptime = uptime if any_up else None
    days = 3
    return (_half_up(flips, days, 2), _half_up(active, days * 10**6, 2),
            _half_up(uptime, flips * 10**6, 2), _half_up(active, flips * 10**6, 2))


def _tables(spark):
    dd = device_rows(spark, [(d, t, json.dumps(p)) for d, t, p in READINGS])
    al = spark.createDataFrame(CODES, "alarm_code string, alarm_description string")
    return hand_tables(spark, dd, alarms=al)


def test_reliability_matches_brute_force(spark):
    got = {r["machine_id"]: tuple(r)[2:] for r in alarms.alarm_reliability(_tables(spark), P).collect()}
    for dev in ("1", "2"):
        assert got[dev] == _brute(dev), dev


def test_breakdowns(spark):
    rows = {r["alarm_code"]: r for r in alarms.alarm_breakdowns(_tables(spark), P).collect()
            if r["machine_id"] == "1"}
    # A1 flips at 00:10 and 05:00 over its own readings; A2 (JSON null skipped)
    # flips at 02:00 and 2024-01-02 05:00.
    assert rows["A1"]["count"] == 2 and rows["A2"]["count"] == 2
    assert "A9" not in rows
    # A1 is '1' from 00:10 to 02:00 (two readings) and from 05:00 (last: no gap)
    assert rows["A1"]["duration"] == round(110 / 60, 2)
    assert rows["A1"]["cumulative_percent_count"] == 50.0


def test_breakdown_shares_sum_to_about_100(spark):
    t = tables_for(spark, SMOKE)
    by_dev = {}
    for r in alarms.alarm_breakdowns(t, Params()).collect():
        by_dev.setdefault(r["machine_id"], []).append(r["cumulative_percent_count"])
    assert by_dev
    for shares in by_dev.values():
        assert abs(sum(shares) - 100) <= len(shares)
