"""OEE semantics on hand-made readings and invariants."""

from __future__ import annotations

import math

import pytest

from shopfloor.operators import oee
from shopfloor.params import Params
from shopfloor.registry import tables_for
from tests.conftest import SMOKE, device_rows, hand_tables

P = Params(start="2024-01-01 00:00:00", end="2024-01-02 00:00:00")


def W(d, length):
    return (3.14159 * (d / 1000 / 2) ** 2 * length * 7860) / 1000


@pytest.fixture(scope="module")
def case(spark):
    dd = device_rows(spark, [
        ("1", "2024-01-01 00:00:10", '{"MC_STATUS":1,"LINE_SPEED":100,"ACT_COLD_DIA":3.0}'),
        ("1", "2024-01-01 00:00:40", '{"MC_STATUS":0,"LINE_SPEED":50,"ACT_COLD_DIA":3.0}'),
        ("1", "2024-01-01 00:01:30", '{"MC_STATUS":null,"LINE_SPEED":80}'),
        ("1", "2024-01-01 00:03:00", '{"MC_STATUS":1,"LINE_SPEED":100,"ACT_COLD_DIA":4.0}'),
        # device 2: one reading per minute -> zero spans -> zero target
        ("2", "2024-01-01 00:00:00", '{"MC_STATUS":1,"LINE_SPEED":10,"ACT_COLD_DIA":3.0}'),
        ("2", "2024-01-01 00:05:00", '{"MC_STATUS":1,"LINE_SPEED":10,"ACT_COLD_DIA":3.0}'),
        # device 3: a single reading -> zero span even for a whole period
        ("3", "2024-01-01 00:00:00", '{"MC_STATUS":1,"LINE_SPEED":10,"ACT_COLD_DIA":3.0}'),
    ])
    return hand_tables(spark, dd)


def test_availability_counts_null_status_in_n_only(case):
    a = {r["machine_id"]: r["availability"] for r in oee.availability(case, P).collect()}
    # minutes: (up 1, down 1, n 2), (n 1, status null), (up 1, n 1)
    assert a["1"] == pytest.approx(1.5 / 2.0 * 100)
    assert a["2"] == 100.0


def test_weights_and_oee(case):
    r = {x["machine_id"]: x for x in oee.oee_company(case, P).collect()}["1"]
    actual = W(3.0, 0.5 * 100) + W(3.0, 50 / 60 * 50)  # the 3rd gap has no diameter
    # minute spans: 0.5 min at 1/2 running; single-reading minutes span 0;
    # two distinct diameters multiply the target
    target = W(3.0, 0.5 * 100 * 0.5) + W(4.0, 0.5 * 100 * 0.5)
    assert r["actual_weight"] == pytest.approx(actual, abs=1e-6)
    assert r["target_weight"] == pytest.approx(target, abs=1e-6)
    assert r["performance"] == pytest.approx(actual / target * 100, abs=1e-5)
    assert r["quality"] == 100.0
    assert r["oee"] == pytest.approx(75.0 * actual / target, abs=1e-5)


def test_zero_target_rules(case):
    company = {x["machine_id"]: x for x in oee.oee_company(case, P).collect()}["2"]
    assert company["target_weight"] == 0.0 and company["performance"] == 0.0 and company["oee"] == 0.0
    rounded = {x["machine_id"]: x for x in oee.oee_device_rounded(case, P).collect()}["2"]
    assert rounded["performance"] == 0.0 and rounded["oee"] == 0.0 and rounded["availability"] == 100.0
    period = oee.oee_by_period(case, P, "day").where("machine_id = '3'").collect()[0]
    assert period["target_weight"] == 0.0 and period["oee"] is None  # NULL unless availability is 0


def test_period_and_interval_labels(case):
    periods = {r["period"] for r in oee.oee_by_period(case, P, "week").collect()}
    assert periods == {"2024-01"}  # Monday 2024-01-01 -> week 01 (day-of-year based)
    hours = {r["interval"] for r in oee.oee_by_interval(case, P, "hour").collect()}
    assert hours == {"2024-01-01 00:00"}


def test_invariants_on_fixture(spark):
    t = tables_for(spark, SMOKE)
    p = Params()
    for r in oee.oee_company(t, p).collect():
        assert 0.0 <= r["availability"] <= 100.0
    for u in ("hour", "day"):
        for r in oee.oee_by_interval(t, p, u).collect():
            assert r["performance"] <= 100.0 + 1e-9
            assert not math.isnan(r["oee"])


def test_gap_attribution_period_vs_interval(spark):
    dd = device_rows(spark, [
        ("7", "2024-01-01 10:50:00", '{"MC_STATUS":1,"LINE_SPEED":60,"ACT_COLD_DIA":2.0}'),
        ("7", "2024-01-01 11:10:00", '{"MC_STATUS":1,"LINE_SPEED":60,"ACT_COLD_DIA":2.0}'),
        ("7", "2024-01-01 11:20:00", '{"MC_STATUS":1,"LINE_SPEED":30,"ACT_COLD_DIA":2.0}'),
    ])
    t = hand_tables(spark, dd)
    per = {r["period"]: r["actual_weight"] for r in oee.oee_by_period(t, P, "hour").collect()}
    # per period: successors over the whole device sequence; the 20-minute gap
    # after 10:50 is charged to hour 10
    assert per["2024-01-01 10"] == pytest.approx(W(2.0, 20 * 60), abs=1e-6)
    assert per["2024-01-01 11"] == pytest.approx(W(2.0, 10 * 60), abs=1e-6)
    inter = {r["interval"]: r for r in oee.oee_by_interval(t, P, "hour").collect()}
    # per interval: successors stay inside the hour, so 10:50 has none
    assert inter["2024-01-01 10:00"]["actual_weight"] == 0.0
    assert inter["2024-01-01 11:00"]["actual_weight"] == pytest.approx(W(2.0, 10 * 60), abs=1e-6)
    # target uses the interval's top speed over readings with a successor
    assert inter["2024-01-01 11:00"]["target_weight"] == pytest.approx(W(2.0, 10 * 60), abs=1e-6)
    assert inter["2024-01-01 11:00"]["performance"] == pytest.approx(100.0)
