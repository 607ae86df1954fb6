"""Production / idle minutes, shift calendar and time frames."""

from __future__ import annotations

from types import SimpleNamespace

from shopfloor.operators import timeframe
from shopfloor.params import Params
from shopfloor.registry import tables_for
from tests.conftest import SMOKE, device_rows, hand_tables

P = Params(start="2024-01-01 00:00:00", end="2024-01-02 00:00:00")


def test_production_idle_caps_and_overlap(spark):
    dd = device_rows(spark, [
        ("1", "2024-01-01 00:00:00", '{"MC_STATUS":1,"Act Speed":10,"Target Speed":100}'),
        ("1", "2024-01-01 00:15:00", '{"MC_STATUS":1,"Act Speed":0,"Target Speed":100}'),
        ("1", "2024-01-01 00:45:00", '{"MC_STATUS":0,"Act Speed":0,"Target Speed":100}'),
        ("1", "2024-01-01 00:50:00", '{"MC_STATUS":1,"Act Speed":50,"Target Speed":100}'),
    ])
    r = timeframe.production_idle_time(hand_tables(spark, dd), P).collect()[0]
    # gap of exactly 15 min is not idle; the 30 min gap is capped at 15 and
    # counts as production (speed < half target) and idle (speed 0)
    assert r["total_production_time"] == 30.0
    assert r["total_idle_time"] == 20.0


def configured(spark):
    """The configured shifts and holidays of tenant 1 alone."""
    t = tables_for(spark, SMOKE)
    return SimpleNamespace(shifts=t.shifts.where("shift_id LIKE 's%'"), holidays=t.holidays.where("holiday_id LIKE 'h%'"))


def test_shift_calendar_counts(spark):
    t = configured(spark)
    p = Params(start="2024-01-01 00:00:00", end="2024-01-30 00:00:00", company="1")
    counts = {r["shift_name"]: r["n"] for r in
              timeframe.shift_calendar(t, p).groupBy("shift_name").count().withColumnRenamed("count", "n").collect()}
    # Republic Day (plain date) removes a Friday; the ISO-form holiday never matches
    assert counts == {"Morning": 21, "Evening": 25, "Night": 9}


def test_shift_hours_bounded_and_overnight_empty(spark):
    t = tables_for(spark, SMOKE)
    rows = timeframe.shift_timeframe(t, Params()).collect()
    assert rows
    for r in rows:
        total = r["downtime"] + r["production_time"] + r["setup_time"]
        assert total <= 8.0 + 0.02
        if r["shift_name"] == "Night":
            assert total == 0.0
    assert any(r["production_time"] > 0 for r in rows)


def test_interval_timeframe_is_local_time(spark):
    dd = device_rows(spark, [
        ("1", "2024-01-01 18:20:00", '{"MC_STATUS":"0","Act Speed":0}'),
        ("1", "2024-01-01 18:25:00", '{"MC_STATUS":"1","Act Speed":5}'),
        ("1", "2024-01-01 18:40:00", '{"MC_STATUS":"1","Act Speed":0}'),
    ])
    rows = timeframe.interval_timeframe(hand_tables(spark, dd), P, "day").collect()
    # 18:20 UTC is 23:50 in Kolkata (day 2024-01-01); 18:40 UTC is 00:10 next day.
    # Successors stay within the local hour, so the gap 18:25 -> 18:40 is lost.
    by_day = {r["interval_key"].day: r for r in rows}
    assert by_day[1]["downtime"] == round(300 / 3600, 2)
    assert by_day[1]["production_time"] == 0.0
    assert by_day[2]["setup_time"] == 0.0


def test_given_holidays_remove_given_shifts(spark):
    """Every tenant's calendar follows its rows in the holiday and shift tables."""
    t = tables_for(spark, SMOKE)
    whole = timeframe.shift_calendar(t, Params())
    gone = t.holidays.where("holiday_id = 'n1'").collect()[0]
    one_less = SimpleNamespace(spark=spark, store=None, device_data=t.device_data, shifts=t.shifts,
                               holidays=t.holidays.where("holiday_id <> 'n1'"))
    back = timeframe.shift_calendar(one_less, Params()).exceptAll(whole).collect()
    assert back and {(r["company_id"], str(r["shift_date"])) for r in back} == {(gone["company_id"], gone["holiday_date"])}
    assert {r["company_id"] for r in whole.select("company_id").distinct().collect()} == {"0", "1", "2"}


def test_shift_calendar_date_match_applies_iso_holidays(spark):
    t = configured(spark)
    p = Params(start="2024-01-01 00:00:00", end="2024-01-30 00:00:00", company="1", holiday_match="date")
    counts = {r["shift_name"]: r["n"] for r in
              timeframe.shift_calendar(t, p).groupBy("shift_name").count().withColumnRenamed("count", "n").collect()}
    # 2024-01-15 (ISO form, a Monday) now removes one instance of every shift
    assert counts == {"Morning": 20, "Evening": 24, "Night": 8}


def test_time_frame_dispatch(spark):
    dd = device_rows(spark, [
        ("1", "2024-01-01 10:00:00", '{"MC_STATUS":"0","Act Speed":0}'),
        ("1", "2024-01-01 10:10:00", '{"MC_STATUS":"1","Act Speed":5}'),
    ])
    t = hand_tables(spark, dd)
    unknown = timeframe.machine_time_frame(t, P, "Fortnight").collect()
    assert len(unknown) == 1 and unknown[0]["interval_key"] is None and unknown[0]["downtime"] == 0.17
    hour = timeframe.machine_time_frame(t, P, "Hour").collect()
    assert [r["interval_key"].hour for r in hour] == [15]  # 10:00 UTC is 15:30 in Kolkata
