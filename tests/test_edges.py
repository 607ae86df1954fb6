"""Edge cases of FIXTURES.md §5: year-end ranges, week labels, empty input."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shopfloor.functions.timefmt import period_label
from shopfloor.operators import oee, overview
from shopfloor.params import Params
from tests.conftest import device_rows, hand_tables


def _catalog_tables(spark, dd):
    types = spark.createDataFrame([(0, "T0")], "machine_type_id int, machine_type_name string")
    parts = spark.createDataFrame([(1, "M1", "a.png")], "machine_part_id bigint, machine_id string, machine_image_path string")
    return hand_tables(spark, dd, machine_type=types, machine_parts=parts)


def test_year_end_range_gives_zero_v1_length(spark):
    dd = device_rows(spark, [
        ("1", "2023-12-30 10:00:00", '{"This Month Production": 100, "P_DT_BOBIN_FORMER_CHANGE": "0"}'),
        ("1", "2023-12-31 10:00:00", '{"This Month Production": 300, "P_DT_BOBIN_FORMER_CHANGE": "1"}'),
        ("1", "2024-01-02 10:00:00", '{"This Month Production": 50, "P_DT_BOBIN_FORMER_CHANGE": "0"}'),
        ("1", "2024-01-03 10:00:00", '{"This Month Production": 90, "P_DT_BOBIN_FORMER_CHANGE": "1"}'),
    ])
    t = _catalog_tables(spark, dd)
    p = Params(start="2023-12-01 00:00:00", end="2024-01-31 00:00:00")
    row = overview.company_overview(t, p).collect()[0]
    # current year 2024, months 12..1: no month qualifies (reference quirk)
    assert row["produced_length"] == 0.0
    # two flips in range x four readings of the device
    assert row["produced_reels"] == 8
    # the corrected v2 figure sums both months
    from shopfloor.operators import production
    assert production.machine_production(t, p).collect()[0]["produced_length"] == 200.0 + 40.0


def test_week_label_is_day_of_year_based(spark):
    df = spark.createDataFrame([(datetime(2024, 12, 31, 8),), (datetime(2024, 1, 7, 8),), (datetime(2023, 1, 1, 8),)],
                               "ts timestamp_ntz")
    labels = [r[0] for r in df.select(period_label("week", F.col("ts"))).collect()]
    # Monday 2024-12-30 is day 365 -> week 53; Monday 2024-01-01 -> 01;
    # Sunday 2023-01-01 belongs to Monday 2022-12-26 -> 2022-52
    assert labels == ["2024-53", "2024-01", "2022-52"]


def test_empty_input(spark):
    dd = device_rows(spark, [("1", "2024-01-01 00:00:00", '{"MC_STATUS": 1}')]).where("false")
    machine = spark.createDataFrame([("M1", "1", "m", "p", "x", "c", "l", 0.0, 0.0, 0, "1")],
                                    "machine_uid string, machine_id string, machine_name string, machine_plant string, "
                                    "machine_model string, machine_customer string, machine_location string, "
                                    "machine_longitude double, machine_latitude double, machine_type_id int, company_id string")
    t = hand_tables(spark, dd, machine=machine)
    p = Params(start="2024-01-01 00:00:00", end="2024-01-02 00:00:00")
    r = oee.oee_company(t, p).collect()[0]
    assert (r["availability"], r["actual_weight"], r["target_weight"], r["performance"], r["quality"], r["oee"]) == \
        (0.0, 0.0, 0.0, 0.0, 100.0, 0.0)
    r = oee.oee_device_rounded(t, p).collect()[0]
    assert r["availability"] is None and r["oee"] == 0.0 and r["performance"] == 0.0 and r["quality"] == 100.0
    assert oee.oee_by_period(t, p, "day").count() == 0
