"""The bucketed typed store and the in-plan JSON parse give the same results."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import alarms, oee, status, timeframe
from shopfloor.params import DEFAULT
from shopfloor.registry import tables_for
from shopfloor.sources import telemetry as tm
from shopfloor.sources.fixtures import Tables
from tests.conftest import SMOKE, device_rows, hand_tables

CASES = {
    "oee_company": lambda t: oee.oee_company(t, DEFAULT),
    "oee_by_interval_day": lambda t: oee.oee_by_interval(t, DEFAULT, "day"),
    "interval_timeframe_hour": lambda t: timeframe.interval_timeframe(t, DEFAULT, "hour"),
    "alarm_reliability": lambda t: alarms.alarm_reliability(t, DEFAULT),
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    name = f"telemetry_{uuid.uuid4().hex}"
    path = str(tmp_path_factory.mktemp("store") / "t")
    assert tm.ingest(Tables(spark, SMOKE).device_data, path, name, 4).count() == 0
    return name


@pytest.mark.parametrize("name", sorted(CASES))
def test_store_equals_in_plan(spark, store, name):
    a = CASES[name](tables_for(spark, SMOKE, store))
    b = CASES[name](tables_for(spark, SMOKE))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_store_is_bucketed_and_skips_shuffles(spark, store):
    plan = oee.actual_weight(tables_for(spark, SMOKE, store), DEFAULT)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "bucketed" in plan.lower()


def test_a_query_reads_its_own_keys_alone(spark, store):
    """The payload's keys are Parquet columns; the scan's schema holds the paths of the query."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    t = tables_for(spark, SMOKE, store)
    scan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert scan(oee.availability(t, DEFAULT)).count("payload:struct<0:variant,1:string>") == 1
    assert "payload:struct<" in scan(oee.actual_weight(t, DEFAULT)) and "variant,metadata" not in scan(oee.actual_weight(t, DEFAULT))
    rare = spark.table(store).select(tm.value("M_DT_7").alias("v"), tm.value("Never Sent").alias("w"), tm.has("Never Sent").alias("h"))
    assert {(r.v, r.w, r.h) for r in rare.distinct().collect()} == {("0", None, False), ("1", None, False)}


def test_null_and_missing_keys_stay_apart_in_the_store(spark, tmp_path):
    name = f"nulls_{uuid.uuid4().hex}"
    rows = [("1", "2024-01-02 00:00:00", '{"MC_STATUS":null,"LINE_SPEED":1.50}'), ("2", "2024-01-02 00:00:00", '{"LINE_SPEED":"x"}'),
            ("3", "2024-01-02 00:00:00", '{"MC_STATUS":"1","LINE_SPEED":7}'), ("4", "2024-01-02 00:00:00", "{}")]
    raw = device_rows(spark, rows)
    tm.ingest(raw, str(tmp_path / "nulls"), name, 2)
    cols = ["deviceuid", "has_mc", "mc_text", "has_line_speed", tm.value("LINE_SPEED").alias("speed")]
    want = tm.parse(raw).select("deviceuid", tm.has("MC_STATUS").alias("has_mc"), tm.value("MC_STATUS").alias("mc_text"),
                                tm.has("LINE_SPEED").alias("has_line_speed"), cols[-1])
    got = spark.table(name).select("deviceuid", tm.has("MC_STATUS").alias("has_mc"), tm.value("MC_STATUS").alias("mc_text"),
                                   tm.has("LINE_SPEED").alias("has_line_speed"), cols[-1])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_building_a_query_runs_nothing(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    oee.oee_company(tables_for(spark, SMOKE), DEFAULT)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(jobs) <= 3  # Parquet schemas only


@pytest.mark.parametrize("name", ["oee_company", "alarm_reliability"])
def test_sequence_bucket_does_not_change_results(spark, name):
    t = tables_for(spark, SMOKE)
    minute = DEFAULT.with_(sequence_bucket="minute")
    fns = {"oee_company": oee.oee_company, "alarm_reliability": alarms.alarm_reliability}
    a = fns[name](t, DEFAULT)
    b = fns[name](t, minute)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_store_append_per_batch_equals_one_shot(spark, store, tmp_path):
    dd = Tables(spark, SMOKE).device_data
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    inc = f"inc_{uuid.uuid4().hex}"
    tm.ingest(dd.where(F.col("timestamp") < cut), str(tmp_path / "inc"), inc, 4)
    tm.ingest(dd.where(F.col("timestamp") >= cut), str(tmp_path / "inc"), inc, 4)
    cols = ["deviceuid", "ts", "mc_text", "line_speed", "bobbin", "has_mc"]
    a = sorted(map(repr, tm.typed_all(tables_for(spark, SMOKE, store)).select(*cols).collect()))
    b = sorted(map(repr, tm.typed_all(tables_for(spark, SMOKE, inc)).select(*cols).collect()))
    assert a == b and len(a) == dd.count()


READING = '{"MC_STATUS":%s,"Act Speed":%s,"Target Speed":100}'


def test_new_readings_and_lost_readings(spark, tmp_path):
    """Appended readings show at once; bad JSON is kept apart, a repeated key
    keeps its last value, and a value that is no number hurts only its readers."""
    name, path = f"live_{uuid.uuid4().hex}", str(tmp_path / "live")
    first = device_rows(spark, [("1", "2024-01-02 00:00:00", READING % ("1", "80")),
                                ("2", "2024-01-02 00:00:00", '{"MC_STATUS":1,"MC_STATUS":0}'),
                                ("3", "2024-01-02 00:00:00", "{broken")])
    bad = tm.ingest(first, path, name, 2)
    assert [r.deviceuid for r in bad.collect()] == ["3"]
    t = hand_tables(spark, first)
    t.store = name
    codes = lambda: {r.machine_id: r.status_code for r in status.status_by_max(t, DEFAULT).collect()}
    assert codes() == {"1": status.RUNNING, "2": status.STOPPED}
    tm.ingest(device_rows(spark, [("1", "2024-01-02 00:05:00", READING % ("0", "0")),
                                  ("1", "2024-01-02 00:06:00", '{"Target Speed":"fast"}'),
                                  ("1", "2024-01-02 00:30:00", READING % ("0", "0"))]), path, name, 2)
    assert tm.typed_all(t).count() == 5
    assert oee.availability(t, DEFAULT).count() == 2  # does not read the target speed
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        tm.typed_all(t).select("target_speed").collect()
    raw = hand_tables(spark, first, machine=t.machine)
    with pytest.raises(Exception, match="MALFORMED|parse"):
        tm.typed_all(raw).select("mc_text").collect()
