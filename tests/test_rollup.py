"""A rollup answers as the readings do, whatever the batches."""

from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import oee, production, timeframe
from shopfloor.params import Params
from shopfloor.sources import rollup
from tests.conftest import device_rows, hand_tables

P = Params()
METRICS = {
    "availability": oee.availability, "actual_weight": oee.actual_weight, "target_weight": oee.target_weight,
    "oee_company": oee.oee_company, "oee_device": oee.oee_device, "oee_device_rounded": oee.oee_device_rounded,
    "oee_by_period": lambda t, p: oee.oee_by_period(t, p, "day"), "oee_by_interval": lambda t, p: oee.oee_by_interval(t, p, "hour"),
    "production_idle_time": timeframe.production_idle_time, "monthly_production": production.monthly_production,
    "reel_transitions": production.reel_transitions, "machine_production": production.machine_production,
}


def readings(seed, n):
    rnd = random.Random(seed)
    rows, t = [], datetime(2024, 1, 30, 22)
    for i in range(n):
        t += timedelta(seconds=rnd.choice([1, 3, 20, 45, 61, 600, 5000]))
        said = [f'"MC_STATUS":{rnd.choice(["0", "1", "null"])}', f'"LINE_SPEED":{rnd.randint(0, 90)}',
                f'"ACT_COLD_DIA":{rnd.choice(["3.1", "3.9", "null"])}', f'"Act Speed":{rnd.choice([0, 40, 80])}',
                '"Target Speed":100', f'"This Month Production":{i * 10}',
                f'"P_DT_BOBIN_FORMER_CHANGE":"{rnd.randint(0, 1)}"']
        keep = [s for s in said if rnd.random() < 0.85]
        rows.append((rnd.choice("12"), t.isoformat(sep=" "), "{" + ",".join(keep) + "}"))
    return rows


def answers(fn, t):
    return sorted(map(str, (tuple(r) for r in fn(t, P).collect())))


@pytest.fixture(scope="module")
def both(spark):
    """Tables over the readings, and over a rollup that got them in four batches: late
    ones inside stored minutes, one batch twice."""
    raw = device_rows(spark, readings(3, 240))
    part = F.pmod(F.xxhash64("data", "timestamp"), F.lit(4))
    path = tempfile.mkdtemp(prefix="rollup-") + "/minutes"
    for number, upto in enumerate([(0,), (0, 2), (0, 2), (0, 2, 3), (0, 1, 2, 3)], 1):
        oee.append_rollup(raw.where(part == upto[-1] if upto != (0, 1, 2, 3) else part == 1), raw.where(part.isin(*upto)), path, number)
    direct = hand_tables(spark, raw)
    return direct, hand_tables(spark, raw.where("false"), machine=direct.machine, rollup=path)


@pytest.mark.parametrize("name", METRICS)
def test_equal_to_a_full_recomputation(both, name):
    direct, stored = both
    want = answers(METRICS[name], direct)
    assert want and answers(METRICS[name], stored) == want


def test_no_payload_is_read(both):
    plan = oee.oee_company(both[1], P)._jdf.queryExecution().executedPlan().toString()
    assert "parseJson" not in plan and "data" not in [f for f in plan.split("ReadSchema")[-1].split(":")]


def test_newest_row_of_a_minute_counts(both, spark):
    rows = rollup.read(spark, both[1].rollup)
    assert rows.groupBy("deviceuid", "minute").count().where("count > 1").isEmpty()
    assert spark.read.parquet(both[1].rollup).count() > rows.count()


def test_range_and_device(both):
    direct, stored = both
    p = Params(start="2024-01-31 00:00:00", end="2024-01-31 23:59:59.999999", device="1")
    assert answers(lambda t, _: oee.oee_company(t, p), stored) == answers(lambda t, _: oee.oee_company(t, p), direct)
    with pytest.raises(ValueError, match="whole minute"):
        oee.availability(stored, p.with_(start="2024-01-31 00:00:30"))
    with pytest.raises(ValueError, match="last microsecond"):
        oee.availability(stored, p.with_(end="2024-01-31 10:00:00"))
