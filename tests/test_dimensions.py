"""Stored dimensions, the snapshot of last values, and the streamed rollup."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import oee, production, snapshot, status, timeframe
from shopfloor.params import Params
from shopfloor.sources import dimensions
from shopfloor.streaming import rollup_stream
from tests.conftest import device_rows, hand_tables
from tests.test_rollup import readings


def folder():
    return tempfile.mkdtemp(prefix="dim-") + "/table"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_applied_twice_changes_nothing(spark):
    path, add = folder(), lambda old: old.unionByName(spark.createDataFrame([("b", 2)], "k string, v int"))
    dimensions.publish(spark.createDataFrame([("a", 1)], "k string, v int"), path, 0)
    assert dimensions.apply(spark, path, 1, add) and not dimensions.apply(spark, path, 1, add)
    assert not dimensions.apply(spark, path, 0, add)
    assert rows(dimensions.read(spark, path)) == [("a", 1), ("b", 2)]
    assert rows(dimensions.read(spark, path, 0)) == [("a", 1)] and dimensions.batches(spark, path) == [0, 1]


def test_a_write_that_dies_leaves_the_table(spark):
    path = folder()
    dimensions.publish(spark.range(100).select("id"), path, 1)

    def dies(old):
        # the last of its tasks fails after others have written their files
        return old.repartition(3).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("id")))

    with pytest.raises(Exception, match="killed"):
        dimensions.apply(spark, path, 2, dies)
    assert dimensions.batches(spark, path) == [1] and dimensions.read(spark, path).count() == 100
    assert dimensions.apply(spark, path, 2, lambda old: old.where("id < 50"))
    assert dimensions.read(spark, path).count() == 50


def test_no_table(spark):
    assert dimensions.batches(spark, folder()) == []
    with pytest.raises(ValueError, match="no complete version"):
        dimensions.read(spark, folder())


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_equals_the_scan_after_any_order_of_batches(spark, seed):
    raw = readings(seed, 90)
    raw += [(d, t, '{"MC_STATUS":"1","Act Speed":0}') for d, t, _ in raw[-4:]]  # ties
    random.Random(seed).shuffle(raw)
    path = folder()
    for number in (1, 2, 2, 3):
        snapshot.add(spark, path, number, device_rows(spark, raw[30 * (number - 1):30 * number if number < 3 else None]))
    t = hand_tables(spark, device_rows(spark, raw))
    newest = snapshot.newest(t.device_data)
    assert sorted(map(str, dimensions.read(spark, path).collect())) == sorted(map(str, newest.collect()))
    got = snapshot.machine_status_latest(t, Params(), path)
    at = {r["machine_id"]: r["ts"] for r in newest.collect()}
    once = {d for d, ts in at.items() if sum(1 for x, when, _ in raw if x == d and when == str(ts)) == 1}
    want = {r["machine_id"]: r["status"] for r in status.machine_status_latest(t, Params()).collect()}
    assert all(r["status"] == want[r["machine_id"]] for r in got.collect() if r["machine_id"] in once)


def test_streamed_rollup_equals_the_batch_in_any_order_and_over_a_restart(spark):
    raw = readings(9, 150)
    random.Random(4).shuffle(raw)
    land, path, ckpt = (tempfile.mkdtemp(prefix="stream-") for _ in range(3))
    path += "/minutes"
    for part in (raw[:70], raw[70:110], raw[110:]):  # the query ends and starts again in between
        device_rows(spark, part).coalesce(1).write.mode("append").parquet(land)
        rollup_stream.start(spark, land, path, ckpt, max_files_per_trigger=1).awaitTermination(300)
    direct = hand_tables(spark, device_rows(spark, raw))
    stored = hand_tables(spark, direct.device_data.where("false"), machine=direct.machine, rollup=path)
    for fn in (oee.oee_company, timeframe.production_idle_time, production.machine_production, oee.actual_weight):
        assert sorted(map(str, fn(stored, Params()).collect())) == sorted(map(str, fn(direct, Params()).collect()))
