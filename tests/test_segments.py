"""Figures over segments equal those of one window over all rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from shopfloor.functions.numeric import micros_between
from shopfloor.plans.segments import Sequence, close, segment

SCHEMA = "dev string, ts timestamp_ntz, ok boolean, flag string, v double"

ALL = Sequence("all", None, ("v", "flag"), {
    "time_us": lambda a, b: micros_between(a["ts"], b["ts"]),
    "flips": lambda a, b: F.when((a["flag"] == "0") & (b["flag"] == "1"), 1).otherwise(0)}, {"top": lambda a, b: a["v"]})
SOME = Sequence("some", "ok", ("v", "flag"), {"area": lambda a, b: a["v"] * micros_between(a["ts"], b["ts"]) / 1e6})


def random_rows(seed, n):
    rnd = random.Random(seed)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(n):
        t += timedelta(seconds=rnd.choice([1, 7, 59, 600, 3600, 3 * 3600 + 17]), microseconds=rnd.choice([0, 1, 999]))
        rows.append((rnd.choice(["a", "b", "c"]), t, rnd.random() < 0.6, rnd.choice(["0", "1", None]),
                     rnd.choice([None, float(rnd.randint(0, 9))])))
    return rows


def expected(df):
    w = Window.partitionBy("dev").orderBy("ts")
    a = df.withColumn("n", F.lead(F.struct("ts", "flag")).over(w)).where("n is not null")
    a = a.groupBy("dev").agg(F.sum(micros_between(F.col("ts"), F.col("n.ts"))).alias("time_us"),
                             F.sum(F.when((F.col("flag") == "0") & (F.col("n.flag") == "1"), 1).otherwise(0)).alias("flips"),
                             F.max("v").alias("top"))
    s = df.where("ok").withColumn("n", F.lead("ts").over(w)).where("n is not null")
    s = s.groupBy("dev").agg(F.sum(F.col("v") * micros_between(F.col("ts"), F.col("n")) / 1e6).alias("area"))
    return {r["dev"]: (r["time_us"], r["flips"], r["top"], None if r["area"] is None else round(r["area"], 6))
            for r in a.join(s, "dev", "left").collect()}


def total(segments, order):
    c = close(segments, ["dev"], [ALL, SOME], order).groupBy("dev").agg(
        F.sum("time_us").alias("time_us"), F.sum("flips").alias("flips"), F.max("top").alias("top"), F.sum("area").alias("area"))
    return {r["dev"]: (r["time_us"], r["flips"], r["top"], None if r["area"] is None else round(r["area"], 6))
            for r in c.collect() if r["time_us"] is not None}


@pytest.mark.parametrize("seed,unit", [(1, "minute"), (2, "hour"), (3, "day"), (4, "hour")])
def test_equal_to_one_window(spark, seed, unit):
    df = spark.createDataFrame(random_rows(seed, 300), SCHEMA).withColumn("bucket", F.date_trunc(unit, "ts"))
    assert total(segment(df, ["dev"], ["bucket"], [ALL, SOME]), "bucket") == expected(df)


def test_segments_of_batches_are_merged_by_their_union(spark):
    """Batches of whole buckets, in any order: nothing stored is touched again."""
    df = spark.createDataFrame(random_rows(7, 300), SCHEMA).withColumn("bucket", F.date_trunc("hour", "ts"))
    parts = [df.where(F.pmod(F.hour("ts"), F.lit(3)) == k) for k in (2, 0, 1)]
    stored = [segment(p, ["dev"], ["bucket"], [ALL, SOME]) for p in parts]
    assert total(stored[0].unionByName(stored[1]).unionByName(stored[2]), "bucket") == expected(df)


def test_one_sort_of_the_rows(spark):
    df = spark.createDataFrame(random_rows(1, 10), SCHEMA).withColumn("bucket", F.date_trunc("hour", "ts"))
    plan = segment(df, ["dev"], ["bucket"], [ALL, SOME])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") <= 2  # the second: ends kept by a sorted aggregate


def test_ties_do_not_depend_on_the_order_of_arrival(spark):
    rows = [("d", datetime(2024, 1, 1), True, f, v) for f, v in (("1", 1.0), ("0", 2.0), (None, None), ("1", 3.0))]
    rows += [("d", datetime(2024, 1, 1, 1), True, "1", 5.0)]
    out = []
    for n in (1, 3):
        df = spark.createDataFrame(rows, SCHEMA).repartition(n).withColumn("bucket", F.date_trunc("hour", "ts"))
        out.append(total(segment(df, ["dev"], ["bucket"], [ALL, SOME]), "bucket"))
    assert out[0] == out[1] and out[0]["d"][0] == 3_600_000_000


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("bucket", F.date_trunc("hour", "ts"))
    assert close(segment(df, ["dev"], ["bucket"], [ALL]), ["dev"], [ALL], "bucket").count() == 0
