"""The two-level lead/lag equals the single-window form."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, Window, functions as F

from shopfloor.plans.neighbors import with_neighbors


def _random_rows(seed: int, n: int):
    rnd = random.Random(seed)
    rows = []
    t = datetime(2024, 1, 1)
    for i in range(n):
        # bursts and long silences, so buckets are often empty or single-row
        t += timedelta(seconds=rnd.choice([1, 7, 59, 600, 3600, 3 * 3600 + 17]))
        dev = rnd.choice(["a", "b", "c"])
        flag = rnd.choice(["0", "1", None])
        rows.append((dev, rnd.choice(["x", "y"]), t + timedelta(microseconds=i), flag, i))
    return rows


@pytest.mark.parametrize("seed,unit", [(1, "hour"), (2, "minute"), (3, "day"), (4, "hour")])
def test_matches_plain_window(spark, seed, unit):
    df = spark.createDataFrame(_random_rows(seed, 400), "dev string, k string, ts timestamp_ntz, flag string, v int")
    keys = ["dev", "k"]
    got = with_neighbors(df, keys, "ts", F.date_trunc(unit, "ts"),
                         lead={"next_ts": "ts", "next_v": "v"}, lag={"prev_flag": "flag", "prev_ts": "ts"})
    w = Window.partitionBy(*keys).orderBy("ts")
    want = df.select("*", F.lead("ts").over(w).alias("next_ts"), F.lead("v").over(w).alias("next_v"),
                     F.lag("flag").over(w).alias("prev_flag"), F.lag("ts").over(w).alias("prev_ts"))
    cols = sorted(want.columns)
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    assert got.count() == df.count()


def test_single_row_and_empty(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 5), 1)], "dev string, ts timestamp_ntz, v int")
    out = with_neighbors(df, ["dev"], "ts", F.date_trunc("hour", "ts"), lead={"n": "ts"}, lag={"p": "v"}).collect()
    assert len(out) == 1 and out[0]["n"] is None and out[0]["p"] is None
    empty = df.where("false")
    assert with_neighbors(empty, ["dev"], "ts", F.date_trunc("hour", "ts"), lead={"n": "ts"}).count() == 0


def test_ties_do_not_depend_on_the_order_of_arrival(spark):
    rows = [("d", "2024-01-01 00:00:00", v) for v in ("1", "0", "1", "0", "2")] + [("d", "2024-01-01 01:00:00", "9")]
    df = spark.createDataFrame(rows, "k string, t string, v string").select("k", F.col("t").cast("timestamp_ntz").alias("ts"), "v")
    out = []
    for n in (1, 3):
        got = with_neighbors(df.repartition(n), ["k"], "ts", F.date_trunc("hour", F.col("ts")), lag={"p": "v"})
        out.append(sorted(map(repr, got.select("v", "p").collect())))
    assert out[0] == out[1] == sorted(map(repr, [Row(v=a, p=b) for a, b in (("0", None), ("0", "0"), ("1", "0"), ("1", "1"), ("2", "1"), ("9", "2"))]))
