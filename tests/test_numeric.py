"""Exact PostgreSQL-style rounding helpers against Python's Decimal."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from shopfloor.functions.numeric import hours_2dp, ratio_half_up, round_half_up


def test_ratio_half_up_is_exact(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randint(0, 10 ** 12), rnd.randint(1, 10 ** 7)) for _ in range(500)]
    pairs += [(rnd.randint(10 ** 15, 4 * 10 ** 16), 10 ** 6 * rnd.randint(1, 9)) for _ in range(500)]
    pairs += [(5, 1000), (15, 1000), (125, 100), (1, 8), (3, 8), (0, 7), (10 ** 12, 3)]  # exact ties too
    df = spark.createDataFrame(pairs, "num bigint, den bigint")
    got = df.select(ratio_half_up(F.col("num"), F.col("den"), 2).alias("r"),
                    ratio_half_up(F.col("num"), F.lit(0), 2).alias("z")).collect()
    for (num, den), row in zip(pairs, got):
        want = float((Decimal(num) / Decimal(den)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        assert row["r"] == want, (num, den)
        assert row["z"] is None


def test_hours_and_round_half_up(spark):
    df = spark.createDataFrame([(18_000_000, 1.005), (54_000_000, 2.675), (0, -2.5)], "us bigint, x double")
    rows = df.select(hours_2dp(F.col("us")).alias("h"), round_half_up(F.col("x"), 2).alias("r2"),
                     round_half_up(F.col("x"), 0).alias("r0")).collect()
    # 18 s = 0.005 h -> 0.01 (half up); 54 s = 0.015 h -> 0.02
    assert [r["h"] for r in rows] == [0.01, 0.02, 0.0]
    # decimal rounding of the shortest decimal form, half away from zero
    assert [r["r2"] for r in rows] == [1.01, 2.68, -2.5]
    assert [r["r0"] for r in rows] == [1.0, 3.0, -3.0]
