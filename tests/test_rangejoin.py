"""Binned range join equals the nested-loop definition."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from shopfloor.plans.rangejoin import range_join


def test_matches_between_join(spark):
    rnd = random.Random(7)
    t0 = datetime(2024, 1, 1)
    events = [(rnd.choice("ab"), t0 + timedelta(minutes=rnd.randint(0, 6 * 24 * 60)), i) for i in range(300)]
    wins = []
    for i in range(40):
        s = t0 + timedelta(minutes=rnd.randint(0, 6 * 24 * 60))
        # some windows span days, some end before they start (match nothing)
        e = s + timedelta(minutes=rnd.choice([-30, 45, 8 * 60, 40 * 60]))
        wins.append((rnd.choice("ab"), f"w{i}", s, e))
    ev = spark.createDataFrame(events, "k string, ts timestamp_ntz, id int")
    wd = spark.createDataFrame(wins, "k string, wid string, ws timestamp_ntz, we timestamp_ntz")
    got = sorted((r["id"], r["wid"]) for r in range_join(ev, wd, ["k"], "ts", "ws", "we").collect())
    want = sorted((i, w) for k, ts, i in events for kk, w, s, e in wins if k == kk and s <= ts <= e)
    assert got == want and want
