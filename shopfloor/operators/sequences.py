"""The sequences of readings that the metrics are sums over (see ``plans.segments``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shopfloor.functions.numeric import micros_between, to_minutes, wire_weight
from shopfloor.plans.segments import Sequence

# Fixed value: a gap longer than this is idle time, and no gap counts more.
MAX_GAP_US = 15 * 60 * 1_000_000


def _gap(a: Column, b: Column) -> Column:
    return micros_between(a["ts"], b["ts"])


def _weight(a: Column, b: Column) -> Column:
    """Wire drawn from a reading to its successor at the reading's speed and diameter."""
    return wire_weight(a["diameter"], to_minutes(_gap(a, b)) * a["line_speed"])


# Readings with a line speed follow each other, whatever else they carry.
SPEED = Sequence("speed", "has_line_speed", ("line_speed", "diameter"), {"weight": _weight})

# ... and those with a diameter too: weight at the own speed and at speed 1, and the
# top speed of the readings that have a successor.
DRAWN = Sequence("drawn", "has_line_speed AND has_diameter", ("line_speed", "diameter"),
                 {"drawn_weight": _weight, "unit_weight": lambda a, b: wire_weight(a["diameter"], to_minutes(_gap(a, b)))},
                 {"drawn_top": lambda a, b: a["line_speed"]})


def _production(a: Column, b: Column) -> Column:
    mc, speed = a["mc_status"], a["act_speed"]
    on = ((mc == 1) & (speed > 0)) | ((mc == 1) & (speed < F.lit(0.5) * a["target_speed"]))
    return F.when(on, F.least(_gap(a, b), F.lit(MAX_GAP_US))).otherwise(0)


def _idle(a: Column, b: Column) -> Column:
    mc, gap = a["mc_status"], _gap(a, b)
    off = (mc == 0) | ((mc == 1) & (a["act_speed"] == 0)) | (gap > F.lit(MAX_GAP_US))
    return F.when(off, F.least(gap, F.lit(MAX_GAP_US))).otherwise(0)


# A reading may count in both sums; without a status or speed it counts in none
# unless a long gap follows.
ACTIVITY = Sequence("activity", None, ("mc_status", "act_speed", "target_speed"),
                    {"production_us": _production, "idle_us": _idle})


def _state(text: str, moving: str | None = None):
    def us(a: Column, b: Column) -> Column:
        on = a["mc_text"] == text
        if moving:
            on = on & ((a["act_speed"] > 0) if moving == "yes" else (a["act_speed"] == 0))
        return F.when(on & (b["ts"] > a["ts"]), _gap(a, b)).otherwise(0)
    return us


# Status '0' is down time, '1' with speed production, '1' at speed 0 setup.
STATES = Sequence("states", None, ("mc_text", "act_speed"),
                  {"down_us": _state("0"), "prod_us": _state("1", "yes"), "setup_us": _state("1", "no")})


def _flip(a: Column, b: Column) -> Column:
    return F.when((a["bobbin"] == "0") & (b["bobbin"] == "1"), 1).otherwise(0)


# A reel is done when the bobbin flag goes from '0' to '1': between readings that
# carry the flag, or (first version) between any two readings.
REELS = Sequence("reels", "has_bobbin", ("bobbin",), {"flips": _flip})
REELS_OF_ALL = Sequence("reels_all", None, ("bobbin",), {"flips": _flip})
