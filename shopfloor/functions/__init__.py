from shopfloor.functions.numeric import (
    hours_2dp, micros_between, ratio_half_up, round_half_up, to_minutes, wire_weight,
)
from shopfloor.functions.timefmt import (
    trunc_ntz, period_label, interval_label, pg_week_label, iso_millis, to_kolkata,
)

__all__ = [
    "round_half_up", "ratio_half_up", "hours_2dp", "wire_weight", "micros_between", "to_minutes",
    "trunc_ntz", "period_label", "interval_label", "pg_week_label", "iso_millis", "to_kolkata",
]
