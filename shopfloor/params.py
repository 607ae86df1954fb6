"""Query parameters (the reference's request parameters)."""

from __future__ import annotations

from dataclasses import dataclass, replace


SEQUENCE_UNITS = ("minute", "hour", "day")


@dataclass(frozen=True)
class Params:
    """Parameters of one analytics request.

    ``company`` / ``device`` / ``machine_uid`` narrow a fleet-wide result to
    one tenant or machine (the reference's tenant guard); ``None`` keeps all.
    ``start`` / ``end`` bound the readings (closed range); ``None`` means the
    first / newest reading, ``as_of`` replaces ``NOW()`` and is the newest
    reading if ``None``: all three are derived inside the plan.
    """

    start: str | None = None
    end: str | None = None
    company: str | None = None
    device: str | None = None
    machine_uid: str | None = None
    as_of: str | None = None
    status_window_minutes: int = 15
    # Time bucket used to split per-device sequences for lead/lag (see
    # plans.neighbors); must be a date_trunc unit.
    sequence_bucket: str = "hour"
    # Shift calendar: "strict" compares the stored holiday text with
    # 'YYYY-MM-DD' (reference behaviour: ISO date-time holidays never match);
    # "date" compares parsed dates, so those holidays apply too.
    holiday_match: str = "strict"

    def __post_init__(self) -> None:
        # Enumerated parameters are checked up front, as the reference
        # rejects unknown values before running a query.
        if self.sequence_bucket not in SEQUENCE_UNITS:
            raise ValueError(f"sequence_bucket must be one of {SEQUENCE_UNITS}, got {self.sequence_bucket!r}")
        if self.holiday_match not in ("strict", "date"):
            raise ValueError(f"holiday_match must be 'strict' or 'date', got {self.holiday_match!r}")
        if self.status_window_minutes <= 0:
            raise ValueError("status_window_minutes must be positive")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
