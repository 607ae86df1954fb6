from __future__ import annotations

import sys
import tempfile
from pathlib import Path
from types import SimpleNamespace

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopfloor.session import build_session, checkpoint_dir  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app="shopfloor-tests",
                      extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


DEVICE_SCHEMA = "deviceuid string, timestamp timestamp_ntz, data string"


def device_rows(spark, rows):
    """rows: (device, 'YYYY-MM-DD HH:MM:SS', json) -> device_data frame."""
    from datetime import datetime
    data = [(d, datetime.fromisoformat(t), j) for d, t, j in rows]
    return spark.createDataFrame(data, DEVICE_SCHEMA)


def hand_tables(spark, device_data, **extra):
    """A Tables stand-in over hand-made frames (typed telemetry parsed in plan)."""
    machine = extra.pop("machine", None)
    if machine is None:
        ids = sorted({r[0] for r in device_data.select("deviceuid").collect()})
        machine = spark.createDataFrame(
            [(f"M{i}", i, f"m{i}", "p", "x", "c", "l", 0.0, 0.0, 0, "1") for i in ids],
            "machine_uid string, machine_id string, machine_name string, machine_plant string, "
            "machine_model string, machine_customer string, machine_location string, "
            "machine_longitude double, machine_latitude double, machine_type_id int, company_id string")
    ns = SimpleNamespace(spark=spark, sf_dir=tempfile.mkdtemp(), store=None,
                         device_data=device_data, machine=machine)
    for k, v in extra.items():
        setattr(ns, k, v)
    return ns
