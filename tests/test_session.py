"""Session helpers: cluster sizing, store buckets, nested record."""

from __future__ import annotations

from shopfloor.operators import overview
from shopfloor.params import DEFAULT
from shopfloor.registry import tables_for
from shopfloor.session import cluster_conf
from shopfloor.sources import telemetry as tm
from tests.conftest import SMOKE


def test_cluster_conf_sizing():
    big = cluster_conf(100 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    small = cluster_conf(10 * 1024 ** 2, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 ** 2


def test_bucket_count_has_no_cap():
    assert tm.bucket_count(10, 8) == 8
    assert tm.bucket_count(100 * 1024 ** 4, 8000) == 100 * 1024 ** 4 // (256 * 1024 ** 2)


def test_nested_machine_record_matches_flat(spark):
    t = tables_for(spark, SMOKE)
    flat = {r["machine_uid"]: r for r in overview.machine_complete(t, DEFAULT).collect()}
    nested = overview.machine_complete(t, DEFAULT, nested=True).collect()
    assert len(nested) == len(flat)
    for r in nested:
        f = flat[r["machine_uid"]]
        assert r["machine_data"]["machine_status"] == f["machine_status"]
        assert r["production_data"]["produced_reels"] == f["produced_reels"]
        assert r["oee_data"]["oee"] == f["oee"]


def test_params_validation():
    import pytest

    from shopfloor.params import Params
    with pytest.raises(ValueError):
        Params(sequence_bucket="week")
    with pytest.raises(ValueError):
        Params(holiday_match="fuzzy")
    assert Params().with_(sequence_bucket="minute").sequence_bucket == "minute"
