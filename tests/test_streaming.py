"""The streaming status equals the same rule over a static frame."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from shopfloor.registry import tables_for
from shopfloor.streaming import status_stream
from tests.conftest import SMOKE


def test_stream_matches_static(spark):
    t = tables_for(spark, SMOKE)
    readings = t.device_data.where(F.col("timestamp") < F.lit("2024-01-03").cast("timestamp_ntz"))
    land = tempfile.mkdtemp(prefix="land-")
    readings.repartition(4).write.mode("overwrite").parquet(land)
    sink, ckpt = tempfile.mkdtemp(prefix="sink-"), tempfile.mkdtemp(prefix="ckpt-")
    q = status_stream.start(spark, land, sink, ckpt, window="1 hour", slide="30 minutes", lateness="1 hour")
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    static = status_stream.windowed_status(spark.read.parquet(land), window="1 hour", slide="30 minutes")
    # append mode emits only windows closed by the watermark
    wm = spark.read.parquet(land).agg(F.max("timestamp")).collect()[0][0]
    closed = static.where(F.col("window_end") <= F.lit(wm) - F.expr("INTERVAL 1 HOUR"))
    cols = ["machine_id", "window_start", "window_end", "status_code"]
    got = sorted(map(tuple, streamed.select(*cols).collect()))
    want = sorted(map(tuple, closed.select(*cols).collect()))
    assert got and got == want


def test_minute_counters_stream_matches_batch_minutes(spark):
    from shopfloor.operators import oee
    from shopfloor.params import Params
    t = tables_for(spark, SMOKE)
    readings = t.device_data.where(F.col("timestamp") < F.lit("2024-01-05").cast("timestamp_ntz"))
    land = tempfile.mkdtemp(prefix="land-")
    readings.repartition(3).write.mode("overwrite").parquet(land)
    stream = status_stream.read_readings(spark, land)
    sink, ckpt = tempfile.mkdtemp(prefix="sink-"), tempfile.mkdtemp(prefix="ckpt-")
    q = (status_stream.minute_counters(stream, lateness="0 seconds").writeStream.outputMode("append")
         .format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r["machine_id"], r["minute"]): (r["n"], r["up"], r["down"]) for r in spark.read.parquet(sink).collect()}
    p = Params(start="2024-01-01 00:00:00", end="2024-01-05 00:00:00")
    batch = oee.minutes(t, p).where("n > 0")
    want = {(r["deviceuid"], r["minute"]): (r["n"], r["up"], r["down"]) for r in batch.collect()}
    # every minute the watermark closed equals the batch counters of that minute
    assert got and all(want[k] == v for k, v in got.items())
