"""Live machine status (M3) over a stream of readings.

The batch form asks "what was each machine doing in the last 15 minutes
before ``as_of``"; the streaming form answers it continuously: readings
arrive as a stream, a sliding event-time window of ``window`` (default 15
minutes, sliding every ``slide``) is kept per device, and each window gets
the same status code as the batch rule (``operators.status``).  The
watermark bounds state: a reading later than ``lateness`` behind the newest
event time is dropped and finished windows are emitted once (append mode).

The same function runs on a static DataFrame, which is how it is tested
against the batch rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.operators.status import IDLE, RUNNING, SLOW, STOPPED, UNKNOWN
from shopfloor.sources import telemetry as tm

DEVICE_DATA_SCHEMA = "deviceuid string, timestamp timestamp_ntz, data string"


def windowed_status(device_data: DataFrame, window: str = "15 minutes", slide: str = "1 minute",
                    lateness: str = "15 minutes") -> DataFrame:
    """(device, window) -> status code of the window's maxima."""
    # Event time must be TIMESTAMP for watermarks; the session runs in UTC,
    # so the wall-clock NTZ value converts one to one.
    typed = (tm.typed(tm.parse(device_data))
             .select("deviceuid", F.col("ts").cast("timestamp").alias("event_time"), "ts",
                     "mc_status", "act_speed", "target_speed"))
    if device_data.isStreaming:
        typed = typed.withWatermark("event_time", lateness)
    g = (typed.groupBy("deviceuid", F.window("event_time", window, slide).alias("w"))
         .agg(F.max("mc_status").alias("mc"), F.max("act_speed").alias("speed"),
              F.max("target_speed").alias("target"), F.max("ts").alias("last_data_time")))
    mc, sp, tg = F.col("mc"), F.col("speed"), F.col("target")
    code = (F.when(mc == 0, F.lit(STOPPED))
            .when((mc == 1) & (sp == 0), F.lit(IDLE))
            .when((mc == 1) & (sp < F.lit(0.5) * tg), F.lit(SLOW))
            .when(mc == 1, F.lit(RUNNING))
            .otherwise(F.lit(UNKNOWN)))
    return g.select(F.col("deviceuid").alias("machine_id"),
                    F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "last_data_time", code.alias("status_code"))


def read_readings(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of ``device_data`` rows landing as Parquet files under ``path``."""
    r = spark.readStream.schema(DEVICE_DATA_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, **kw):
    """Run the status stream from a Parquet landing folder into a Parquet
    sink; the checkpoint folder (shared storage) makes it restartable after
    a lost driver or executor."""
    q = (windowed_status(read_readings(spark, source), **kw)
         .writeStream.outputMode("append").format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return q


def minute_counters(device_data: DataFrame, lateness: str = "15 minutes") -> DataFrame:
    """Per (device, minute): the availability counters of M10 (readings with
    a status, running, stopped), as a tumbling event-time window.  Appended
    once the watermark closes a minute; the per-device availability is a sum
    over these rows (``operators.oee.availability``'s second level)."""
    typed = (tm.typed(tm.parse(device_data)).where(F.col("has_mc"))
             .select("deviceuid", F.col("ts").cast("timestamp").alias("event_time"), "mc_status"))
    if device_data.isStreaming:
        typed = typed.withWatermark("event_time", lateness)
    g = (typed.groupBy("deviceuid", F.window("event_time", "1 minute").alias("w"))
         .agg(F.count(F.lit(1)).alias("n"),
              F.count_if(F.col("mc_status") == 1).alias("up"),
              F.count_if(F.col("mc_status") == 0).alias("down")))
    return g.select(F.col("deviceuid").alias("machine_id"),
                    F.col("w.start").cast("timestamp_ntz").alias("minute"), "n", "up", "down")
