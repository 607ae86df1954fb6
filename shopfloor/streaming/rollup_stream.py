"""The rollup of minutes fed by a stream (streaming form of M5-M7, M10-M18).

Every micro-batch is a batch of the rollup, under its own number. A minute that
gets late readings is computed again from all its readings, so neither the order of
arrival nor a watermark changes a result: metrics over the rollup equal those over
all readings that have arrived. A micro-batch that is run again after a restart
replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfloor.operators import oee
from shopfloor.streaming.status_stream import DEVICE_DATA_SCHEMA, read_readings


def start(spark: SparkSession, source: str, path: str, checkpoint: str, max_files_per_trigger: int | None = None):
    """Feed the rollup at ``path`` from readings that land as Parquet files under
    ``source``; the checkpoint folder (shared storage) makes it restartable."""
    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            arrived = batch.sparkSession.read.schema(DEVICE_DATA_SCHEMA).parquet(source)
            oee.append_rollup(batch, arrived, path, number)

    return (read_readings(spark, source, max_files_per_trigger).writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
