"""Spark session settings shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on: wall-clock timestamps are NTZ and compared
# in UTC, ANSI casts fail loudly on bad payload text (as the reference's
# PostgreSQL casts do), and AQE re-plans joins / partition counts at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # A payload that repeats a key keeps the last value, as jsonb does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Stored payloads: a Parquet column per key, of which a query reads its own.
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
}

# Static settings (only honoured when the session is created).
STATIC_CONF = {
    # PySpark 4 records the Python call site of every Column for error
    # messages, at several JVM round trips per expression node; plans here
    # have thousands of nodes, so building them dominated small queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "shopfloor", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf.update(STATIC_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.sql."):
            continue
        spark.conf.set(k, v)
    return spark


def apply_query_conf(spark: SparkSession) -> None:
    """Make an externally created session follow the library's semantics."""
    for k, v in BASE_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``.  A local session that leaves it unset
    gets a scratch folder; on a cluster that is an error, since executors do
    not share machine-local folders.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="shopfloor-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet copy in the shared checkpoint folder: its lineage ends
    there, so an executor lost later repeats nothing of what made it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MB = 1024 * 1024


def cluster_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of telemetry.

    * scan splits of 256 MB (``maxPartitionBytes``) keep a task's JSON parse
      and typed rows well inside an executor core's memory share;
    * shuffle partitions: one per 256 MB of input, at least two waves of the
      cluster's cores (the typed store is appended per ingest batch, so no
      job shuffles the whole history); AQE then coalesces the small
      post-aggregation shuffles towards 128 MB and splits skewed partitions
      above 256 MB;
    * dimension sides up to 64 MB may be broadcast (checked by the planner
      and AQE from measured sizes, never by hints).

    The typed store sizes its buckets the same way (``telemetry.bucket_count``).
    """
    partitions = max(2 * cores, -(-input_bytes // (256 * MB)))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 * MB),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * MB),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * MB),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * MB),
    }
