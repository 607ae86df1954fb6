"""Stored dimension tables (SK1-SK3): every batch of changes publishes a version.

A table is a folder with a sub-folder per batch number, each a complete Parquet
table. Spark's committer puts ``_SUCCESS`` into a folder when the whole job has
committed, so a version is there or not: a job that dies leaves the table as it
was, readers of an older version are not disturbed, and a batch that was already
applied is not applied again. The newest complete version is the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "batch="


def _folder(spark: SparkSession, path: str):
    """Hadoop path and file system of a folder (any store that Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending (folder names alone are read)."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith(_PREFIX) and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n[len(_PREFIX):]) for n in done)


def read(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The newest version, or that of a batch."""
    done = batches(spark, path)
    if not done or batch is not None and batch not in done:
        raise ValueError(f"no complete version {'' if batch is None else batch} at {path}")
    return spark.read.parquet(f"{path}/{_PREFIX}{done[-1] if batch is None else batch}")


def publish(table: DataFrame, path: str, batch: int) -> None:
    """Write a version; what a failed attempt at the same batch left is replaced."""
    table.write.mode("overwrite").parquet(f"{path}/{_PREFIX}{batch}")


def apply(spark: SparkSession, path: str, batch: int, change: Callable[[DataFrame], DataFrame]) -> bool:
    """Publish ``change(table)`` as version ``batch``; False if the batch is already
    applied. Batches are applied in the order of their numbers."""
    done = batches(spark, path)
    if done and batch <= done[-1]:
        return False
    publish(change(read(spark, path)), path, batch)
    return True
