"""Helpers shared by the training-data operators: tables, shared folder, batching."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts reach Python in Arrow batches of this many rows and bytes, so that a batch of
# long documents stays small next to a worker's memory.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
# Numpy kernels take at most this many text bytes at once (a longer single
# text is its own chunk); their scratch arrays need up to 300 bytes per byte.
CHUNK_BYTES = 1 << 19
# Lists of rows (two numbers each) up to this length are broadcast, longer
# ones joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def arrow_limits(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_limits(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A session without the setting gets a scratch folder in local mode only;
    on a cluster a missing setting is an error, because a machine-local folder
    would lose data between executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="shopfloor-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and reread it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without_rows(docs: DataFrame, unwanted: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text (``unwanted``: doc_id and
    text_hash, see ``text_hash``) are unwanted; null ids compare equal."""
    u = written(unwanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "unwanted")
    if u.count() <= BROADCAST_ROWS:
        u = F.broadcast(u)
    return docs.join(u, docs["doc_id"].eqNullSafe(u["_id"]) & (text_hash(docs["text"]) == u["_hash"]), "left_anti")


def text_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` of at most ``limit`` bytes (or one text)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if len(texts) > lo:
        yield lo, len(texts)


def release_memory() -> None:
    """Hand freed memory back to the system, which the C library otherwise keeps for a
    worker's next arrays; an idle worker then stays small (no effect elsewhere)."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn):
    """A function of batches for ``mapInArrow`` (or of rows, for ``mapPartitions``) whose
    worker ends each task small, Arrow's pool included: idle workers wait beside the busy
    ones of the next stage."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            release_memory()

    return run


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings; null counts as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
