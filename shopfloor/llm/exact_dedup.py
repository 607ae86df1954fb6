"""Exact duplicates: counting quotient filters, then byte verification.

1. Every scan partition builds a counting quotient filter of its texts'
   64-bit fingerprints. Only filters travel: a text that a partition holds a
   million times is one remainder with a count.
2. Filters are cut into quotient ranges and merged per range by their sorted
   remainders, without loss.
3. Fingerprints with a merged count above one route their texts to byte
   verification: a grouping by the text itself, combined before the shuffle.
   Two different texts with one fingerprint stay apart there.

Defined cases: a null text counts as empty; empty texts equal each other; of
equal texts the row with the largest doc_id stays (a null doc_id is smallest);
rows that repeat both doc_id and text are one document and share ``kept``;
other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common
from shopfloor.llm.quotient_filter import CountingQuotientFilter as Cqf

# Above this many repeated fingerprints (8 bytes each) they are joined by a
# shuffle instead of a broadcast.
BROADCAST_FINGERPRINTS = 1 << 21


def repeated_fingerprints(fps: DataFrame, n_parts: int) -> DataFrame:
    """``fps(fp long)`` to ``(fp long, n long)`` of the values that occur more than once."""

    n_ranges = 8 * n_parts  # several ranges a partition even out the hashing of ranges

    def build(batches):
        held, size = [], 0
        done = []
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= 1 << 20:
                done.append(Cqf.of(np.concatenate(held)))
                held, size = [], 0
        if held:
            done.append(Cqf.of(np.concatenate(held)))
        if done:
            rows = list(Cqf.merge(done).split(n_ranges))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in rows], pa.int32()),
                 pa.array([f.to_bytes() for _, f in rows], pa.binary())], ["range", "filter"])

    def merge(batches):
        by_range: dict[int, list[Cqf]] = {}
        for b in batches:
            for r, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_range.setdefault(r, []).append(Cqf.from_bytes(f))
        for filters in by_range.values():
            m = Cqf.merge(filters)
            often = m.count > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.fingerprints()[often].view(np.int64)), pa.array(m.count[often])], ["fp", "n"])

    return (fps.mapInArrow(common.lean(build), "range int, filter binary")
            .repartition(n_parts, "range")
            .mapInArrow(common.lean(merge), "fp long, n long"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size,
    kept, text_sha256, text_hash."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id"), common.text_or_empty().alias("text"))
    d = d.withColumn("fp", F.xxhash64("text"))
    repeated = common.written(repeated_fingerprints(d.select("fp"), common.parts(spark)), "repeated-fp")
    suspects = repeated.select("fp")
    if repeated.count() <= BROADCAST_FINGERPRINTS:
        suspects = F.broadcast(suspects)
    groups = (d.join(suspects, "fp", "left_semi")
              .groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1")
              .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = d.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256"))
    out = rows.join(groups, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.col("fp").alias("text_hash"))


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts."""
    verdict = common.written(exact_dedup(docs), "exact-dedup")
    out = common.without_rows(docs, verdict.where(~F.col("kept")).select("doc_id", "text_hash"))
    again = (verdict.where("kept and group_size > 1").groupBy("doc_id", "text_hash")
             .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash"))
    if again.isEmpty():
        return out
    # rows that repeat the id and text that stays: one of them
    twice = out.join(again, out["doc_id"].eqNullSafe(again["doc_id"])
                     & (common.text_hash(out["text"]) == again["text_hash"]), "left_semi")
    key = "text_"
    while key in docs.columns:
        key += "_"
    one = twice.withColumn(key, common.text_or_empty()).dropDuplicates(["doc_id", key]).drop(key)
    return common.without_rows(out, again).unionByName(one)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
