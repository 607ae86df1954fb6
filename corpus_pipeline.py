"""Corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. A stage drops
rows and changes none: toxic documents, all but one of equal texts, all but
one of each near-duplicate component, documents with a benchmark window. The
last stage gives the sampled segmentations of what remains.

Defined cases are those of the operators; rows are told apart by id and text,
so a null id or an id on two texts is handled, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfloor.llm import common, decontaminate, exact_dedup, near_dup, pieces, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.civil_documents(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return exact_dedup.unique_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return near_dup.distinct_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return pieces.segmentations(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

# A trained model and sampled segmentations are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
