"""A pipeline over documents: quality rules, toxicity, near duplicates, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnspark.llm import line_cleaning, minhash, packing, shared, toxicity

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", line_cleaning.quality_stage),
    ("toxicity", toxicity.toxicity_stage),
    ("near_duplicates", minhash.dedup_stage),
    ("packing", packing.packing_stage),
]

#: SQL can't express the learned toxicity scores nor tokens; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder before the next reads it."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
