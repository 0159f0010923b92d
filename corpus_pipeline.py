"""The corpus pipeline: documents through five operators, each stage written as Parquet.

Every stage function takes (spark, docs, sf_dir); all but the last return the columns of
documents.  Empty tables pass through; nulls, repeated rows and long texts are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from tessera.llm.tables import batches_by_bytes, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    batches_by_bytes(spark)
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks shared with an earlier document go; documents left without a word go."""
    batches_by_bytes(spark)
    return line_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, 0.8)."""
    batches_by_bytes(spark)
    return near_dup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a test item's shingles go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the training sequences."""
    batches_by_bytes(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dup", near),
          ("decontaminate", benchmark), ("best_fit_packing", pack)]

#: graph components, patience alignment and the linear program have no SQL form; the stages
#: are tested against brute force in tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
