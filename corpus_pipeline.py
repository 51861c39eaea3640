"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing of ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.  Stages inherit the defined cases of their
operators (see ``lurewatch.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm import exact_dedup, mixing, near_dedup, packing, quality
from lurewatch.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; trusted ones are those labelled as of good quality."""
    return quality.passing(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix of domains, languages and sources."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of fixed length."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Near-dedup and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
