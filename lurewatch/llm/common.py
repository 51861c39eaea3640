"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.tables import attach, own_name, pair_chunks, release, work_path, written

__all__ = ["SPACE", "attach", "components", "fanout", "lower_ascii", "own_name", "pair_chunks", "release", "table", "words", "work_path", "written"]

#: Characters that separate words; a word is a maximal run of others.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fanout(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
