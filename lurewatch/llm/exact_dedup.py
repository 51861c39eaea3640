"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by the SHA-256 of the text.
A batch is reduced to one row per digest, a sort-merge anti-join against the
index leaves the digests that are new (the index side needs no shuffle), and
those are appended, under the batch's name, so that a batch that is run again
finds what it stored itself.

Defined cases: null text counts as empty text; of equal texts in a batch the
row with the largest doc_id stays (a null doc_id is smaller than any other),
and of rows that repeat that doc_id too exactly one stays; if the index already
held the digest no row of the batch stays; an empty batch appends nothing;
further columns are carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, fanout, own_name, written, work_path


class DigestIndex:
    """Digests seen so far: ``digest, keep_id, batch``, bucketed and sorted by digest.

    Opening an existing ``path`` again needs the bucket number it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or fanout(spark)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups(digest, keep_id)`` that the index lacks, under the batch's name; what an earlier attempt at the batch stored is left as it is."""
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.name)

    def compacted(self, path: str) -> DigestIndex:
        """The same index at ``path`` with one sorted file a bucket; every batch adds one, so do this from time to time."""
        out = DigestIndex(self.spark, path, self.buckets)
        self.table().repartition(self.buckets, "digest").write.insertInto(out.name)
        return out

    def close(self) -> None:
        """Take the index out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")


def _digested(docs: DataFrame) -> tuple[DataFrame, str, str]:
    digest, row = own_name(docs, "digest"), own_name(docs, "row")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(digest, F.unhex(F.sha2(text, 256))).withColumn(row, F.monotonically_increasing_id()), digest, row


def _decide(rows: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """``rows(doc_id, digest, row)``: one row per digest, with the row that stays, the batch's count and whether the digest is new, as a written table."""
    spark, own = rows.sparkSession, index is None
    index, batch = index or DigestIndex(spark, work_path(spark, "digest-index")), batch or uuid.uuid4().hex
    best = F.max(F.struct("doc_id", "row"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    # written, so that the optimizer can't move the anti-join below the aggregation and send a common text's rows to one task
    groups = written(groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "digest-groups")
    index.append(groups.select("digest", "keep_id"), batch)
    held = index.table().select("digest", F.col("keep_id").alias("held_id"), (F.col("batch") == batch).alias("new"))
    found = groups.join(held.hint("merge"), "digest")
    decided = written(found.select("digest", F.when(F.col("new"), F.col("keep_id")).otherwise(F.col("held_id")).alias("keep_id"), "keep_row", "group_size", "new"), "decided")
    if own:
        index.close()
    return decided


def verdicts(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size (in this batch), kept, text_sha256.

    ``batch`` names the batch: a job that died after it had appended to the index
    is run again under the same name and decides as it would have the first time.
    """
    rows = written(_digested(docs.select("doc_id", "text"))[0].drop("text"), "digests")
    decided = _decide(rows, index, batch).withColumn("n", F.col("group_size"))
    out = attach(rows, decided, "digest", "n", F.col("row"))
    kept = F.col("new") & (F.col("row") == F.col("keep_row"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; ``batch`` as for ``verdicts``.

    Decided on row numbers; the texts meet only the numbers of the rows that fall.
    """
    marked, digest, row = _digested(docs)
    rows = written(marked, "digested")
    keys = rows.select("doc_id", F.col(digest).alias("digest"), F.col(row).alias("row"))
    stay = _decide(keys, index, batch).filter("new").select(F.col("keep_row").alias("row"))
    fall = written(keys.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", own_name(rows, "fallen")), "fallen")
    return rows.join(fall, F.col(row) == F.col(fall.columns[0]), "left_anti").select(*docs.columns)
