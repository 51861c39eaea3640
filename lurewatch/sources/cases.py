"""Cases in buckets by id (A9-A11): Parquet folders, one of which a look-up reads, and JSON lines to take along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import folders

BUCKETS = 64


class CaseStore:
    """Cases at ``path`` with the columns of ``schema``, which has ``case_id STRING`` and ``created_at STRING``: a folder per bucket of ids, files sorted by id.

    The number of buckets belongs to the files: it is kept beside them, and a store
    that is opened again has the one it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        try:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("error").json(f"{self.path}/made")
        except Exception as e:
            if getattr(e, "getCondition", lambda: "")() != "PATH_ALREADY_EXISTS":
                raise
        self.buckets = spark.read.schema("buckets int").json(f"{self.path}/made").first().buckets

    def _bucket(self, case_id: Column) -> Column:
        return F.pmod(F.xxhash64(case_id), F.lit(self.buckets)).cast("int")

    def _read(self) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        held = folders(self.spark, f"{self.path}/cases")
        return self.spark.read.schema(schema).parquet(f"{self.path}/cases") if held else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame:
        return self._read().drop("bucket")

    def save(self, cases: DataFrame) -> None:
        """Append cases; each batch adds one sorted file to a bucket."""
        rows = cases.select(*self.table().columns).withColumn("bucket", self._bucket(F.col("case_id")))
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "case_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/cases")

    def case(self, case_id: str) -> DataFrame:
        """A10: one case; its bucket's folder alone is read, and of that the row groups that may hold it."""
        return self._read().filter((F.col("bucket") == self._bucket(F.lit(case_id))) & (F.col("case_id") == case_id)).drop("bucket")

    def latest(self, limit: int = 50) -> DataFrame:
        """The newest first, 1 to 200."""
        return self.table().orderBy(F.desc("created_at"), "case_id").limit(max(1, min(limit, 200)))

    def export(self, path: str) -> None:
        """All cases as JSON lines, a folder for each day."""
        self.table().withColumn("case_day", F.to_date("created_at")).write.mode("overwrite").partitionBy("case_day").json(path)
