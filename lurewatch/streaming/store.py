"""A keyed node and edge table, merged batch by batch (K1; J1-J5).

Layout below ``path``: ``nodes/v=<version>/bucket=<b>`` and ``edges/...`` hold one row
per key; ``manifest/<version>`` says which version of each bucket counts, and is the
ledger of the batches that are in.  A batch reads and rewrites the buckets that its
keys hash to and then writes the next manifest, a single file that appears at
once: until then the old state holds, and a batch that failed midway or comes
again changes nothing.  Reading costs one folder per bucket, however many batches
there were.

Of several writes of a key in one batch the latest payload wins, property by
property: by payload time, then by the place in the source.  A later batch beats
an earlier one.  There is one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.tables import delete, folders, written

NODES = "label STRING, key STRING, risk_score DOUBLE, name STRING, created_seq LONG, updated_seq LONG"
EDGES = "src_label STRING, src_key STRING, rel STRING, dst_label STRING, dst_key STRING, created_seq LONG, updated_seq LONG"
_ENDS = ["src_label", "src_key", "rel", "dst_label", "dst_key"]


class GraphStore:
    """The store at ``path``; made with ``buckets`` buckets if there is none, else with those it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.manifest = self._latest()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self._commit({"version": 0, "buckets": buckets, "ledger": {}, "nodes": {}, "edges": {}, "counts": {}})
        self.buckets = self.manifest["buckets"]

    def _latest(self) -> dict:
        """The newest manifest; there are two at most but for batches that are being written."""
        rows = self.spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(f"{self.path}/manifest").collect()
        return max((json.loads(r.value) for r in rows), key=lambda m: m["version"])

    def _commit(self, manifest: dict) -> None:
        place = f"{self.path}/manifest/{manifest['version']:012d}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(place)
        self.manifest = manifest

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        schema, at = NODES if table == "nodes" else EDGES, self.manifest[table]
        paths = [f"{self.path}/{table}/v={v}/bucket={b}" for b, v in at.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        """All nodes: label, key, risk_score, name, created_seq, updated_seq (numbers of batches)."""
        return self._read("nodes")

    def edges(self) -> DataFrame:
        return self._read("edges")

    def node(self, label: str, key: str) -> DataFrame:
        """One node, read from its bucket alone."""
        graph.check_label(label)
        one = self.spark.range(1).select(F.lit(label).alias("label"), F.lit(key).alias("key")).select(self.bucket("label", "key").alias("b")).first().b
        return self._read("nodes", [one]).filter((F.col("label") == label) & (F.col("key") == key))

    def _write(self, table: str, rows: DataFrame, version: int, *key: str) -> None:
        rows.withColumn("bucket", self.bucket(*key)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{table}/v={version}")

    def _touched(self, rows: DataFrame, *key: str) -> list[int]:
        return [r.b for r in rows.select(self.bucket(*key).alias("b")).distinct().collect()]

    def merge(self, nodes: DataFrame, edges: DataFrame, batch: int, source: str = "payloads") -> dict[str, int]:
        """Merge a batch of writes: ``nodes(label, key, risk_score, name, order)`` and ``edges`` (J2); says what was created and matched.

        ``order`` is any orderable column.  A batch of ``source`` that is not newer
        than the last one is already in and skipped.  Edges need both their ends,
        in the batch or in the store (J4).
        """
        now = self.manifest
        if batch <= now["ledger"].get(source, -1):
            return {}
        version = now["version"] + 1
        latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
        single = nodes.groupBy("label", "key").agg(latest("risk_score"), latest("name")).withColumn("seq", F.lit(version).cast("long"))
        single = written(single, "batch-nodes")
        touched = self._touched(single, "label", "key")
        self._write("nodes", graph.upsert_nodes(self._read("nodes", touched), single), version, "label", "key")
        at = now["nodes"] | dict.fromkeys(map(str, touched), version)
        self.manifest = now | {"nodes": at}  # for the reads below; nothing is committed yet
        try:
            links = written(edges.select(*_ENDS).distinct(), "batch-edges")
            ends = links.select(F.col("src_label").alias("label"), F.col("src_key").alias("key")).unionByName(links.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")))
            links = graph.upsert_edges(None, links, self._read("nodes", self._touched(ends, "label", "key"))).withColumn("seq", F.lit(version).cast("long"))
            links = written(links, "batch-links")
            linked = self._touched(links, "src_label", "src_key")
            both = links.withColumn("created_seq", F.col("seq")).unionByName(self._read("edges", linked).withColumnRenamed("updated_seq", "seq"))
            merged = both.groupBy(*_ENDS).agg(F.min("created_seq").alias("created_seq"), F.max("seq").alias("updated_seq"))
            self._write("edges", merged, version, "src_label", "src_key")
            counts = {}
            for table, buckets in (("nodes", touched), ("edges", linked)):
                self.manifest = self.manifest | {table: now[table] | dict.fromkeys(map(str, buckets), version)}
                new = self._read(table, buckets).filter(F.col("updated_seq") == version).agg(F.count_if(F.col("created_seq") == version), F.count_if(F.col("created_seq") < version)).first()
                counts |= {f"{table}_created": new[0], f"{table}_matched": new[1]}
            done = self.manifest | {"version": version, "ledger": now["ledger"] | {source: batch}, "counts": counts}
        finally:
            self.manifest = now
        self._commit(done)
        return counts

    def vacuum(self) -> int:
        """Delete bucket folders and manifests that the newest manifest doesn't need; only when nobody reads an older state."""
        keep = {f"{t}/v={v}/bucket={b}" for t in ("nodes", "edges") for b, v in self.manifest[t].items()}
        found = [f"{t}/{v}/{b}" for t in ("nodes", "edges") for v in folders(self.spark, f"{self.path}/{t}") for b in folders(self.spark, f"{self.path}/{t}/{v}")]
        old = [f for f in found if f not in keep] + [f"manifest/{m}" for m in folders(self.spark, f"{self.path}/manifest") if int(m) < self.manifest["version"]]
        return sum(delete(self.spark, f"{self.path}/{f}") for f in old)
