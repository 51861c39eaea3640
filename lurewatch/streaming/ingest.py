"""Streaming ingest of payloads (K1) and burst windows (K2)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import normalize as norm
from ..operators.graph import payload_graph
from ..sources.readers import PAYLOAD, repaired
from .store import GraphStore


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of a folder of JSON lines, with the place that each was read from."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("place")
    return spark.readStream.schema(PAYLOAD).json(path).select("*", place)


def payload_order(*place: str | Column) -> Column:
    """Of payloads about the same thing the latest counts: by its own time, then by its place in the source."""
    return F.struct(norm.timestamp(F.col("email.timestamp")).alias("at"), *place)


def ingest_batch(store: GraphStore, payloads: DataFrame, batch: int, source: str = "payloads") -> dict[str, int]:
    """K1: one batch of payloads with ``place``, any orderable column, into the store; the rows of a place come in their order."""
    rows = payloads.withColumn("row", F.monotonically_increasing_id())
    fixed = repaired(rows, "place", "row")
    return store.merge(*payload_graph(fixed, payload_order("place", "row")), batch, source)


def start_ingest(payloads: DataFrame, store: GraphStore, checkpoint: str, source: str = "payloads") -> StreamingQuery:
    """K1: merge each micro-batch into ``store``: nodes and edges, once, whatever is repeated."""

    def save(batch: DataFrame, number: int) -> None:
        ingest_batch(store, batch, number, source)

    return payloads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def burst_windows(mails: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """K2: mails of a key in tumbling hours, for a stream or a table with ``ts``."""
    return mails.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def burst_sessions(mails: DataFrame, key: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """K2: bursts of a key's mails that lie less than ``gap`` apart, for a stream or a table with ``ts``: key, start, end (the last mail's time plus the gap), n."""
    found = mails.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def start_sessions(mails: DataFrame, key: str, out: str, checkpoint: str, gap: str = "2 hours", late: str = "1 day") -> StreamingQuery:
    """K2 on a stream: a session is appended to the Parquet folder ``out`` once the watermark, ``late`` behind the newest mail, has passed its end.

    Mails within the delay may come in any order; ``late_rows`` says how many came after it and are in no session.
    """
    found = burst_sessions(mails, key, gap, late)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's recent batches left out because they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in json.loads(progress.json)["stateOperators"])
