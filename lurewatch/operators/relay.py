"""Relay hops (B13, F1, F2) and bursts of mail (K2, batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import ip_class

SKEW_SECONDS = 300


def hop_delays(hops: DataFrame) -> DataFrame:
    """``hops(email_id, hop, ts, ...)`` with the delay against the last earlier hop that has a time, and the flags."""
    earlier = Window.partitionBy("email_id").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("ts", ignorenulls=True).over(earlier)
    delay = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    return hops.withColumn("delay_s", delay).withColumns({"time_skew": F.coalesce(F.abs("delay_s") > SKEW_SECONDS, F.lit(False)), "timestamp_missing": F.col("ts").isNull()})


def origins(hops: DataFrame) -> DataFrame:
    """per email the first hop with a public address and its confidence; the host of hop 1 and the first address of any kind."""
    public = ip_class(F.col("from_ip")) == "public"
    pick = hops.groupBy("email_id").agg(
        F.min(F.when(public, F.col("hop"))).alias("origin_hop"),
        F.min_by("from_ip", F.when(public, F.col("hop"))).alias("origin_ip"),
        F.min_by("from_host", "hop").alias("fallback_host"),
        F.min_by("from_ip", F.when(F.col("from_ip").isNotNull(), F.col("hop"))).alias("sender_ip"),
    )
    level = F.when(F.col("origin_hop") == 1, "high").when(F.col("origin_hop") == 2, "medium").when(F.col("origin_hop") >= 3, "low").otherwise("none")
    return pick.withColumn("confidence", level)


def bursts(mails: DataFrame, key: str, gap: str = "2 hours") -> DataFrame:
    """K2: sessions of rows of a key less than ``gap`` apart: start, end of the last row's gap, count."""
    return mails.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
