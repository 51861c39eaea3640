"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attach, written


def _least(edges: DataFrame) -> DataFrame:
    """Per u: the least of u and its neighbours, and their number."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))


def components(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``edges(a, b)``, of any ordered type -> ``(node, component)`` for every node with an edge; component: the least node reachable.

    Each round is two aggregations and joins by node (hot nodes are salted) and
    ends in a table in the shared folder; the number of rounds grows with the
    logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, mark = written(now, "edges"), None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach(both, _least(both), "u", "size", F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        small = attach(large, _least(large), "u", "size", F.col("v"))
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(links.filter("u <> v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
