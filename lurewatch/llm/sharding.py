"""Sharding by extendible hashing (DataFrame operations only).

A directory is indexed by the first ``depth`` bits of a document's hash.  All
documents start in one shard; a shard over the byte limit is split on its next
hash bit, the others stay whole, until every shard fits.  Splits are decided on
byte sums by directory cell (at most ``2 ** STEP`` rows); cells still over the
limit are looked at again, ``NEXT`` bits further on at a time, with only their
documents; a cell of a single hash goes to the last bit at once.

Defined cases: null and empty texts have no bytes but belong to a shard; a
document over the limit ends in a shard of its own, as do rows that no hash bit
tells apart (equal doc_id and text), and such shards are marked ``oversized``;
null ids are hashed as any others; an empty table gives an empty result;
further columns are carried by ``write_shards`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, own_name, written

LIMIT = 8 << 20
STEP, NEXT = 14, 4
BITS = 56


def hash_bits(doc_id: Column, text: Column) -> Column:
    """``BITS`` bits of a hash of the row, as a long."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def _bits(done: int) -> int:
    """Bits of the next step: few after the first, since cells then are nearly as many as documents."""
    return min(NEXT if done else STEP, BITS - done)


def _split(rows: DataFrame, done: int, limit: int) -> DataFrame:
    """``rows(h, bytes)`` with equal first ``done`` bits per cell: depth of each directory cell's shard, -1 if deeper than this step."""
    bits = _bits(done)
    cell = F.shiftright("h", BITS - done - bits)
    cells = rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), (F.min("h") == F.max("h")).alias("alone"))
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level"))
    prefix = F.expr(f"shiftright(cell, {bits} - level)")
    sums = levels.groupBy("level", prefix.alias("prefix")).agg(F.sum("bytes").alias("total"))
    fits = levels.withColumn("prefix", prefix).join(sums.filter(F.col("total") <= limit), ["level", "prefix"])
    depth = fits.groupBy("cell").agg(F.min("level").alias("level"))
    return cells.select("cell", "alone").join(depth, "cell", "left").select("cell", F.coalesce(F.col("level") + done, F.when(F.col("alone"), BITS), F.lit(-1)).alias("depth"))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows(doc_id, h, bytes)`` with ``depth`` of the shard and its bit string ``shard``."""
    done, left, parts = 0, rows, []
    while True:
        cells = _split(left, done, limit)
        shift = BITS - done - _bits(done)
        # at most 2 ** STEP cells in the first round; later rounds hold the cells of oversized ones only
        side = F.broadcast(cells) if done == 0 else cells
        placed = left.withColumn("cell", F.shiftright("h", shift)).join(side, "cell").drop("cell")
        done += _bits(done)
        deeper = written(placed.filter("depth < 0").drop("depth"), "shard-deeper")
        last = done == BITS
        parts.append(placed.withColumn("depth", F.when(F.col("depth") < 0, done).otherwise(F.col("depth"))) if last else placed.filter("depth >= 0"))
        if last or deeper.isEmpty():
            break
        left = deeper
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bits = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0")
    return out.withColumn("shard", F.substring(bits, F.lit(1), F.col("depth")))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard (bit string), depth, shard_docs, shard_bytes, oversized for each row of ``docs(doc_id, text)``."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    rows = written(docs.select("doc_id", hash_bits(F.col("doc_id"), F.col("text")).alias("h"), size.alias("bytes")), "shard-rows")
    placed = directory(rows, limit)
    shards = placed.groupBy("shard").agg(F.count("*").alias("shard_docs"), F.sum("bytes").alias("shard_bytes"))
    out = attach(placed, shards.withColumn("size", F.col("shard_docs")), "shard", "size", F.col("h"))  # an oversized shard of repeated rows may hold any number
    return out.select("doc_id", "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_docs", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the rows of ``docs`` to ``path``, one folder and file for each shard; the folders are named ``shard=s<bits>``, with a longer name for ``shard`` if ``docs`` has such a column."""
    h, size, shard = own_name(docs, "h"), own_name(docs, "bytes"), own_name(docs, "shard")
    marked = docs.withColumns({h: hash_bits(F.col("doc_id"), F.col("text")), size: F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")})
    rows = written(marked, "shard-docs")
    shards = directory(rows.select(F.col(h).alias("h"), F.col(size).alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes")), limit).select(F.col("h").alias(h), F.concat(F.lit("s"), "shard").alias(shard))
    rows.join(shards, h).drop(h, size).repartition(shard).write.partitionBy(shard).parquet(path)
