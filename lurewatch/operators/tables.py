"""Intermediate tables in a shared folder, and a join that survives hot keys."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else one beside the warehouse's tables.

    Without ``spark.checkpoint.dir`` a warehouse on the machine's own disk will
    do only if the master is local, too.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if folder.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("intermediate tables need a folder that driver and executors share: set spark.checkpoint.dir")
    return f"{folder}/_work"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lurewatch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever file system it is; whether there was one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()] if system.exists(place) else []


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of the shared folder; only when no job runs."""
    delete(spark, f"{shared_dir(spark)}/lurewatch")


def release(spark: SparkSession) -> None:
    """Delete the shuffle files of DataFrames that nothing refers to any more.

    Spark does so when the driver's JVM collects their owners, which on a large
    heap may be long after; call it behind a ``written`` that ends a costly step.
    """
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(left: DataFrame, right: DataFrame, key: str, size: str, spread: Column, *, heavy: int = 1000, salts: int = 64) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row per ``key``), safe when one key holds most of ``left``.

    ``right[size]`` is the number of ``left`` rows of the key.  Keys with over
    1/``heavy`` of all rows -- at most ``heavy`` of them, so marking them by a
    broadcast has a proven bound -- are dealt over ``salts`` partitions by
    ``spread``; their single right row is repeated for each salt.
    """
    salt, hot = own_name(left, "salt"), own_name(left, "hot")
    total = right.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(1000, total // heavy)
    many = right.filter(is_hot).select(F.col(key).alias(hot))
    marked = left.join(F.broadcast(many), left[key].eqNullSafe(many[hot]), "left")
    marked = marked.withColumn(salt, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop(hot)
    copies = right.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return marked.join(copies.drop(size), [key, salt]).drop(salt)


def pair_chunks(rows: DataFrame, key: str, spread: str, size: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides, and the condition, of a join of ``rows`` with themselves by ``key`` in which no task holds a whole hot key.

    A key's rows are dealt over chunks of about ``size`` by a hash of ``spread``, and
    each pair of chunks is a join key of its own.  The sides' columns end in ``_x``
    and ``_y``; a pair of rows meets once, in either order.  Keys with a single row
    are dropped.
    """
    counted = rows.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows >= 2").withColumn("n_chunks", F.ceil(F.col("n_rows") / size).cast("int"))
    dealt = attach(rows, counted, key, "n_rows", F.col(spread)).withColumn("chunk", F.pmod(F.xxhash64(spread), F.col("n_chunks")).cast("int"))
    names = [c for c in rows.columns if c != key]
    left = dealt.select(F.col(key).alias("key_x"), F.col("chunk").alias("i_x"), F.explode(F.expr("sequence(chunk, n_chunks - 1)")).alias("j_x"), *(F.col(c).alias(f"{c}_x") for c in names))
    right = dealt.select(F.col(key).alias("key_y"), F.explode(F.expr("sequence(0, chunk)")).alias("i_y"), F.col("chunk").alias("j_y"), *(F.col(c).alias(f"{c}_y") for c in names))
    same = (F.col("key_x") == F.col("key_y")) & (F.col("i_x") == F.col("i_y")) & (F.col("j_x") == F.col("j_y"))
    once = (F.col("i_x") < F.col("j_x")) | (F.col(f"{spread}_x") < F.col(f"{spread}_y"))
    return left, right, same & once & (F.col(f"{spread}_x") != F.col(f"{spread}_y"))
