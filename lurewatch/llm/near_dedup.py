"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification, components.

Circulant MinHash needs two permutations of a fixed universe: one scatters the
shingles, the other, shifted by k places, gives signature coordinate k.  For a
shingle at place p the coordinates are the run ``pi[p:p + K]``, so a signature is
the elementwise minimum over such runs.

Steps: (1) one Arrow pass gives each document's set size, set fingerprint and
band keys; (2) equal sets collapse to their smallest doc_id; (3) in every band
bucket the members are compared with the smallest one on full sets; (4) the
links' components are formed, and in buckets that still hold several
components the pairs across components that were not compared yet are compared
too, unless a bound rules them out: the common bits of two 1024-bit marks of the
sets, plus the smaller number of collisions within a set, are at least the
intersection.  The bound is part of the join's condition, so only pairs close to
the threshold come out of it, and no pair that shares a bucket is left open; a
bucket with many sets is cut into chunks, and each pair of chunks is a join key;
(5) components over all links.

With BANDS x ROWS = 48 x 7 a pair with similarity 0.75 shares no bucket with
probability 0.001, one with 0.8 with 1e-5.

Defined cases: null, empty and blank texts have empty sets and link with
nothing, as do rows with a null doc_id (component null, kept); rows that repeat
a doc_id are one node; repeated texts under other ids are one class; an empty
table gives an empty result; further columns are carried by ``deduplicate``
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, own_name, pair_chunks, written
from .textarrays import Texts, U, lists, mix, pieces, signed, windows

WORDS, PERCENT = 5, 75
BANDS, ROWS = 48, 7
#: Longs of a set's mark; sets of a bucket that one task compares with each other, on average.
MARK, CHUNK = 16, 512
UNIVERSE = 1 << 20
SEED = 20


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all runs of the other one."""
    rng = np.random.default_rng(SEED)
    first, second = (rng.permutation(UNIVERSE).astype(np.uint32) for _ in range(2))
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: BANDS * ROWS]]), BANDS * ROWS)


def _shingles(texts: Texts) -> Iterator[np.ndarray]:
    """The set of distinct shingle hashes of each text, ascending."""
    words = texts.hashes(lower=True)
    found = windows(words, WORDS)
    for a, n in zip(texts.first, texts.counts, strict=False):
        if n >= WORDS:
            yield np.unique(found[a : a + n - WORDS + 1])
        elif n:
            yield windows(words[a : a + n], int(n)) ^ U(n)
        else:
            yield found[:0]


def _bands(shingles: np.ndarray) -> np.ndarray:
    scatter, runs = _permutations()
    places = scatter[(shingles & U(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(least, runs[places[i : i + 1024]].min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=U)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * U(0x9E3779B97F4A7C15) + column)
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sizes, prints, keys = [], [], []
        for s in _shingles(Texts(batch.column("text"))):
            sizes.append(len(s))
            if len(s):
                prints.append(np.array([mix(s).sum(), mix(s ^ U(0x5555555555555555)).sum(), len(s)], U).tobytes())
                keys.append(_bands(s))
            else:
                prints.append(None)
        flat = signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        per = np.array([BANDS if n else 0 for n in sizes])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists(flat, per, pa.int64())], ["doc_id", "n_shingles", "print", "bands"])


def _mark(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit for each shingle, and the number of shingles whose bit another one had set."""
    bits = np.zeros(MARK * 64, bool)
    bits[((shingles >> U(7)) % U(MARK * 64)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64), len(shingles) - int(bits.sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = list(_shingles(Texts(batch.column("text"))))
        flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        marks = [_mark(s) for s in sets]
        mark = lists(np.concatenate([m for m, _ in marks]) if sets else np.zeros(0, np.int64), np.full(len(sets), MARK), pa.int64())
        columns = [batch.column("doc_id"), lists(flat, np.array([len(s) for s in sets]), pa.int64()), mark, pa.array([k for _, k in marks], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "shingles", "mark", "spare"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar enough; a hot side a is salted."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("size"))
    full = sets.select("rep", "shingles")
    right = full.withColumnsRenamed({"rep": "a", "shingles": "set_a"}).join(counts, "a")
    left = pairs.join(full.withColumnsRenamed({"rep": "b", "shingles": "set_b"}), "b")
    both = attach(left, right, "a", "size", F.col("b")).withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    return both.filter((F.col("shared") > 0) & (100 * F.col("shared") >= PERCENT * union)).select("a", "b").distinct()


def _marked(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per set of ``placed(rep, n_shingles, component, key)`` with its keys, at most ``BANDS``, and its mark, which is joined once and not for each key."""
    return placed.groupBy("rep", "n_shingles", "component").agg(F.collect_list("key").alias("keys")).join(sets.select("rep", "mark", "spare"), "rep")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and one row per distinct set: print, rep (least doc_id), n_docs, n_shingles, bands."""
    rows = docs.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, n_shingles long, print binary, bands array<long>")
    rows = written(rows, "signatures")
    linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "bands")).alias("first")
    reps = linked.groupBy("print").agg(first, F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"))
    return rows, written(reps.select("print", F.col("first.doc_id").alias("rep"), "n_docs", "n_shingles", F.col("first.bands").alias("bands")), "classes")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed links ``(a, b)`` between representatives: enough of them that components are those of all links in shared buckets."""
    keyed = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").drop("last")
    members = written(keyed.join(leaders, "key"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "rep long, shingles array<long>, mark array<long>, spare int")
    sets = written(sets, "sets")
    star = written(members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    found = written(_confirmed(star, sets), "star-links")
    placed = members.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = written(placed.drop("leader"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ = _marked(placed.join(mixed, "key"), sets).withColumn("key", F.explode("keys")).drop("keys")
    left, right, meet = pair_chunks(open_, "key", "rep", CHUNK)
    common = sum((F.bit_count(F.col("mark_x")[i].bitwiseAND(F.col("mark_y")[i])) for i in range(MARK)), F.least("spare_x", "spare_y"))
    most = F.least(common, "n_shingles_x", "n_shingles_y")  # of the intersection
    near = 100 * most >= PERCENT * (F.col("n_shingles_x") + F.col("n_shingles_y") - most)
    across = left.join(right, meet & (F.col("component_x") != F.col("component_y")) & near)
    across = across.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()
    across = written(across.join(star, ["a", "b"], "left_anti"), "cross-pairs")
    return found.unionByName(_confirmed(across, sets))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs(doc_id, text)``."""
    rows, reps = classes(docs)
    groups = components(links(docs, reps)).withColumnRenamed("node", "rep")
    named = reps.join(groups, "rep", "left").select("print", "n_docs", F.coalesce("component", "rep").alias("component_id"))
    rows = rows.drop("bands")
    linked = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    out = attach(rows.filter(linked), named, "print", "n_docs", F.col("doc_id")).select("doc_id", "n_shingles", "component_id")
    rest = rows.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest, with their columns."""
    key = own_name(docs, "dropped_id")
    dropped = verdicts(docs).filter("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped[key], "left_anti")
