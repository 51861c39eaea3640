"""Filter interaction audit: a sparse document-term matrix, and what filters do in every order.

Steps: (1) one Arrow pass cuts the texts into blocks; a block holds its rows'
word counts as a CSR matrix over the block's own vocabulary, that vocabulary,
and what else the filters need of a text; (2) all blocks' words together are
ranked, which gives one code to each word, and each block the codes of its own;
(3) a block and its codes meet in one group, whose CSR shard has global columns;
row sums are numbers of words (filter A), nonzero counts numbers of distinct
words (filter B); (4) copies (filter E) are found by the texts' digests, and the
few kinds of documents of a part (which filters they fail, their labels) are
counted; (5) the 120 orders are evaluated on these counts alone.

A word reaches the shuffle once for each block that has it, so a common word has
a row per block, and no text is shuffled.  Digests of copies are hot keys: they
are aggregated first, and their rows are spread.

Defined cases: null texts count as empty; a null doc_id is neither a smaller nor
a larger one, so it fails no filter E and makes none fail; a repeated doc_id is
counted once a row, and equal texts under the least doc_id all pass E; a null
source is the part ''; a document that ``labels`` names several times is good
or toxic if one row says so; parts without documents do not exist, so an empty
table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, fanout, written
from .textarrays import lists, pieces

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Bytes of text that make up a block, and so a shard.
BLOCK = 16 << 20
#: Hash buckets of the dictionary for each shuffle partition.
BUCKETS = 16

_BLOCKS = "block long, doc_ids array<long>, parts array<string>, digests array<binary>, others array<tinyint>, indptr binary, columns binary, counts binary, words array<string>"
_ROWS = "doc_id long, part string, digest binary, n_words long, n_distinct long, mask int"
_SHARDS = "block long, doc_ids array<long>, indptr array<int>, columns array<long>, counts array<int>"


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin."""
    split = pc.ascii_split_whitespace(text)
    flat, offsets = split.flatten(), np.asarray(split.offsets)
    full = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offsets - offsets[0]]


def _csr(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, columns and counts of the rows whose codes stand one after another."""
    n = len(first) - 1
    cell = np.repeat(np.arange(n), np.diff(first)) * width + codes
    cell.sort()
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    cells = cell[starts]
    indptr = np.searchsorted(cells, np.arange(n + 1) * width)
    return indptr, cells % max(width, 1), np.diff(starts, append=len(cell))


def _packed(values: np.ndarray) -> bytes:
    """32-bit values as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(values.astype(np.int32)[:, None].view(np.uint8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32)[:, 0]


def _per_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    places = np.flatnonzero(marked)
    return np.diff(np.searchsorted(places, offsets))


def _others(text: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Bits of filters C and D, and digests."""
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    whole = text.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and whole.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    upper = _per_text((data >= 65) & (data <= 90), offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    bits = 4 * (100 * upper > UPPER_PERCENT * np.asarray(pc.utf8_length(text))) + 8 * (_per_text(symbol[data], offsets) > 0)
    return bits.astype(np.int8), [hashlib.blake2b(data[a:b].data, digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.rpartition(" ")[0] for x in _BLOCKS.split(", ")]
    block = TaskContext.get().partitionId() << 32
    for batch in pieces(batches, limit=BLOCK):
        text = batch.column("text").fill_null("").cast(pa.large_string())
        words, first = _words(text)
        coded = words.dictionary_encode()
        indptr, columns, counts = _csr(np.asarray(coded.indices), first, len(coded.dictionary))
        bits, digests = _others(text)
        one = [pa.array([block], pa.int64())]
        one += [pa.array([x.to_pylist()], pa.list_(kind)) for x, kind in ((batch.column("doc_id"), pa.int64()), (batch.column("part"), pa.string()))]
        one += [pa.array([digests], pa.list_(pa.binary()))]
        one += [lists(bits, np.array([len(bits)]), pa.int8())]
        one += [pa.array([_packed(x)]) for x in (np.diff(indptr), np.diff(columns, prepend=0), counts)]
        one += [pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))]
        yield pa.RecordBatch.from_arrays(one, names)
        block += 1


def _shard(block: pa.Table, codes: pa.Table) -> dict[str, np.ndarray]:
    """The block's rows with global columns."""
    packed = {c: block.column(c)[0].as_py() for c in ("indptr", "columns", "counts")}
    indptr = np.concatenate([[0], np.cumsum(_unpacked(packed["indptr"], len(block.column("doc_ids")[0])))])
    code = np.zeros(codes.num_rows, np.int64)
    code[np.asarray(codes.column("place"))] = np.asarray(codes.column("code"))
    return {"indptr": indptr, "columns": code[np.cumsum(_unpacked(packed["columns"], indptr[-1]))], "counts": _unpacked(packed["counts"], indptr[-1])}


def _as_shards(block: pa.Table, codes: pa.Table) -> pa.Table:
    s = _shard(block, codes)
    arrays = [block.column("block").combine_chunks(), block.column("doc_ids").combine_chunks()]
    arrays += [lists(s[c], np.array([len(s[c])]), kind) for c, kind in (("indptr", pa.int32()), ("columns", pa.int64()), ("counts", pa.int32()))]
    return pa.Table.from_arrays(arrays, ["block", "doc_ids", "indptr", "columns", "counts"])


def _as_rows(block: pa.Table, codes: pa.Table) -> pa.Table:
    """Row sums and nonzero counts of the shard decide filters A and B."""
    s = _shard(block, codes)
    n_distinct = np.diff(s["indptr"]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(s["counts"], dtype=np.int64)])
    n_words = np.diff(upto[s["indptr"]])
    mask = (n_words < LEAST_WORDS) + 2 * (100 * n_distinct < DISTINCT_PERCENT * n_words) + np.asarray(block.column("others").combine_chunks().flatten())
    kept = [block.column(c).combine_chunks().flatten() for c in ("doc_ids", "parts", "digests")]
    return pa.Table.from_arrays([*kept, pa.array(n_words), pa.array(n_distinct), pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "n_words", "n_distinct", "mask"])


def blocks(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs(doc_id, text, source)``, as a written table."""
    rows = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    return written(rows.mapInArrow(_cut, _BLOCKS), "audit-blocks", **{"parquet.block.size.row.check.min": "1"})


def coded(cut: DataFrame) -> DataFrame:
    """``(of_block, place, word, code)`` of all blocks' words: one code for each word of the table.

    A word's code is its rank among the words of its hash bucket, times the number
    of buckets, plus the bucket; so one shuffle gives every block its codes.
    """
    n = BUCKETS * fanout(cut.sparkSession)
    found = cut.select(F.col("block").alias("of_block"), F.posexplode("words").alias("place", "word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(n)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    return found.withColumn("code", rank * F.lit(n).cast("long") + F.col("bucket")).drop("bucket")


def dictionary(codes: DataFrame) -> DataFrame:
    """``(word, code)`` of the coded words."""
    return codes.select("word", "code").distinct()


def _met(cut: DataFrame, codes: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    return cut.select("block", *columns).groupBy("block").cogroup(codes.select("of_block", "place", "code").groupBy("of_block")).applyInArrow(make, schema)


def matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CSR shards (block, doc_ids, indptr, columns, counts) of ``docs``, and the dictionary of their columns."""
    cut = blocks(docs)
    codes = coded(cut)
    return _met(cut, codes, ["doc_ids", "indptr", "columns", "counts"], _as_shards, _SHARDS), dictionary(codes)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_words, n_distinct and mask of each row: bit k of the mask says that it fails filter k of ABCDE."""
    cut = blocks(docs)
    rows = _met(cut, coded(cut), ["doc_ids", "parts", "digests", "others", "indptr", "columns", "counts"], _as_rows, _ROWS)
    rows = written(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return attach(rows, first, "digest", "size", F.col("doc_id")).select("doc_id", "part", "n_words", "n_distinct", (F.col("mask") + copy).alias("mask"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, the step's filter as a bit, the earlier filters' bits)."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, 1 << k, before))
            before |= 1 << k
    return out


def report(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter order and step, what the filters remove of ``rows(doc_id, part, mask)``; see the module."""
    spark = rows.sparkSession
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    kinds = rows.select("doc_id", "part", "mask").join(known, "doc_id", "left").groupBy("part", "mask", F.expr("good <=> true").alias("good"), F.expr("toxic <=> true").alias("toxic")).agg(F.count("*").alias("n"))
    # a filter met after a set of others: 80 cases, each of which several orders share
    steps = _steps()
    cases = sorted({(bit, before) for _, _, bit, before in steps})
    case = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in cases)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    share = F.expr(f"{factorial(len(FILTERS))} div nullif(bit_count(mask), 0)")  # orders in which this one of the failed filters comes first
    total = lambda cond, value=F.col("n"): F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    counted = kinds.withColumn("case", case).select("*", "case.*").groupBy("part", "bit", "before").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"), total(fails & ~gone & F.col("toxic")).alias("toxic_lost"), total(fails, F.col("n") * share).alias("shapley"),
    )
    named = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    return counted.join(F.broadcast(named), ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report on ``docs(doc_id, text, source)`` with ``labels(doc_id, quality, toxic)``."""
    return report(judged(docs), labels)
