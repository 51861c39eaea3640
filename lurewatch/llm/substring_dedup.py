"""Substring dedup with difference-cover anchors.

A repeated run of 20 words is looked for by anchors of 8 words that begin only
at cover positions: places in the text that are 0, 1, 3 or 9 modulo 13.  For any
two equal runs there is an offset below 13 at which both have a cover position,
so they share an aligned anchor inside.  Steps: (1) mark the anchors of every
text and find those that occur again; (2) sort the texts that hold such anchors
by document, together with the anchors' places; (3) extend: hash the runs of 20
words around the anchors and find, for each, the earliest place; all later ones
are removed.

Steps 1 and 3 work on blocks of texts.  A block sends one row to each hash
bucket, with the word's position in the block for each entry, and one row of its
own that tells which texts it consists of and what it settled by itself: a mark
or hash that a block holds more often is sent once, so a passage in a third of
all texts reaches its bucket once per block, and no pairs are formed.  Step 1
sends 31 bits of a hash within a bucket, since anchors only nominate; step 3
sends 96.  In step 3 blocks are numbered in the order of the documents, so the
earliest place is the least block and position.

Defined cases: null, empty and blank texts have no words; a null doc_id comes
before all others; texts with equal doc_id are ordered by a hash of the text,
and rows equal in both count as one text and get the same result; ties within a
text are settled by place; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fanout, work_path, written
from .textarrays import Texts, U, lists, mix, pieces, scatter, signed, windows

RUN, ANCHOR, PERIOD = 20, 8, 13
COVER = (0, 1, 3, 9)
BLOCK = 16 << 20
#: Buckets of step 3 for each of step 1: a text that is a copy has all its runs hashed, but only four in thirteen anchors.
FINER = 4

#: A block's own row has ids, keys and word counts of its texts; a bucket's row has entries.  ``place`` is the position in the block.
_ENTRIES = "bucket int, block long, ids array<long>, keys array<long>, counts array<int>, place array<int>, mark array<int>, hash array<long>"
_FOUND = "block long, ids array<long>, keys array<long>, counts array<int>, place array<int>"
_PLACES = "id long, key long, places array<int>"


def _no_list(n: int, kind: pa.DataType) -> pa.ListArray:
    return lists(np.zeros(0, np.int64), np.zeros(n, np.int64), kind)


def _own_row(bucket: int, block: int, batch: pa.RecordBatch, counts: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
    n = np.array([len(counts)])
    texts = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), batch.column(c)) for c in ("id", "key")]
    columns = [pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), *texts, lists(counts.astype(np.int32), n, pa.int32()), lists(settled.astype(np.int32), np.array([len(settled)]), pa.int32()), _no_list(1, pa.int32()), _no_list(1, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "ids", "keys", "counts", "place", "mark", "hash"])


def _bucket_rows(n_buckets: int, block: int, bucket: np.ndarray, place: np.ndarray, mark: np.ndarray, hashes: np.ndarray | None) -> pa.RecordBatch:
    """The entries, in ascending order of place, as one row a bucket."""
    used, c, per = scatter(bucket, n_buckets, place=place, mark=mark, **({} if hashes is None else {"hash": hashes}))
    n = len(used)
    own = [_no_list(n, pa.int64()), _no_list(n, pa.int64()), _no_list(n, pa.int32())]
    long_ = _no_list(n, pa.int64()) if hashes is None else lists(signed(c["hash"]), per, pa.int64())
    columns = [pa.array(used, pa.int32()), pa.array(np.full(n, block), pa.int64()), *own, lists(c["place"].astype(np.int32), per, pa.int32()), lists(c["mark"], per, pa.int32()), long_]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "ids", "keys", "counts", "place", "mark", "hash"])


def _flat(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    """Values of a list column end to end."""
    return np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy(zero_copy_only=False) for x in table.column(name).chunks)])


def _blocks(table: pa.Table, name: str) -> np.ndarray:
    """The block of each value of a list column."""
    sizes = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in table.column(name).chunks)])
    return np.repeat(table.column("block").to_numpy(), sizes.astype(np.int64))


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The blocks' own rows, as ``_FOUND`` has them, and the bucket's entries."""
    own = np.concatenate([x.value_lengths().to_numpy() for x in table.column("ids").chunks]) > 0
    return table.filter(pa.array(own)).select(["block", "ids", "keys", "counts", "place"]), table.filter(pa.array(~own))


def _answer(own: pa.Table, block: np.ndarray, place: np.ndarray) -> pa.Table:
    """The own rows, and the places found as one row a block."""
    order = np.lexsort((place, block))
    blocks, per = np.unique(block, return_counts=True)
    n = len(blocks)
    columns = [pa.array(blocks, pa.int64()), _no_list(n, pa.int64()), _no_list(n, pa.int64()), _no_list(n, pa.int32()), lists(place[order].astype(np.int32), per, pa.int32())]
    return pa.concat_tables([own, pa.Table.from_arrays(columns, schema=own.schema)])


def _places(table: pa.Table) -> pa.Table:
    """What all buckets found in a block, one row per text with the places in it."""
    ids, keys, counts = (_flat(table, c) for c in ("ids", "keys", "counts"))
    first = np.cumsum(counts) - counts
    place = np.unique(_flat(table, "place"))
    text = np.searchsorted(first, place, "right") - 1  # of texts without words, which begin at the same position, the last
    used, per = np.unique(text, return_counts=True)
    return pa.Table.from_arrays([pa.array(ids[used], pa.int64()), pa.array(keys[used], pa.int64()), lists((place - first[text]).astype(np.int32), per, pa.int32())], ["id", "key", "places"])


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether an entry of sorted columns differs from the one before."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _sizes(new: np.ndarray) -> np.ndarray:
    """Size of the run of equal values that each entry is in."""
    starts = np.flatnonzero(new)
    per = np.diff(np.append(starts, len(new)))
    return np.repeat(per, per)


def _layout(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the text's index and the place in it."""
    text = np.repeat(np.arange(len(texts.counts)), texts.counts)
    return text, np.arange(len(text)) - texts.first[:-1][text]


def _anchors(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(pieces(batches, limit=BLOCK)):
            block = (TaskContext.get().partitionId() << 32) + i
            texts = Texts(batch.column("text"))
            text, place = _layout(texts)
            found = windows(texts.hashes(), ANCHOR)
            text, place = text[: len(found)], place[: len(found)]
            n = texts.counts[text]
            at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + ANCHOR <= n) & (n >= RUN))
            h = found[at]
            order = np.argsort(h, kind="stable")
            new = _firsts(h[order])
            again = np.zeros(len(at), bool)
            again[order] = _sizes(new) > 1
            sent = np.zeros(len(at), bool)
            sent[order[new]] = True
            yield _own_row(block % n_buckets, block, batch, texts.counts, at[again])
            at, h, again = at[sent], h[sent], again[sent]
            mark = (h & U(0x7FFFFFFF)).astype(np.int32)
            yield _bucket_rows(n_buckets, block, ((h >> U(33)) % U(n_buckets)).astype(np.int64), at, np.where(again, ~mark, mark), None)

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors, those that occur again; inverted marks are already settled by their block."""
    own, entries = _split(table)
    block, place, mark = _blocks(entries, "place"), _flat(entries, "place"), _flat(entries, "mark")
    plain = np.where(mark < 0, ~mark, mark)
    order = np.argsort(plain, kind="stable")
    found = order[(_sizes(_firsts(plain[order])) > 1) & (mark[order] >= 0)]
    return _answer(own, block[found], place[found])


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text, the places (kind 0) before the text itself (kind 1) -> each text that has places, once, numbered in order."""
    part, n, now, held, done = TaskContext.get().partitionId(), 0, None, [], False
    for batch in batches:
        lists_ = batch.column("places")
        rows, places = [], []
        for r, (i, k, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "key", "kind")), strict=True)):
            if (i, k) != now:
                now, held, done = (i, k), [], False
            if kind == 0:
                held.append(np.array(lists_[r].as_py(), np.int32))
            elif held and not done:
                done = True
                rows.append(r)
                places.append(np.unique(np.concatenate(held)))
        if rows:
            some = batch.take(pa.array(rows))
            seq = np.arange(n, n + len(rows))
            n += len(rows)
            columns = [pa.array(np.full(len(rows), part), pa.int64()), pa.array(seq, pa.int64()), some.column("id"), some.column("key"), some.column("text"), lists(np.concatenate(places), np.array([len(p) for p in places]), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "id", "key", "text", "places"])


def _in_order(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of consecutive texts."""
    for batch in batches:
        part, seq = batch.column("part").to_numpy(), batch.column("seq").to_numpy()
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (seq[1:] != seq[:-1] + 1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
            yield from pieces([batch.slice(a, b - a)], limit=limit)


def _runs(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_order(batches, BLOCK):
            block = (batch.column("part")[0].as_py() << 40) + batch.column("seq")[0].as_py()
            texts = Texts(batch.column("text"))
            text, place = _layout(texts)
            anchors = batch.column("places")
            at = anchors.flatten().to_numpy() + np.repeat(texts.first[:-1], anchors.value_lengths().to_numpy())
            near = np.zeros(len(text) + 1, np.int64)  # places from which a run of 20 words holds an anchor
            low = np.maximum(at - (RUN - ANCHOR), texts.first[text[at]])
            np.add.at(near, low, 1)
            np.add.at(near, at + 1, -1)
            words = texts.hashes()
            found, other = windows(words, RUN), windows(mix(words ^ U(0xA5A5A5A5A5A5A5A5)), RUN)
            m = len(found)
            at = np.flatnonzero((np.cumsum(near)[:m] > 0) & (place[:m] + RUN <= texts.counts[text[:m]]))
            hashes, mark = found[at], (other[at] >> U(32)).astype(np.uint32).view(np.int32)
            order = np.lexsort((at, mark, hashes))
            new = np.zeros(len(at), bool)
            new[order] = _firsts(hashes[order], mark[order])
            yield _own_row(block % n_buckets, block, batch, texts.counts, at[~new])
            at, hashes, mark = at[new], hashes[new], mark[new]
            yield _bucket_rows(n_buckets, block, ((hashes >> U(33)) % U(n_buckets)).astype(np.int64), at, mark, hashes)

    return run


def _later(table: pa.Table) -> pa.Table:
    """Of a bucket's runs, those that also begin in an earlier block."""
    own, entries = _split(table)
    block, place, mark, hashes = _blocks(entries, "place"), _flat(entries, "place"), _flat(entries, "mark"), _flat(entries, "hash")
    order = np.lexsort((block, mark, hashes))  # a block sends a run once
    later = order[~_firsts(hashes[order], mark[order])]
    return _answer(own, block[later], place[later])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("key"), pa.array([len(w) for w in words], pa.int64()), pa.array(digests)], ["doc_id", "id", "key", "n_words", "sha"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        removed, texts = [], []
        for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            words = (t or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, places, 1)
            np.add.at(gone, np.array(places) + RUN, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed.append(int(gone.sum()))
            texts.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
        digests = [hashlib.sha256(t).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(digests), pa.array([t.decode() for t in texts])], ["id", "key", "n_removed", "kept_sha", "kept_text"])


def cut(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed rows of ``docs(doc_id, text)``, and for the texts that lose words: id, key, n_removed, kept_sha, kept_text."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("key"), "text")
    n = max(fanout(spark), keyed.rdd.getNumPartitions())
    bare = keyed.select("id", "key", "text")
    anchors = bare.mapInArrow(_anchors(n), _ENTRIES).groupBy("bucket").applyInArrow(_recurring, _FOUND)
    anchors = written(anchors.groupBy("block").applyInArrow(_places, _PLACES), "anchors")
    both = bare.withColumns({"kind": F.lit(1), "places": F.lit(None).cast("array<int>")}).unionByName(anchors.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartitionByRange(n, "id", "key").sortWithinPartitions("id", "key", "kind")
    schema = "part long, seq long, id long, key long, text string, places array<int>"
    path = work_path(spark, "anchored")
    both.mapInArrow(_with_places, schema).write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema(schema).parquet(path)
    later = texts.mapInArrow(_runs(FINER * n), _ENTRIES).groupBy("bucket").applyInArrow(_later, _FOUND)
    later = written(later.groupBy("block").applyInArrow(_places, _PLACES), "later-runs")
    lost = texts.select("id", "key", "text").join(later, ["id", "key"])
    return keyed, lost.mapInArrow(_cut, "id long, key long, n_removed long, kept_sha string, kept_text string")


def verdicts(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row (and kept_text, null where nothing is removed)."""
    keyed, lost = cut(docs)
    whole = keyed.mapInArrow(_whole, "doc_id long, id long, key long, n_words long, sha string")
    lost = lost if with_text else lost.drop("kept_text")
    out = whole.join(lost, ["id", "key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), *["kept_text"] * with_text)
