"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Links are pairs of shingle sets with ``100 * intersection >= PERCENT * union``.  Two
bounds that follow from the sizes keep the product small and lose nothing:

* a set of n shingles needs at least ``o = ceil(n * PERCENT / 100)`` of them in any
  partner, so in one order of all shingles, linked sets share one of their first
  ``n - o + 1``: only these columns of the incidence matrix are multiplied;
* linked sets of n_a and n_b shingles share ``PERCENT * (n_a + n_b) / (100 + PERCENT)``
  of them, so m of the first ``n - o + m`` of each, for that o and any m: pairs with
  a smaller overlap count are discarded.

Rare shingles come first: the order is that of a table of CELLS counts of hashed
shingles, then the hash.  The table's size doesn't grow; it only moves work.

Steps: (1) the count table; (2) one row per distinct set with its first shingles;
(3) hot columns, which many sets share, are thinned: in a few rounds their sets are
compared with one of them, and those that the second bound lets pass join its team;
(4) the product of the incidence with itself, without pairs within a team, in chunks
of a column; overlap counts add up by pair and meet the bound; (5) components of all
pairs that are left, and of teams, are the blocks of the matrix that can hold links;
(6) within each the blocked product of full sets, a block of sets by a block of sets
and a block of columns at a time, gives the links, of which each set's number and a
spanning forest come out; (7) components of the links.

Defined cases: null, empty and blank texts have empty sets and link with nothing,
as do rows with a null doc_id (component null); rows that repeat a doc_id are one
node; equal sets under other ids are one class, whose links count once a row; an
empty table gives an empty result; further columns are left out.

Step 6 takes time with the square of a component of similar sets, in tasks of
bounded size; step 4 with that of a column of sets that are similar but in no
common team.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, components, pair_chunks, written
from .textarrays import Texts, U, lists, mix, pieces, signed, windows

WORDS, PERCENT = 3, 90
#: Counts that order the shingles; sets from which on a column is thinned; sets of a column that one task compares with each other, on average.
CELLS, HOT, CHUNK = 1 << 16, 32, 512
#: Times that hot columns are thinned.
ROUNDS = 3
#: Sets and shingles of a block of the product within a component, on average; columns of a block.
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_COLUMNS = 1024, 1 << 20, 2048
#: Ids of documents that are broadcast, at most; bits of the filter by which texts of candidates are read again.
FEW, _BLOOM = 1 << 16, 1 << 23


def _shingles(texts: Texts) -> Iterator[np.ndarray]:
    """The set of distinct shingle hashes of each text, ascending."""
    words = texts.hashes(lower=True)
    found = windows(words, WORDS)
    for a, n in zip(texts.first, texts.counts, strict=False):
        if n >= WORDS:
            yield np.unique(found[a : a + n - WORDS + 1])
        else:
            yield windows(words[a : a + n], int(n)) ^ U(n) if n else found[:0]


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(48)).astype(np.int64) % CELLS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in pieces(batches):
        cells = []
        for s in _shingles(Texts(batch.column("text"))):
            cells.append(_cells(s))
        total += np.bincount(np.concatenate(cells), minlength=CELLS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": used, "n": total[used]})


def order(docs: DataFrame) -> np.ndarray:
    """For each cell, how many shingles of all sets fall in it."""
    found = docs.select("text").mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CELLS, np.int64)
    total[np.asarray(found.column("cell"))] = np.asarray(found.column("n"))
    return total


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * PERCENT // 100)


def _first(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Set sizes, fingerprints and first shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, prints, firsts = [], [], []
            for s in _shingles(Texts(batch.column("text"))):
                n = len(s)
                sizes.append(n)
                prints.append(np.array([mix(s).sum(), mix(s ^ U(0x5555555555555555)).sum(), n], U).tobytes() if n else None)
                firsts.append(s[np.argsort(counts[_cells(s)], kind="stable")[: n - _least(n) + 1]] if n else s)
            flat = signed(np.concatenate(firsts)) if firsts else np.zeros(0, np.int64)
            keys = lists(flat, np.array([len(f) for f in firsts]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), keys], ["doc_id", "n_shingles", "print", "firsts"])

    return run


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes and fingerprints of all rows, and one row per distinct set: print, rep (least doc_id), n_docs, n, firsts."""
    rows = docs.select("doc_id", "text").mapInArrow(_first(order(docs)), "doc_id long, n_shingles long, print binary, firsts array<long>")
    rows = written(rows, "ngram-rows")
    linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets have equal first shingles
    sets = linked.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n"), F.first("firsts").alias("firsts"))
    return rows.drop("firsts"), written(sets, "ngram-classes")


def _bloom(ids: DataFrame, key: str) -> np.ndarray:
    """A bitmap that has three bits set for each id; its size is fixed."""
    h = [F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(_BLOOM)) for k in range(3)]
    bits = ids.select(F.explode(F.array(*h)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(_BLOOM // 64, np.int64)
    out[np.asarray(bits.column("place"))] = np.asarray(bits.column("bits"))
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts; other columns stay."""
    for batch in pieces(batches):
        sets = list(_shingles(Texts(batch.column("text"))))
        flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists(flat, np.array([len(s) for s in sets]), pa.int64())], [*rest, "shingles"])


def _sets_of(bloom: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    packed = np.packbits(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            wanted = np.logical_and.reduce([bits[np.asarray(batch.column(f"h{k}"))] for k in range(3)]) if batch.num_rows else np.zeros(0, bool)
            yield from _sets(iter([batch.filter(pa.array(wanted)).select(["rep", "text"])]))

    return run


def full_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen(rep, component, block, n_blocks, n_docs)`` with the shingles of the documents of these ids.

    Up to FEW ids are broadcast and pick the texts in the scan; of more, a bitmap of
    fixed size picks them before the join.  Texts are never shuffled.
    """
    chosen = written(chosen, "ngram-chosen")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text")
    if chosen.count() <= FEW:
        return texts.join(F.broadcast(chosen), "rep").mapInArrow(_sets, "rep long, component long, block int, n_blocks int, n_docs long, shingles array<long>")
    h = [F.pmod(F.xxhash64(F.lit(k), F.col("rep")), F.lit(_BLOOM)).alias(f"h{k}") for k in range(3)]
    return texts.select("*", *h).mapInArrow(_sets_of(_bloom(chosen, "rep")), "rep long, shingles array<long>").join(chosen, "rep")


def _fits(n_x: str, n_y: str) -> Column:
    """Sizes that allow a link at all."""
    return (100 * F.least(n_x, n_y)) >= (PERCENT * F.greatest(n_x, n_y))


def _open(shared: Column, n_x: str, n_y: str) -> Column:
    """Whether sets of these sizes that share so many of their first shingles may be linked."""
    rest = lambda n: F.expr(f"({n} * {PERCENT} + 99) div 100 - 1")  # noqa: E731  shingles that are none of the first
    return (100 + PERCENT) * (shared + F.greatest(rest(n_x), rest(n_y))) >= PERCENT * (F.col(n_x) + F.col(n_y))


def product(entries: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``entries(key, rep, n, pos, team)`` whose overlap counts leave a link possible; none within a team.

    Linked sets share at least o shingles, so of the first ``n - o + m`` of each they
    share m.  Half of the largest m that the first ones allow is asked for: fewer
    products than with all of it, and far fewer pairs than with one.
    """
    left, right, meet = pair_chunks(entries, "key", "rep", CHUNK)
    o = F.expr(f"({PERCENT} * (n_x + n_y) + {99 + PERCENT}) div {100 + PERCENT}")
    m = F.expr(f"(({PERCENT} * (n_x + n_y) + {99 + PERCENT}) div {100 + PERCENT} - (greatest(n_x, n_y) * {PERCENT} + 99) div 100) div 2 + 1")
    early = (F.col("pos_x") < F.col("n_x") - o + m) & (F.col("pos_y") < F.col("n_y") - o + m)
    met = left.join(right, meet & (F.col("team_x") != F.col("team_y")) & _fits("n_x", "n_y") & early)
    pairs = met.groupBy(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).agg(F.count("*").alias("shared"), F.min(m).alias("least"))
    return pairs.filter("shared >= least").select("a", "b")


def _teams(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """``(rep, team)``: sets of hot columns and another set each that they may be linked with.

    A column's leader is the set that has most hot columns among its first ones: a
    text that others were made from has more of them than its changed copies, whose
    own shingles are rare.
    """
    hot = entries.filter(F.col("n_sets") > HOT).select("key", "rep", "n")
    hot = written(hot.join(hot.groupBy("rep").agg(F.count("*").alias("n_hot")), "rep"), "ngram-hot")
    teams, firsts = None, lambda side: sets.select(F.col("rep").alias(side), F.col("firsts").alias(f"firsts_{side}"))
    for k in range(ROUNDS):
        now = hot if teams is None else hot.join(teams, "rep", "left_anti")
        order = F.struct(-F.col("n_hot"), F.xxhash64(F.lit(k), F.col("rep")))
        leaders = now.groupBy("key").agg(F.min_by(F.struct("rep", "n"), order).alias("l"), F.count("*").alias("size")).filter("size > 1")
        star = attach(now, leaders, "key", "size", F.col("rep")).filter("rep <> l.rep").select(F.col("l.rep").alias("a"), F.col("rep").alias("b"), F.col("l.n").alias("n_a"), F.col("n").alias("n_b"))
        star = written(star.filter(_fits("n_a", "n_b")).distinct(), "ngram-star")
        sizes = star.groupBy("a").agg(F.count("*").alias("size"))
        both = attach(star.join(firsts("b"), "b"), firsts("a").join(sizes, "a"), "a", "size", F.col("b"))
        near = both.filter(_open(F.size(F.array_intersect("firsts_a", "firsts_b")), "n_a", "n_b")).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("team"))
        teams = written(near if teams is None else teams.unionByName(near), "ngram-teams")
    return teams


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets, whose components hold every link."""
    keyed = sets.select("rep", "n", F.posexplode("firsts").alias("pos", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n_sets")).filter("n_sets > 1")
    entries = written(keyed.join(shared, "key"), "ngram-entries")
    teams = _teams(entries, sets)
    teamed = entries.join(teams, "rep", "left").select("key", "rep", "n", "pos", F.coalesce("team", "rep").alias("team"))
    mixed = teamed.groupBy("key").agg(F.min("team").alias("low"), F.max("team").alias("high")).filter("low < high").select("key")
    pairs = product(written(teamed.join(mixed, "key"), "ngram-teamed"))
    return pairs.unionByName(teams.select(F.col("rep").alias("a"), F.col("team").alias("b")))


def _overlaps(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """Intersection sizes of all sets of one block with all of the other, a block of columns at a time."""
    sides = []
    for side in (x, y):
        offsets = np.asarray(side.offsets)
        sides.append((np.repeat(np.arange(len(side)), np.diff(offsets)), np.asarray(side.values)[offsets[0] : offsets[-1]]))
    common = np.intersect1d(sides[0][1], sides[1][1])
    total = np.zeros((len(x), len(y)), np.float32)
    placed = []
    for rows, values in sides:
        place = np.searchsorted(common, values)
        hit = place < len(common)
        hit[hit] = common[place[hit]] == values[hit]
        by = np.argsort(place[hit], kind="stable")
        placed.append((rows[hit][by], place[hit][by]))
    for low in range(0, len(common), BLOCK_COLUMNS):
        dense = []
        for (rows, place), side in zip(placed, (x, y), strict=True):
            a, b = np.searchsorted(place, [low, low + BLOCK_COLUMNS])
            one = np.zeros((len(side), BLOCK_COLUMNS), np.float32)
            one[rows[a:b], place[a:b] - low] = 1
            dense.append(one)
        total += dense[0] @ dense[1].T
    return np.rint(total).astype(np.int64)


def _linked(group: pa.Table) -> pa.Table:
    """Of each set of two blocks, rows it is linked with across them, and the least of a spanning forest's tree; a block that meets itself has one side."""
    group = group.combine_chunks()
    own = group.column("low")[0] == group.column("high")[0]
    side = np.asarray(group.column("side"))

    def one(k: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        part = group.filter(pa.array(side == k))
        if not part.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.list_(pa.int64()))
        sets = pa.concat_arrays(part.column("shingles").chunks)
        rep, kept, place = np.asarray(part.column("rep")), [], {}
        for i, r in enumerate(rep.tolist()):  # a repeated row counts once
            mark = (r, hash(np.asarray(sets[i].values).tobytes()))
            if place.setdefault(mark, i) == i:
                kept.append(i)
        return rep[kept], np.asarray(part.column("n_docs"))[kept], sets.take(pa.array(kept))

    x = one(0)
    y = x if own else one(1)
    both = _overlaps(x[2], y[2])
    n_x, n_y = (np.asarray(t[2].value_lengths()) for t in (x, y))
    linked = (both > 0) & (100 * both >= PERCENT * (n_x[:, None] + n_y[None, :] - both)) & (x[0][:, None] != y[0][None, :])
    root_x, root_y, most = x[0], y[0], np.iinfo(np.int64).max
    while len(x[0]) and len(y[0]):  # least ids spread along links
        new_x = np.minimum(root_x, np.where(linked, root_y[None, :], most).min(axis=1))
        new_y = new_x if own else np.minimum(root_y, np.where(linked, new_x[:, None], most).min(axis=0))
        if (new_x == root_x).all() and (new_y == root_y).all():
            break
        root_x, root_y = new_x, new_y
    out = [(x[0], linked @ y[1], root_x)] + ([] if own else [(y[0], linked.T @ x[1], root_y)])
    rep, n, root = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.Table.from_arrays([pa.array(rep), pa.array(n.astype(np.int64)), pa.array(root)], ["rep", "n_links", "root"])


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(rep, n_links, root)`` of sets in blocks that may hold links: rows linked with the set in a block, and a set that links lead to; a written table."""
    groups = written(components(candidates(sets)).withColumnRenamed("node", "rep"), "ngram-groups")
    known = sets.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    known = written(groups.join(known, "rep"), "ngram-known")
    sizes = known.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("volume"))
    sizes = sizes.withColumn("n_blocks", F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int"))
    dealt = attach(known, sizes.drop("volume"), "component", "size", F.col("rep")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    full = full_sets(docs, dealt.select("rep", "component", "block", "n_blocks", "n_docs"))
    # block i meets block j >= i: as the first side in (i, j), as the second in (j, i)
    each = full.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    each = each.select("component", low, high, F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "n_docs", "shingles")
    return written(each.groupBy("component", "low", "high").applyInArrow(_linked, "rep long, n_links long, root long"), "ngram-links")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows linked with it) for each row of ``docs(doc_id, text)``."""
    rows, sets = classes(docs)
    found = links(docs, sets)
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    named = sets.join(groups, "rep", "left").join(counts, "rep", "left").select("print", "n_docs", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    linked = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    out = attach(rows.filter(linked), named.withColumn("size", F.col("n_docs")), "print", "size", F.col("doc_id")).select("doc_id", "n_shingles", "component_id", "n_links")
    rest = rows.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(rest)
