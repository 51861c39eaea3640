"""LM scoring by deleted interpolation.

A bigram, a unigram and a uniform estimate are mixed; the weights depend on how
often the context occurs (by powers of two) and are learned by expectation-
maximisation on a part of the training documents that is deleted from the
counts while doing so.  Tokens are words and one end per document; the end is
also the context of a document's first word.

Words are divided by relative frequency: the counts of those that make up at
least 1/WORDS of the training tokens -- at most WORDS of them -- are broadcast, and
likewise those of at most BIGRAMS frequent bigrams of such words.  What is rarer
goes by hash bucket to a task that counts and scores it there: other bigrams of
broadcast words by the bigram, bigrams with one rare word by that word, so that
its count is at hand too.  A bigram of two rare words goes to the bucket of its
context and, with the counts found there, on to that of its second word.  No key
holds more than a bounded share of a bucket, and the exact count of every token,
context and bigram enters the weights' training and both scores; what is
broadcast changes where a count is looked up, not its value.  Three passes over
the texts: word counts, bigram counts (giving the frequent bigrams and the
statistics for EM), scores.

Defined cases: null, empty and blank texts consist of the end; a null doc_id is
trained on; rows that repeat an id or text are trained on and scored row by
row; without training documents every score is 0; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fanout, release, written
from .textarrays import Texts, U, lists, mix, pieces, scatter, signed

WORDS, BIGRAMS = 1 << 18, 1 << 20
FOLDS, TEST_FOLD, DELETED_FOLD = 7, 2, 3
#: Bytes, and texts, of a block; twice the index of a text fits 16 bits.
BLOCK, MOST_TEXTS = 8 << 20, 1 << 14
_END = np.array([0x454E44], U)
#: A bigram of broadcast words is the context's class, shifted, and the token's: 2 * 19 bits hold at most WORDS + 2 classes each.
_SHIFT, _CLASS = U(19), U((1 << 19) - 1)
_PAIR, _ODD = U((1 << 38) - 1), 0x1B5AD4C375
#: Log-ratios enter EM rounded to steps of this size and at most ``_CENTRE - 1`` steps from 0; with up to 64 levels of context frequency
#: this bounds what EM gets to 64 * 256 * 256 counts, whatever the corpus.
_STEP, _CENTRE = 0.2, 128
#: Training tokens for each hash bucket (about 12 MB of messages), and buckets at least: with those, what is left of a bigram in its bucket fits 31 bits.
BUCKET, LEAST_BUCKETS = 1 << 20, 128


class Table:
    """Lookup of ascending 64-bit hashes by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift = U(64 - bits)
        slots = (keys >> self.shift).astype(np.int64)
        sizes = np.bincount(slots, minlength=1 << bits)
        self.first = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.depth = int(sizes.max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, -1 if absent."""
        out = np.full(len(h), -1, np.int64)
        at = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        for k in range(self.depth):
            here = np.minimum(at + k, len(self.keys) - 1)
            np.copyto(out, here, where=self.keys[here] == h)
        return out


@dataclass
class Words:
    """Counts of the frequent words; class i + 1 is key i, class 0 marks all others."""

    table: Table
    counts: np.ndarray  #: by class, in all training documents
    deleted: np.ndarray  #: by class, in the deleted part
    n: int
    vocabulary: int
    rare: int  #: distinct words that are not broadcast

    @property
    def uniform(self) -> float:
        """Share of each word if all words, and one unseen, were equally likely."""
        return 1.0 / (self.vocabulary + 1)


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and the fold, by CRC-32 of the id as text."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))
    return docs.select("doc_id", fold.cast("int").alias("fold"), "text")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=BLOCK):
        texts, fold = Texts(batch.column("text")), batch.column("fold").to_numpy()
        of = np.repeat(fold, texts.counts)
        h = np.concatenate([texts.hashes(lower=True), np.repeat(_END, len(fold))])
        of = np.concatenate([of, fold])
        used = of != TEST_FOLD
        keys, where = np.unique(h[used], return_inverse=True)
        c = np.bincount(where, minlength=len(keys))
        d = np.bincount(where, of[used] == DELETED_FOLD, minlength=len(keys)).astype(np.int64)
        for i in range(0, len(keys), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[s])), pa.array(c[s]), pa.array(d[s])], ["h", "c", "d"])


def count_words(docs: DataFrame) -> tuple[Words, DataFrame]:
    """The frequent words; and (h, c, d) of the others."""
    counts = _folded(docs).mapInArrow(_count_words, "h long, c long, d long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    counts = written(counts, "word-counts")
    n, vocabulary, deleted = counts.agg(F.sum("c"), F.count("*"), F.sum("d")).first()
    n, deleted = n or 0, deleted or 0
    end = int(_END[0])
    often = (F.col("c") * WORDS >= n) | (F.col("h") == end)
    frequent = counts.filter(often).toArrow()  # at most WORDS + 1 rows
    keys = frequent.column("h").to_numpy().astype(np.int64).view(U)
    order = np.argsort(keys)
    c, d = frequent.column("c").to_numpy()[order], frequent.column("d").to_numpy()[order]
    with_rest = lambda x, total: np.concatenate([[total - x.sum()], x]).astype(np.int64)
    return Words(Table(keys[order]), with_rest(c, n), with_rest(d, deleted), n, vocabulary, vocabulary - len(c)), counts.filter(~often)


def _classes(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token with the ends: the text, the word's hash, its class and the context's class (0 is rare; the context's hash is the one before)."""
    n = len(texts.counts)
    at = np.arange(len(texts.starts)) + np.repeat(np.arange(n), texts.counts)
    name = np.full(len(at) + n, _END[0], U)
    name[at] = texts.hashes(lower=True)
    token = words.table.find(name) + 1
    context = np.empty_like(token)
    context[:1], context[1:] = int(words.table.find(_END)[0]) + 1, token[:-1]
    return np.repeat(np.arange(n), texts.counts + 1), name, token, context


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys) >> U(33)) % U(n)).astype(np.int64)


def _fold(pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a bigram of broadcast words, and the rest that tells it apart there."""
    x = ((pair ^ (pair >> _SHIFT)) * U(_ODD)) & _PAIR
    x ^= x >> _SHIFT
    return (x % U(n)).astype(np.int64), (x // U(n)).astype(np.int32)


def _unfold(bucket: int, rest: np.ndarray, n: int) -> np.ndarray:
    x = rest.astype(U) * U(n) + U(bucket)
    x = ((x ^ (x >> _SHIFT)) * U(pow(_ODD, -1, 1 << 38))) & _PAIR
    return x ^ (x >> _SHIFT)


#: Kinds of bigrams: of two frequent words (small: what ``_fold`` leaves); of a rare word (keys: its hash) after a frequent one (small: its class); of a
#: rare word (keys) before a frequent one (small: its class) or a rare one (others: its hash).  COUNTED: rare words (keys), their counts (others) and
#: deleted counts.
FREQUENT, RARE_TOKEN, RARE_CONTEXT, RARE_BOTH, COUNTED = range(5)
#: Results of a bucket: frequent bigrams; deleted tokens by code; and, of a bigram of two rare words, the second's hash, the code without its count.
FOUND, CODES, PENDING = range(3)
_COUNTS = "bucket int, kind int, keys array<long>, small array<int>, others array<long>, counts array<int>"


def _listed(bucket: np.ndarray, kind: int, per: np.ndarray, keys: np.ndarray | None, others: np.ndarray | None, counts: np.ndarray | None, small: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(bucket), np.int64)
    some = lambda x, of: lists(np.zeros(0, np.int64), none, of) if x is None else lists(x, per, of)
    columns = [pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), kind), pa.int32()), some(keys, pa.int64()), some(small, pa.int32()), some(others, pa.int64()), some(counts, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "keys", "small", "others", "counts"])


def _kinds(name: np.ndarray, token: np.ndarray, context: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind, places, keys and others of the bigrams with a rare word."""
    for kind, there in ((RARE_TOKEN, (token == 0) & (context > 0)), (RARE_CONTEXT, (token > 0) & (context == 0)), (RARE_BOTH, (token == 0) & (context == 0))):
        at = np.flatnonzero(there)
        others = context[at] if kind == RARE_TOKEN else token[at] if kind == RARE_CONTEXT else signed(name[at])
        yield kind, at, name[at] if kind == RARE_TOKEN else name[at - 1], others


def _count_bigrams(n_buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=BLOCK):
            texts, fold = Texts(batch.column("text")), batch.column("fold").to_numpy()
            owner, name, token, context = _classes(texts, shared.value)
            of = fold[owner]
            used = (of != TEST_FOLD) & (token > 0) & (context > 0)
            key = (context[used].astype(U) << _SHIFT) | token[used].astype(U)
            both, counts = np.unique((key << U(1)) | (of[used] == DELETED_FOLD), return_counts=True)
            key, deleted = both >> U(1), (both & U(1)).astype(bool)
            bucket, rest = _fold(key, n_buckets)
            names, c, per = scatter(bucket, n_buckets, rest=rest, count=np.where(deleted, -counts, counts))
            yield _listed(names, FREQUENT, per, None, None, c["count"], c["rest"])
            for kind, at, key, others in _kinds(name, token, context):
                trained = of[at] != TEST_FOLD
                key, others, sign = key[trained], others[trained], np.where(of[at[trained]] == DELETED_FOLD, -1, 1)
                names, c, per = scatter(_bucket(key, n_buckets), n_buckets, key=key, others=others, count=sign)
                wide = kind == RARE_BOTH
                yield _listed(names, kind, per, signed(c["key"]), c["others"] if wide else None, c["count"], None if wide else c["others"])

    return run


def _rare_by_bucket(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out():
            table = pa.Table.from_batches(held)
            key, c, d = (table.column(x).to_numpy() for x in ("h", "c", "d"))
            key = key.astype(np.int64).view(U)
            names, x, per = scatter(_bucket(key, n_buckets), n_buckets, key=key, c=c, d=d)
            return _listed(names, COUNTED, per, signed(x["key"]), x["c"], x["d"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 19:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64 if pa.types.is_integer(table.schema.field(column).type.value_type) else float), *(x.flatten().to_numpy(zero_copy_only=False) for x in table.column(column).chunks)])


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


def _level(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.floor(np.log2(np.maximum(counts, 0) + 1)).astype(np.int64)


def _step(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.log(ratio)
    return np.where(np.isfinite(x), np.clip(np.rint(x / _STEP), 1 - _CENTRE, _CENTRE - 1), -_CENTRE).astype(np.int64) + _CENTRE


def _context_code(words: Words, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Level and rounded log-ratio of the bigram estimate to the uniform one, by counts outside the deleted part."""
    return (_level(context) << 20) | (_step(pair / np.maximum(context, 1) / words.uniform) << 10)


def _token_code(words: Words, token: np.ndarray) -> np.ndarray:
    return _step(token / max(1, words.n - int(words.deleted.sum())) / words.uniform)


def _left(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of a bucket's rare words and their counts outside the deleted part."""
    part = _of_kind(table, COUNTED)
    keys, left = _flat(part, "keys").view(U), _flat(part, "others") - _flat(part, "counts")
    order = np.argsort(keys)
    return keys[order], left[order]


def _sum_bigrams(n_buckets: int, shared, most: int):
    """Counts of a bucket's bigrams -> the frequent ones, deleted tokens by level and rounded log-ratios, and what is still to be completed."""

    def run(table: pa.Table) -> pa.Table:
        words: Words = shared.value
        left = words.counts - words.deleted
        rare, rare_left = _left(table)
        of = lambda hashes: rare_left[np.searchsorted(rare, hashes)]
        codes, numbers, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []

        def summed(pair, counts):
            names, where = np.unique(pair, return_inverse=True)
            c = np.bincount(where, np.abs(counts), minlength=len(names)).astype(np.int64)
            return names, c, np.bincount(where, np.maximum(-counts, 0), minlength=len(names)).astype(np.int64)

        def add(context, pair, token, d):
            codes.append(_context_code(words, context, pair) | _token_code(words, token))
            numbers.append(d)

        for kind in (FREQUENT, RARE_TOKEN, RARE_CONTEXT, RARE_BOTH):
            part = _of_kind(table, kind)
            keys, counts = _flat(part, "keys").view(U), _flat(part, "counts")
            if kind == FREQUENT:
                names, c, d = summed(_unfold(table.column("bucket")[0].as_py(), _flat(part, "small"), n_buckets), counts)
                frequent = c * most >= words.n
                out.append(_listed(np.zeros(1, int), FOUND, np.array([frequent.sum()]), signed(names[frequent]), c[frequent], None))
                held = np.flatnonzero(d)
                add(left[(names[held] >> _SHIFT).astype(np.int64)], c[held] - d[held], left[(names[held] & _CLASS).astype(np.int64)], d[held])
                continue
            own, at = np.unique(keys, return_inverse=True)
            others, width = _flat(part, "others" if kind == RARE_BOTH else "small").astype(np.int64), 1 << 20
            if kind == RARE_BOTH:
                second, others = np.unique(others, return_inverse=True)
                width = max(1, len(second))
            names, c, d = summed(at * width + others, counts)
            held = np.flatnonzero(d)
            word, other, c, d = of(own[names[held] // width]), names[held] % width, c[held], d[held]
            if kind == RARE_TOKEN:
                add(left[other], c - d, word, d)
            elif kind == RARE_CONTEXT:
                add(word, c - d, left[other], d)
            else:
                b = second[other].view(U)
                used, x, per = scatter(_bucket(b, n_buckets), n_buckets, b=b, code=_context_code(words, word, c - d), d=d)
                out.append(_listed(used, PENDING, per, signed(x["b"]), x["code"], x["d"]))
        out.append(_coded(np.concatenate(codes), np.concatenate(numbers)))
        return pa.Table.from_batches(out)

    return run


def _coded(codes: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    codes, at = np.unique(codes, return_inverse=True)
    return _listed(np.zeros(1, int), CODES, np.array([len(codes)]), codes, np.bincount(at, numbers, minlength=len(codes)).astype(np.int64), None)


def _complete(shared):
    """Bigrams of two rare words, in the bucket of the second: codes of their deleted tokens."""

    def run(table: pa.Table) -> pa.Table:
        rare, left = _left(table)
        part = _of_kind(table, PENDING)
        at = np.searchsorted(rare, _flat(part, "keys").view(U))
        return pa.Table.from_batches([_coded(_flat(part, "others") | _token_code(shared.value, left[at]), _flat(part, "counts"))])

    return run


def learn_weights(codes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """EM for the weights of bigram, unigram and uniform by level, from rounded log-ratios to the uniform estimate."""
    out = np.tile([0.4, 0.4, 0.2], (64, 1))
    level = codes >> 20
    ratio = np.ones((len(codes), 3))
    for k, step in enumerate(((codes >> 10) & 1023, codes & 1023)):
        ratio[:, k] = np.where(step > 0, np.exp((step - _CENTRE) * _STEP), 0)
    for _ in range(rounds):
        share = out[level] * ratio
        share *= (counts / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(level, share[:, k], minlength=64) for k in range(3)], axis=1)
        seen = sums.sum(axis=1) > 0
        out[seen] = (sums[seen] + [0.1, 0.1, 0.1]) / (sums[seen].sum(axis=1, keepdims=True) + 0.3)
    return out


@dataclass
class Model:
    words: Words
    bigrams: Table  #: frequent bigrams, by mixed key
    counts: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        lam = self.weights.copy()
        lam[0, 0] = 0  # level 0: the context does not occur
        lam[:, 1] *= self.words.n > 0
        self.shares = lam / lam.sum(axis=1, keepdims=True)

    def log10(self, context: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of tokens, by the counts of the contexts, of the tokens and of the bigrams."""
        w, level = self.words, _level(context)
        p = self.shares[level, 0] * count / np.maximum(context, 1) + self.shares[level, 1] * token / max(w.n, 1) + self.shares[level, 2] * w.uniform
        return np.log10(p)


def train(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    words, rare = count_words(docs)
    shared, n = spark.sparkContext.broadcast(words), _buckets(words)
    rare = rare.mapInArrow(_rare_by_bucket(n), _COUNTS)
    bigrams = _folded(docs).mapInArrow(_count_bigrams(n, shared), _COUNTS).unionByName(rare)
    sums = written(_dealt(bigrams, "bucket", words).applyInArrow(_sum_bigrams(n, shared, BIGRAMS), _COUNTS), "bigrams")
    frequent = sums.filter(F.col("kind") == FOUND).select("keys", "others").toArrow()  # at most BIGRAMS bigrams
    key, c = mix(_flat(frequent, "keys").view(U)), _flat(frequent, "others")
    order = np.argsort(key)
    rest = _dealt(sums.filter(F.col("kind") == PENDING).unionByName(rare), "bucket", words).applyInArrow(_complete(shared), _COUNTS)
    pairs = sums.filter(F.col("kind") == CODES).unionByName(rest).select(F.explode(F.arrays_zip("keys", "others")).alias("x"))
    held = pairs.groupBy("x.keys").agg(F.sum("x.others").alias("number")).toArrow()  # at most 64 * 256 * 256 rows
    held = held.sort_by("keys")  # a fixed order of the sums
    weights = learn_weights(held.column("keys").to_numpy().astype(np.int64), held.column("number").to_numpy())
    return Model(words, Table(key[order]), c[order], weights)


def _buckets(words: Words) -> int:
    return max(LEAST_BUCKETS, -(-words.n // BUCKET))


def _dealt(rows: DataFrame, key: str, words: Words):
    """``rows`` grouped by ``key``, in as many partitions as their volume asks for."""
    return rows.repartition(max(fanout(rows.sparkSession), -(-words.n // BUCKET)), key).groupBy(key)


#: Kinds above: bigrams to be scored (texts: index * 2 + trained on; RARE_TOKEN has small -1 where the context is rare).  HEAD: a block's texts (ids,
#: small: tokens * 2 + held out, known, base, score).  PART: sums by text.  WORD: rare words' counts (others).  PAIR: of bigrams of two rare words the
#: second (keys), the counts of context << 32 | bigram (others), and blocks.
HEAD, PART, WORD, PAIR = range(5, 9)
_PARTS = "bucket int, kind int, block long, texts array<short>, keys array<long>, small array<int>, others array<long>, blocks array<long>, known array<int>, base array<double>, score array<double>"
_TYPES = {"texts": pa.int16(), "keys": pa.int64(), "small": pa.int32(), "others": pa.int64(), "blocks": pa.int64(), "known": pa.int32(), "base": pa.float64(), "score": pa.float64()}


def _part(bucket: np.ndarray, kind: int, block: np.ndarray | int, per: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows with a list of each of the columns, the other lists empty."""
    k = len(bucket)
    lead = [pa.array(bucket, pa.int32()), pa.array(np.full(k, kind), pa.int32()), pa.array(np.broadcast_to(block, k), pa.int64())]
    rest = [lists(columns[c], per, t) if c in columns else lists(np.zeros(0, np.int64), np.zeros(k, int), t) for c, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays([*lead, *rest], ["bucket", "kind", "block", *_TYPES])


def _score_blocks(n_buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for i, batch in enumerate(pieces(batches, limit=BLOCK, most=MOST_TEXTS)):
            block = (TaskContext.get().partitionId() << 32) + i
            texts, fold = Texts(batch.column("text")), batch.column("fold").to_numpy()
            owner, name, token, context = _classes(texts, model.words)
            n, counts, trained = len(fold), model.words.counts, fold != TEST_FOLD
            base = np.bincount(owner, np.where(token > 0, np.log10(counts[token] + 1.0), 0), minlength=n)
            n_known = np.bincount(owner, (token > 0) & (counts[token] > 0), minlength=n)
            often = np.flatnonzero((token > 0) & (context > 0))
            key = (context[often].astype(U) << _SHIFT) | token[often].astype(U)
            at = model.bigrams.find(mix(key)) if len(model.counts) else np.full(len(key), -1)
            sure, open_ = often[at >= 0], often[at < 0]
            score = np.bincount(owner[sure], model.log10(counts[context[sure]], counts[token[sure]], model.counts[at[at >= 0]]), minlength=n)
            rare = np.flatnonzero(token == 0)
            rare_token = (RARE_TOKEN, rare, name[rare], np.where(context[rare] > 0, context[rare], -1))
            marks = owner * 2 + trained[owner]
            bucket, rest = _fold(key[at < 0], n_buckets)
            used, c, per = scatter(bucket, n_buckets, small=rest, texts=marks[open_])
            yield _part(used, FREQUENT, block, per, **c)
            for kind, who, keys, others in (rare_token, *(x for x in _kinds(name, token, context) if x[0] != RARE_TOKEN)):
                columns = {"keys": signed(keys), "texts": marks[who], "others" if kind == RARE_BOTH else "small": others}
                used, c, per = scatter(_bucket(keys, n_buckets), n_buckets, **columns)
                yield _part(used, kind, block, per, **c)
            head = _part(np.array([block % n_buckets]), HEAD, block, np.array([n]), small=(texts.counts + 1) * 2 + ~trained, known=n_known, base=base, score=score)
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("doc_id"))
            yield head.set_column(head.schema.get_field_index("keys"), "keys", ids)

    return run


def _messages(table: pa.Table, kind: int) -> tuple[np.ndarray, ...]:
    """Blocks, texts, whether trained on, keys and others of a kind; those of a text in one block stand together."""
    part = _of_kind(table, kind)
    per = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in part.column("texts").chunks)]).astype(np.int64)
    texts = _flat(part, "texts").astype(np.int64)
    return np.repeat(part.column("block").to_numpy(), per), texts >> 1, texts & 1, _flat(part, "keys").view(U), _flat(part, "others" if kind == RARE_BOTH else "small").astype(np.int64)


class _Sums:
    """Sums of what is known, base and score by block and text."""

    def __init__(self):
        self.parts = []

    def add(self, block, text, known=None, base=None, score=None):
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
        at = np.cumsum(new) - 1
        n = int(new.sum())
        self.parts.append((block[new], text[new], *(np.zeros(n) if x is None else np.bincount(at, x, minlength=n) for x in (known, base, score))))

    def rows(self, bucket: int) -> pa.RecordBatch:
        block, text, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((text, block))
        block, text = block[order], text[order]
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
        at = np.cumsum(new) - 1
        known, base, score = (np.bincount(at, x[order], minlength=int(new.sum())) for x in values)
        blocks, per = np.unique(block[new], return_counts=True)
        return _part(np.full(len(blocks), bucket), PART, blocks, per, texts=text[new], known=np.rint(known).astype(np.int64), base=base, score=score)


def _counted(pair: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """How often each entry's value occurs in the training texts."""
    _, where = np.unique(pair, return_inverse=True)
    return np.bincount(where, trained)[where].astype(np.int64) if len(where) else np.zeros(0, np.int64)


def _score_buckets(n_buckets: int, shared):
    """Count a bucket's rare words and bigrams in the training texts and sum what they add to each text."""

    def run(table: pa.Table) -> pa.Table:
        model: Model = shared.value
        counts, sums, out = model.words.counts, _Sums(), []
        bucket = table.column("bucket")[0].as_py()
        block, text, trained, _, rest = _messages(table, FREQUENT)
        keys = _unfold(bucket, rest, n_buckets)
        context, token = (keys >> _SHIFT).astype(np.int64), (keys & _CLASS).astype(np.int64)
        sums.add(block, text, score=model.log10(counts[context], counts[token], _counted(keys, trained)))

        block, text, trained, keys, others = _messages(table, RARE_TOKEN)
        own, at = np.unique(keys, return_inverse=True)
        word = np.bincount(at, trained, minlength=len(own)).astype(np.int64)
        sums.add(block, text, known=word[at] > 0, base=np.log10(word[at] + 1.0))
        far = np.unique(at[others < 0])
        out.append(_part(np.array([bucket]), WORD, 0, np.array([len(far)]), keys=signed(own[far]), others=word[far]))
        near = others >= 0
        block, text, trained, at, others = (x[near] for x in (block, text, trained, at, others))
        sums.add(block, text, score=model.log10(counts[others], word[at], _counted((at << 20) | others, trained)))

        one, two = _messages(table, RARE_CONTEXT), _messages(table, RARE_BOTH)
        own, at = np.unique(np.concatenate([one[3], two[3]]), return_inverse=True)
        word = np.bincount(at, np.concatenate([one[2], two[2]]), minlength=len(own)).astype(np.int64)
        block, text, trained, keys, others = one
        first, at = at[: len(keys)], at[len(keys) :]
        sums.add(block, text, score=model.log10(word[first], counts[others], _counted((first << 20) | others, trained)))
        block, text, trained, _, others = two
        second, other = np.unique(others, return_inverse=True)
        count, b = _counted(at * max(1, len(second)) + other, trained), others.view(U)
        used, c, per = scatter(_bucket(b, n_buckets), n_buckets, keys=others, others=(word[at] << 32) | count, blocks=block, texts=text)
        out += [_part(used, PAIR, bucket, per, **c), sums.rows(bucket)]
        return pa.concat_tables([pa.Table.from_batches(out), _of_kind(table, HEAD).cast(out[0].schema)])

    return run


def _score_pairs(n_buckets: int, shared):
    """In the bucket of the second word, what bigrams of two rare words add to each text."""

    def run(table: pa.Table) -> pa.Table:
        model: Model = shared.value
        words, pairs = _of_kind(table, WORD), _of_kind(table, PAIR).sort_by("block")  # the bucket it comes from: a fixed order of the sums
        keys, count = _flat(words, "keys"), _flat(words, "others")
        order = np.argsort(keys)
        token = count[order][np.searchsorted(keys, _flat(pairs, "keys"), sorter=order)]
        others, sums = _flat(pairs, "others"), _Sums()
        sums.add(_flat(pairs, "blocks"), _flat(pairs, "texts"), score=model.log10(others >> 32, token, others & ((1 << 32) - 1)))
        rows = sums.rows(table.column("bucket")[0].as_py() + n_buckets)
        return pa.Table.from_batches([rows])

    return run


def _gather(n_train: int, vocabulary: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")  # a fixed order of the sums
        kinds = table.column("kind").to_numpy()
        head, rest = table.filter(pa.array(kinds == HEAD)), table.filter(pa.array(kinds == PART))
        ids = pa.concat_arrays([x.flatten() for x in head.column("keys").chunks])
        tokens, known, base, score = (_flat(head, c) for c in ("small", "known", "base", "score"))
        if rest.num_rows:
            t = _flat(rest, "texts").astype(np.int64)
            known, base, score = (x + np.bincount(t, _flat(rest, c), minlength=len(ids)) for x, c in ((known, "known"), (base, "base"), (score, "score")))
        n = (tokens >> 1).astype(np.int64)
        base = base - n * np.log10(n_train + vocabulary + 1)
        columns = [ids, pa.array((tokens & 1).astype(bool)), pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(n), n_train), pa.int64()), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs(doc_id, text)``."""
    model = train(docs)
    spark = docs.sparkSession
    release(spark)
    shared, n = spark.sparkContext.broadcast(model), _buckets(model.words)
    parts = _dealt(_folded(docs).mapInArrow(_score_blocks(n, shared), _PARTS), "bucket", model.words).applyInArrow(_score_buckets(n, shared), _PARTS)
    parts = written(parts, "scored", compression="zstd")
    release(spark)
    pairs = _dealt(parts.filter(F.col("kind").isin(WORD, PAIR)), "bucket", model.words).applyInArrow(_score_pairs(n, shared), _PARTS)
    parts = parts.filter(F.col("kind").isin(HEAD, PART)).unionByName(pairs)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _dealt(parts, "block", model.words).applyInArrow(_gather(model.words.n, model.words.vocabulary), schema)
