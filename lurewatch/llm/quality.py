"""Quality rules: rule counts and a hashed n-gram log-likelihood ratio (DataFrame operations only).

The n-grams are the words and the pairs of adjacent words, as written, each kind
hashed to a fixed number of values.  Two multinomials over each kind are
estimated: one from the whole raw corpus, with additive smoothing, and one from
trusted documents, smoothed by so many pseudo-counts spread like the raw one, so
that what trusted documents say little about weighs little.  A document's score is its log-likelihood ratio divided by
its number of n-grams and a small constant; every document at or over the
threshold passes.  The weights (one number per hash value, so of fixed size)
become constant arrays in the plan, and scoring is a projection without a
shuffle.

Defined cases: null text has no words; a document without n-grams scores 0;
without trusted documents both multinomials are equal and every score is 0; repeated rows are judged row by row; an empty
table gives an empty result; further columns are carried by ``passing``
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, words

#: Hash values of each kind of n-gram.
HASHES = 1 << 15
#: The score is the log-ratio's sum divided by the n-grams plus ``PRIOR``, so short texts lean to 0; under THRESHOLD a document is rejected.
PRIOR, THRESHOLD = 20, -0.10
#: Pseudo-counts of the trusted multinomial, for each hash value.
SMOOTHING = 5.0
WINDOW = 8
Weights = tuple[list[float], list[float]]


def _values(hashes: Column, above: int = 0) -> Column:
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(HASHES)).cast("int") + above)


def train(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING, max_trusted: int = 20_000) -> Weights:
    """Log-ratio weight of each hash value of words, and of pairs of words.

    The raw counts cover all of ``docs(doc_id, text)``; the target counts cover
    the documents of at most ``max_trusted`` ids of ``trusted(doc_id)``, chosen by
    hash, so the ids can be broadcast and no text is shuffled.
    """
    ids = trusted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("trusted", F.lit(1))), "doc_id", "left")
    one = flagged.select("trusted", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("one"))
    both = one.select("trusted", "one", _doubled(F.col("one"), 1).alias("two"))
    grams = both.select("trusted", F.explode(F.concat(_values(F.col("one")), _values(F.col("two"), HASHES))).alias("h"))
    counts = grams.groupBy("h").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    raw, target = [0] * (2 * HASHES), [0] * (2 * HASHES)
    for h, a, b in counts.collect():  # at most 2 * HASHES rows
        raw[h], target[h] = a, b

    def ratios(raw: list[int], target: list[int]) -> list[float]:
        n_raw, n_target, spread = sum(raw) + HASHES, sum(target) + smoothing * HASHES, smoothing * HASHES
        shares = [(a + 1) / n_raw for a in raw]
        return [math.log((b + spread * p) / n_target) - math.log(p) for b, p in zip(target, shares, strict=True)]

    return ratios(raw[:HASHES], target[:HASHES]), ratios(raw[HASHES:], target[HASHES:])


def _weights(values: list[float]) -> Column:
    """The weights as a constant that the optimizer folds into one array."""
    return F.from_json(F.lit("[" + ",".join(f"{v:.4f}" for v in values) + "]"), "array<double>")


def _doubled(hashes: Column, span: int) -> Column:
    """From the hash of the ``span`` words at each position, that of ``2 * span`` words, where so many follow."""
    both = F.zip_with(hashes, F.slice(hashes, span + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, 1, F.greatest(F.size(hashes) - span, F.lit(0)))


def _starts(order: Column) -> Column:
    """Ascending positions of windows that occur twice or more; ``order``: (hash, position) sorted."""
    twice = F.transform(order, lambda x, k: F.when((F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]), x["i"]))
    return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words in the windows that begin at ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )


def judge(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``quality`` (named otherwise if taken) of counts, score and verdict.

    quality: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept, and a row number without meaning.
    """
    # each step is a column of its own: what a lambda reads by position must not be computed again for each element
    name = own_name(docs, "quality")
    inner = [own_name(docs, c) for c in ("word_list", "line_list", "word_hashes", "hashes_2", "hashes_4", "hashes_8", "window_order", "window_starts")]
    list_, lines_, one_, two_, _, windows_, order_, starts_ = map(F.col, inner)
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.withColumns({inner[0]: words(F.col("text")), inner[1]: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    parts = parts.withColumn(inner[2], F.transform(list_, lambda w: F.xxhash64(w)))
    for k, (name_from, name_to) in enumerate(zip(inner[2:5], inner[3:6], strict=True)):
        parts = parts.withColumn(name_to, _doubled(F.col(name_from), 1 << k))
    n = F.size(list_)
    order = F.array_sort(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    parts = parts.withColumn(inner[6], F.when(F.size(F.array_distinct(windows_)) < F.size(windows_), order))
    parts = parts.withColumn(inner[7], _starts(order_))
    total = lambda grams, table: F.aggregate(grams, F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(HASHES)).cast("int")))
    score = (total(one_, _weights(weights[0])) + total(two_, _weights(weights[1]))) / (F.size(one_) + F.size(two_) + PRIOR)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(list_, "")).cast("long").alias("word_chars"),
        sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in "#*$%&|<>"), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(starts_), F.lit(0).cast("long")).alias("n_repeat_words"),
        score.alias("score"),
        # keeps the optimizer from moving a caller's condition below these steps and repeating their expressions inside lambdas
        F.monotonically_increasing_id().alias("row"),
    )
    counted = parts.withColumn(name, counts).drop(*inner)
    q = F.col(name)
    failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    return counted.withColumn(name, q.withField("base_failed", failed).withField("kept", ~failed & (q["score"] >= threshold)))


def verdicts(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train and judge: doc_id, the counts, base_failed, kept and score for each row."""
    judged = judge(docs.select("doc_id", "text"), train(docs, trusted), threshold)
    q = F.col("quality")
    return judged.select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.round(q["score"], 4).alias("score"))


def passing(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    judged = judge(docs, train(docs, trusted), threshold)
    return judged.filter(F.col(own_name(docs, "quality"))["kept"]).select(*docs.columns)
