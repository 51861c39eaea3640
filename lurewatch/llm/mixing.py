"""Mixing sources to target weights by hierarchical budgets (DataFrame operations only).

Leaves are (domain, language, source).  A leaf can supply ``max_epochs`` times
its tokens.  Going down the tree, a node's budget is poured over its children
in proportion to their weights; a child that can't take its share is filled and
the shortage goes to its siblings (water-filling in closed form by a window
over the children), so it reaches an ancestor's siblings only if the whole
subtree is full.  A leaf's budget buys whole epochs and then a prefix of one
more, in an order seeded by leaf position and epoch number (MD5 of seed, epoch
and doc_id).

A leaf's prefix is found without sorting it: token sums by the first
``4 * HEX`` bits of the order key give the one bin where the budget ends, and
only that bin is ordered document by document.  A leaf with a third of all rows
is thus cut into ``16 ** HEX`` parts.

Defined cases: null domain, language or source forms a leaf of its own; null,
empty or blank text has no tokens and is never taken; rows that repeat a doc_id
tie in the order, are ordered by token count and may be cut as any others; an
empty table gives an empty result; further columns are carried by ``mixed``
whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, attach, own_name, written

HEX = 3
#: Target weights: domains, languages, sources; what isn't listed weighs 1.
WEIGHTS: dict[str, Mapping[str, float]] = {
    "domain": {"web": 5.0, "books": 3.0, "code": 2.0, "other": 1.0},
    "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src0": 2.0},
}
LEVELS = ("domain", "lang", "source")


def domain(source: Column) -> Column:
    """The domain of a source, by the number in its name."""
    k = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)$", 1).try_cast("int")
    return F.when(k < 6, "web").when(k < 12, "books").when(k < 16, "code").otherwise("other")


def n_tokens(text: Column) -> Column:
    """Number of words, without building them."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    starts = F.regexp_count(inner, F.lit(SPACE)) + 1
    return F.when(inner == "", 0).otherwise(starts).cast("long")


def _weight(level: str, weights) -> Column:
    out = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, float(w)).otherwise(out)
    return out


def _leaf() -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\0")) for c in LEVELS)).alias("leaf")


def budgets(leaves: DataFrame, budget: Column, weights=WEIGHTS, max_epochs: int = 4) -> DataFrame:
    """``leaves(domain, lang, source, tokens, n_docs)`` with each leaf's token budget (column ``budget``, long)."""
    filled = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs).cast("double")).withColumn("given", budget.cast("double"))
    for depth, level in enumerate(LEVELS):
        parents, node = LEVELS[:depth], LEVELS[: depth + 1]
        children = filled.groupBy(*node).agg(F.sum("cap").alias("room"), F.first("given").alias("given"))
        children = children.withColumn("w", _weight(level, weights)).withColumn("fill", F.col("room") / F.col("w"))
        siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        upward = siblings.orderBy("fill", *node)
        before = F.coalesce(F.sum("room").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("w").over(upward.rowsBetween(0, Window.unboundedFollowing))
        water = F.max(F.when((F.col("given") - before) / left <= F.col("fill"), (F.col("given") - before) / left)).over(siblings)
        children = children.withColumn("share", F.least("room", F.coalesce(F.greatest(water, F.lit(0.0)) * F.col("w"), F.col("room"))))
        shares = children.select(*(F.col(c).alias(f"node_{c}") for c in node), "share")
        same = [F.col(c).eqNullSafe(F.col(f"node_{c}")) for c in node]
        filled = filled.join(shares, same).select(*LEVELS, "tokens", "n_docs", "cap", F.col("share").alias("given"))
    return filled.select(*LEVELS, "tokens", "n_docs", F.floor(F.round("given", 6)).cast("long").alias("budget"))


def plan(docs: DataFrame, *, weights=WEIGHTS, max_epochs: int = 4, budget_share: float = 1.0, seed: int = 17, domain_of=domain, keys: tuple[Column, ...] = ()) -> DataFrame:
    """What to take of each row of ``docs(doc_id, lang, source, text)``.

    Returns doc_id, domain, lang, source, n_tokens, leaf_budget, epochs (whole
    passes) and prefix_tokens (tokens taken in the last, partial pass: all of
    them, a cut of the document at the budget's end, or none).  The total budget
    is ``budget_share`` of all tokens.  ``keys`` are further columns to carry along.
    """
    sized = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens"), *keys)
    rows = written(sized, "mix-sizes")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shares = written(budgets(leaves, F.lit(int(total * budget_share)), weights, max_epochs), "mix-budgets")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    part = F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)
    shares = shares.select(_leaf(), F.col("budget").alias("leaf_budget"), whole.alias("epochs"), part.alias("rest"), "n_docs")
    keyed = attach(rows.withColumn("leaf", _leaf()), shares, "leaf", "n_docs", F.col("doc_id"))
    keyed = keyed.withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    keyed = keyed.withColumn("bin", F.substring("order", 1, HEX))
    sums = keyed.groupBy("leaf", "bin").agg(F.sum("n_tokens").alias("bin_tokens"), F.first("rest").alias("rest"))
    upto = F.sum("bin_tokens").over(Window.partitionBy("leaf").orderBy("bin"))
    sums = sums.withColumn("bin_room", F.col("rest") - (upto - F.col("bin_tokens"))).select("leaf", "bin", "bin_room", "bin_tokens")
    placed = keyed.join(sums, ["leaf", "bin"])
    edge = (F.col("bin_room") > 0) & (F.col("bin_room") < F.col("bin_tokens"))
    last = placed.filter(edge)
    before = F.sum("n_tokens").over(Window.partitionBy("leaf").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("bin_room") - F.coalesce(before, F.lit(0)))))
    rest = placed.filter(~edge).withColumn("prefix_tokens", F.when(F.col("bin_room") > 0, F.col("n_tokens")).otherwise(0))
    carried = rows.columns[5:]
    return last.unionByName(rest).select("doc_id", *carried, *LEVELS, "n_tokens", "leaf_budget", "epochs", F.col("prefix_tokens").cast("long").alias("prefix_tokens"))


def text_prefix(text: Column, k: Column) -> Column:
    """The text up to the end of its ``k``-th token; it must have more than ``k``."""
    lead = text.rlike(rf"^{SPACE}").cast("int")
    rest = F.element_at(F.split(text, SPACE, (k + 1 + lead).cast("int")), -1)
    return F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), rf"{SPACE}$", "")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the mix, once for each epoch they are taken in, with their columns.

    The document that a leaf's budget ends in is cut to its first tokens (and so
    is ``n_chars``, if there is such a column).  Rows that repeat both doc_id and
    text are taken as often as the most taken of them.
    """
    name = {c: own_name(docs, c) for c in ("key_id", "key_text", "times", "prefix", "copy")}
    digest = F.xxhash64("text").alias("text_key")
    taken = plan(docs, keys=(digest,), **options).filter("n_tokens > 0 AND (epochs > 0 OR prefix_tokens > 0)")
    part = F.when(F.col("prefix_tokens") < F.col("n_tokens"), F.col("prefix_tokens")).otherwise(0)
    most = taken.groupBy("doc_id", "text_key").agg(F.max(F.struct((F.col("epochs") + (F.col("prefix_tokens") > 0).cast("long")).alias("times"), part.alias("prefix"))).alias("m"))
    most = most.select(F.col("doc_id").alias(name["key_id"]), F.col("text_key").alias(name["key_text"]), F.col("m.times").cast("int").alias(name["times"]), F.col("m.prefix").alias(name["prefix"]))
    both = docs.join(most, docs["doc_id"].eqNullSafe(F.col(name["key_id"])) & (F.xxhash64(docs["text"]) == F.col(name["key_text"])))
    both = both.withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["times"]))))
    cut = (F.col(name["copy"]) == F.col(name["times"])) & (F.col(name["prefix"]) > 0)
    text = F.when(cut, text_prefix(docs["text"], F.col(name["prefix"]))).otherwise(docs["text"])
    size = {c: F.when(cut, F.length(text).cast(t)).otherwise(docs[c]) for c, t in docs.dtypes if c == "n_chars"}
    return both.select(*(text.alias(c) if c == "text" else size[c].alias(c) if c in size else docs[c] for c in docs.columns))
