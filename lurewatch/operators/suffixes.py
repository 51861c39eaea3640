"""Public suffixes by a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attach, written


def split_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts(host)`` -> host, suffix, registered, subdomain for each distinct host, by ``rules(rule)``.

    A rule is a suffix such as ``co.uk``; with ``*.`` before it every name right below
    is a suffix, too; with ``!`` before it the name is none, whatever such a rule says.
    The longest rule counts, an exception before all; a host that no rule fits has its
    last label as suffix.  A host without a label before its suffix has nothing
    registered; addresses and hosts of one label have no suffix either.  Case, a dot at
    the end and blanks around don't matter; rows with a null host are left out.

    A longest-suffix join: every host asks with each of its tails, and the rows of a
    tail that very many hosts share, such as ``com``, are salted.
    """
    clean = F.lower(F.rtrim(F.trim("host"), F.lit(".")))
    names = hosts.select("host").filter("host IS NOT NULL").distinct().withColumn("labels", F.split(clean, r"\."))
    plain = ~clean.rlike(r"^[0-9.]+$") & ~F.contains("host", F.lit(":")) & (F.size("labels") >= 2) & ~F.exists("labels", lambda x: x == "")
    tail = lambda k: F.array_join(F.slice("labels", -k, k), ".")
    asked = names.filter(plain).select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.struct(tail(k).alias("tail"), k.alias("n")))).alias("t"), F.size("labels").alias("most")).select("host", "t.*", "most")
    text = F.lower(F.trim("rule"))
    kind = F.when(F.startswith(text, F.lit("!")), 2).when(F.startswith(text, F.lit("*.")), 1).otherwise(0)
    known = rules.select(F.substring(text, F.when(kind == 2, 2).when(kind == 1, 3).otherwise(1), F.length(text)).alias("tail"), kind.alias("kind")).filter("tail <> ''")
    known = known.groupBy("tail").agg(*(F.bool_or(F.col("kind") == k).alias(c) for k, c in enumerate(("own", "below", "never"))))
    asked = written(asked.join(known.select("tail"), "tail", "left_semi"), "asked-suffixes")
    sized = asked.groupBy("tail").agg(F.count("*").alias("size")).join(known, "tail")
    met = attach(asked, sized, "tail", "size", F.col("host"))
    # labels of the suffix by each rule; a wildcard rule needs a label to stand for
    longest = F.max(F.greatest(F.when(F.col("own"), F.col("n")), F.when(F.col("below") & (F.col("n") < F.col("most")), F.col("n") + 1)))
    best = met.groupBy("host").agg(F.max(F.when(F.col("never"), F.col("n") - 1)).alias("exception"), longest.alias("longest"))
    n = F.when(plain, F.coalesce("exception", "longest", F.lit(1)))
    out = names.join(best, "host", "left").withColumn("n", n)
    registered = F.when(F.size("labels") > F.col("n"), F.array_join(F.slice("labels", -(F.col("n") + 1), F.col("n") + 1), "."))
    rest = F.when(F.size("labels") > F.col("n") + 1, F.array_join(F.slice("labels", F.lit(1), F.size("labels") - F.col("n") - 1), "."))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return out.select("host", blank(F.when(F.col("n") > 0, F.array_join(F.slice("labels", -F.col("n"), F.col("n")), "."))).alias("suffix"), blank(registered).alias("registered"), blank(rest).alias("subdomain"))
