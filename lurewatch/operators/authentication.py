"""Sender authentication (E1-E10) against DNS snapshot tables: joins instead of look-ups.

Snapshots: ``spf(domain, record)``, ``a(host, ip)``, ``mx(domain, host)``, ``dmarc(domain, record)``, ``keys(domain, selector, key_bits)``.
Every join is by domain or host; the address is compared with a mechanism's network in the joined row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import address_bits, network_bits
from .tables import written

#: Look-ups that a record may cost up to the mechanism that decides, and levels of records that are followed.
MOST_LOOKUPS = 10
RESULTS = {"+": "pass", "-": "fail", "~": "softfail", "?": "neutral"}
LEGAL = {"spf": ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror"), "dkim": ("pass", "fail", "none"), "dmarc": ("pass", "fail", "none"), "arc": ("pass", "fail", "none")}


def in_network(ip: Column, network: Column) -> Column:
    """Whether an address lies in a network ``address/bits``, or equals it without bits; false across families and for what can't be read."""
    held = lambda x: F.startswith(x["ip"], x["net"])
    return F.coalesce(F.transform(F.array(F.struct(address_bits(ip).alias("ip"), network_bits(network).alias("net"))), held)[0], F.lit(False))


def tags(record: Column, *, lower: bool = True) -> Column:
    """Map of the ``name = value;`` pairs of a record; the last of a name counts."""
    pairs = F.regexp_extract_all(F.coalesce(record, F.lit("")), F.lit(r"(\w+\s*=\s*[^;]+)"), F.lit(1))
    name = lambda p: F.lower(F.regexp_extract(p, r"^(\w+)", 1)) if lower else F.regexp_extract(p, r"^(\w+)", 1)
    value = lambda p: F.trim(F.regexp_replace(p, r"^\w+\s*=\s*", ""))
    both = F.transform(pairs, lambda p: F.struct(name(p).alias("k"), value(p).alias("v")))
    names = F.array_distinct(F.transform(both, lambda x: x["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(both, lambda x: x["k"] == k), -1)["v"]))


def organisation(domain: Column) -> Column:
    """The last two labels."""
    return F.substring_index(F.rtrim(domain, F.lit(".")), ".", -2)


def mechanisms(spf: DataFrame) -> DataFrame:
    """Domain, pos, result, kind, value of the mechanisms of each domain's SPF record; of several records the least."""
    picked = spf.filter(F.lower(F.col("record")).startswith("v=spf1")).groupBy("domain").agg(F.min("record").alias("record"))
    each = picked.select("domain", F.posexplode(F.split(F.trim("record"), r"\s+")).alias("pos", "term")).filter("pos > 0")
    sign = F.regexp_extract("term", r"^([+~?-])", 1)
    bare = F.regexp_replace("term", r"^[+~?-]", "")
    low = F.lower(bare)
    kind = (
        F.when(low == "all", "all").when((low == "a") | low.startswith("a:") | low.startswith("a/"), "a").when(low.startswith("mx"), "mx")
        .when(low.startswith("ip4:") | low.startswith("ip6:"), "ip").when(low.startswith("include:"), "include").when(low.startswith("redirect="), "redirect")
    )
    own = F.regexp_extract(bare, r"^[^:=]*[:=](.*)$", 1)
    value = F.when(kind.isin("a", "mx") & (own == ""), F.col("domain")).otherwise(own)
    result = F.coalesce(*(F.when(sign == k, v) for k, v in RESULTS.items()), F.lit("pass"))
    return each.select("domain", "pos", result.alias("result"), kind.alias("kind"), value.alias("value")).filter("kind IS NOT NULL")


def spf_results(checks: DataFrame, spf: DataFrame, a: DataFrame, mx: DataFrame) -> DataFrame:
    """``checks(domain, ip)`` -> domain, ip, result for each distinct pair.

    Included and redirected records are followed level by level, at most
    ``MOST_LOOKUPS`` levels; then the levels are evaluated from the deepest up:
    of each pair the first mechanism that matches decides.  A record without a
    match is neutral; no record is none; more than ``MOST_LOOKUPS`` look-ups up
    to the deciding mechanism are a permerror.
    """
    terms = written(mechanisms(spf), "spf-terms")
    at = a.select(F.col("host").alias("value"), F.col("ip").alias("found")).distinct()
    via = mx.select(F.col("domain").alias("value"), F.rtrim("host", F.lit(".")).alias("host")).join(a, "host").select("value", F.col("ip").alias("found")).distinct()
    hosts = at.withColumn("kind", F.lit("a")).unionByName(via.withColumn("kind", F.lit("mx"))).groupBy("kind", "value").agg(F.collect_set("found").alias("ips"))
    levels = [written(checks.select("domain", "ip").distinct(), "spf-level")]
    follow = terms.filter("kind IN ('include', 'redirect')").select("domain", "value").distinct()
    while len(levels) <= MOST_LOOKUPS:
        deeper = levels[-1].join(follow, "domain").select(F.col("value").alias("domain"), "ip").distinct()
        deeper = written(deeper, "spf-level")
        if deeper.isEmpty():
            break
        levels.append(deeper)
    known = None
    for pairs in reversed(levels):
        rows = pairs.join(terms, "domain").join(hosts, ["kind", "value"], "left")
        if known is None:
            rows = rows.withColumns({"inner": F.lit(None).cast("string"), "inner_cost": F.lit(0).cast("long")})
        else:
            inner = known.select(F.col("domain").alias("value"), "ip", F.col("result").alias("inner"), F.col("cost").alias("inner_cost"))
            rows = rows.join(inner, ["value", "ip"], "left")
        matched = (
            F.when(F.col("kind") == "all", True).when(F.col("kind").isin("a", "mx"), F.array_contains("ips", F.col("ip")))
            .when(F.col("kind") == "ip", in_network(F.col("ip"), F.col("value"))).when(F.col("kind") == "include", F.col("inner") == "pass")
            .when(F.col("kind") == "redirect", F.lit(True))
        )
        outcome = F.when(F.col("kind") == "redirect", F.when(F.coalesce("inner", F.lit("none")) == "none", "permerror").otherwise(F.col("inner"))).otherwise(F.col("result"))
        cost = F.when(F.col("kind").isin("a", "mx"), 1).when(F.col("kind").isin("include", "redirect"), 1 + F.coalesce("inner_cost", F.lit(0))).otherwise(0)
        rows = rows.select("domain", "ip", "pos", F.coalesce(matched, F.lit(False)).alias("matched"), outcome.alias("outcome"), cost.alias("cost"))
        first = rows.groupBy("domain", "ip").agg(F.min_by("outcome", F.when(F.col("matched"), F.col("pos"))).alias("result"), F.min(F.when(F.col("matched"), F.col("pos"))).alias("end"))
        spent = rows.join(first.select("domain", "ip", "end"), ["domain", "ip"]).filter("end IS NULL OR pos <= end").groupBy("domain", "ip").agg(F.sum("cost").alias("cost"))
        result = first.join(spent, ["domain", "ip"], "left").select("domain", "ip", F.coalesce("result", F.lit("neutral")).alias("result"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))
        known = pairs.join(result, ["domain", "ip"], "left").select("domain", "ip", F.when(F.col("cost") > MOST_LOOKUPS, "permerror").otherwise(F.coalesce("result", F.lit("none"))).alias("result"), F.coalesce("cost", F.lit(0).cast("long")).alias("cost"))
        known = written(known, "spf-results")
    return known.select("domain", "ip", "result")


def _aligned(domain: Column, other: Column, mode: Column) -> Column:
    same = F.when(mode == "s", F.lower(domain) == F.lower(other)).otherwise(organisation(domain) == organisation(other))
    return F.coalesce((F.coalesce(other, F.lit("")) != "") & same, F.lit(False))


def dmarc_results(mails: DataFrame, dmarc: DataFrame) -> DataFrame:
    """E5: ``mails(email_id, from_domain, spf, spf_domain, dkim, dkim_domain)`` with the policy of the domain, else of its organisation, and the verdict."""
    records = dmarc.filter(F.lower(F.trim("record")).startswith("v=dmarc1")).groupBy("domain").agg(F.min("record").alias("record"))
    own = records.select(F.col("domain").alias("from_domain"), F.col("record").alias("own_record"))
    parent = records.select(F.col("domain").alias("organisation"), F.col("record").alias("org_record"))
    found = mails.withColumn("organisation", organisation(F.col("from_domain"))).join(own, "from_domain", "left").join(parent, "organisation", "left")
    found = found.withColumn("record", F.coalesce("own_record", "org_record")).withColumn("t", tags(F.col("record")))
    t = lambda k: F.col("t")[k]
    policy = lambda k: F.when(F.lower(t(k)).isin("none", "quarantine", "reject"), F.lower(t(k)))
    has = F.col("record").isNotNull()
    uris = lambda k: F.filter(F.transform(F.split(F.coalesce(t(k), F.lit("")), ","), F.trim), lambda u: u != "")
    mode = lambda k: F.lower(F.coalesce(t(k), F.lit("r")))
    side = lambda ok: F.when(has, F.when(ok, "pass").otherwise("fail"))
    spf_side = side((F.col("spf") == "pass") & _aligned(F.col("from_domain"), F.col("spf_domain"), mode("aspf")))
    dkim_side = side((F.col("dkim") == "pass") & _aligned(F.col("from_domain"), F.col("dkim_domain"), mode("adkim")))
    out = found.select(
        "email_id", "from_domain", policy("p").alias("policy"), policy("sp").alias("subdomain_policy"), F.when(has, F.coalesce(t("pct"), F.lit("100")).try_cast("int")).alias("pct"),
        uris("rua").alias("rua"), uris("ruf").alias("ruf"), spf_side.alias("spf_alignment"), dkim_side.alias("dkim_alignment"),
    )
    ok = (F.col("spf_alignment") == "pass") | (F.col("dkim_alignment") == "pass")
    return out.withColumn("dmarc", F.when(F.col("spf_alignment").isNull(), "none").when(ok, "pass").otherwise("fail"))


def arc_result(seals: Column) -> Column:
    """struct(result, chain_length, cv) of the ARC seals of a message, ordered by instance."""
    parsed = F.transform(F.coalesce(seals, F.array().cast("array<string>")), lambda s: F.struct(F.coalesce(tags(s)["i"].try_cast("int"), F.lit(0)).alias("i"), F.lower(F.coalesce(tags(s)["cv"], F.lit(""))).alias("cv")))
    chain = F.array_sort(parsed)
    n = F.size(chain)
    sequential = F.transform(chain, lambda x: x["i"]) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    broken, start, last = F.exists(chain, lambda x: x["cv"] == "fail"), F.get(chain, 0)["cv"], F.get(chain, n - 1)["cv"]
    result = F.when(n == 0, "none").when(~sequential | (start != "none") | broken, "fail").otherwise("pass")
    cv = F.when(n == 0, None).when(~sequential, "invalid").when((start == "none") & broken, "fail").otherwise(last)
    return F.struct(result.alias("result"), n.alias("chain_length"), cv.alias("cv"))


def dkim_tags(signature: Column) -> Column:
    """struct(present, domain, selector, algorithm) of a signature header."""
    t = tags(signature, lower=False)
    return F.struct((F.coalesce(signature, F.lit("")) != "").alias("present"), t["d"].alias("domain"), t["s"].alias("selector"), t["a"].alias("algorithm"))


def with_keys(mails: DataFrame, keys: DataFrame) -> DataFrame:
    """``mails(dkim_domain, dkim_selector, ...)`` with the key's bits and whether it is weak (under 1,024)."""
    own = keys.groupBy(F.col("domain").alias("dkim_domain"), F.col("selector").alias("dkim_selector")).agg(F.max("key_bits").alias("dkim_key_bits"))
    return mails.join(own, ["dkim_domain", "dkim_selector"], "left").withColumn("weak_key", F.coalesce(F.col("dkim_key_bits") < 1024, F.lit(False)))


def preferred(kind: str, evaluated: Column, recorded: Column) -> Column:
    """struct(result, source): the evaluated verdict unless it is none and the recorded one is legal."""
    found, other = F.coalesce(evaluated, F.lit("none")), F.lower(recorded)
    use = (found == "none") & F.coalesce(other.isin(*LEGAL[kind]), F.lit(False))
    return F.struct(F.when(use, other).otherwise(found).alias("result"), F.when(use, "recorded").otherwise("evaluated").alias("source"))


def all_pass(spf: Column, dkim: Column, dmarc: Column) -> Column:
    """E11."""
    return F.coalesce((spf == "pass") & (dkim == "pass") & (dmarc == "pass"), F.lit(False))
