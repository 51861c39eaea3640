"""Enrichment of origins and indicators by left joins with snapshot tables.

Snapshots: ``prefixes(network, asn, org, country)``, ``geo(ip, city, region, country, isp, latitude, longitude)``,
``reputation(ip, abuse_score, reports, tor)``, ``hashes(sha256, status, engines)``, ``links(provider, url, status, malicious, score)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import address_bits, ip_class, network_bits
from .tables import attach, written

# Parts of organisation names, bounds of the abuse score, and states that tell nothing.
CLOUD = ("amazon", "aws", "google", "microsoft", "azure", "digitalocean", "linode", "vultr", "hetzner", "ovh", "cloudflare", "fastly", "akamai", "rackspace", "alibaba", "tencent")
VPN = ("vpn", "nordvpn", "expressvpn", "mullvad", "protonvpn", "private internet", "pia ", "surfshark", "cyberghost", "anonymizer", "hide.me")
ABUSE_SUSPICIOUS, ABUSE_MALICIOUS = 25, 75
MOST_URLS = 5
#: Names of the providers of link verdicts in the snapshot.
PROVIDERS = ("scanner", "sandbox")
SILENT = ("api_error", "error", "timeout", "not_configured", "disabled", "unavailable", "not_found", "skipped", "empty", "not_checked", "pending", "unknown")


def _named(org: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(org).rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))


def networks(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``ips(ip)`` -> ip, asn, org, country of the longest prefix, IPv4 or IPv6, that holds it; of equal ones the largest ASN text.

    A range join as an equi-join: every distinct address asks with its leading bits
    for each prefix length that occurs in its family (33 and 129 at most).  A prefix
    that holds a large share of the addresses, such as a default route, is one row
    that ``attach`` repeats over salted parts.
    """
    # both sides are written before anything is filtered: a filter on the bits would be pushed below the distinct, to every row
    nets = prefixes.select(network_bits(F.col("network")).alias("lead"), "asn", "org", "country")
    nets = written(nets.groupBy("lead").agg(F.max_by(F.struct("asn", "org", "country"), F.col("asn")).alias("net")), "prefixes").filter("lead IS NOT NULL")
    lengths = {f: sorted(r.n for r in rows) for f, rows in _by_family(nets).items()}
    asked = written(ips.select("ip").distinct().withColumn("bits", address_bits(F.col("ip"))), "addresses").filter("bits IS NOT NULL")
    leads = lambda f: F.transform(F.array(*map(F.lit, lengths.get(f, []))).cast("array<int>"), lambda n: F.left("bits", n))
    asked = asked.select("ip", F.explode(F.when(F.startswith("bits", F.lit("4:")), leads("4")).otherwise(leads("6"))).alias("lead"))
    asked = written(asked.join(nets.select("lead"), "lead", "left_semi"), "asked-prefixes")
    held = written(asked.groupBy("lead").agg(F.count("*").alias("size")).join(nets, "lead"), "held-prefixes")
    best = attach(asked, held, "lead", "size", F.col("ip")).groupBy("ip").agg(F.max_by("net", F.length("lead")).alias("net"))
    return best.select("ip", "net.asn", "net.org", "net.country")


def _by_family(nets: DataFrame) -> dict[str, list]:
    """Lengths of the leads that occur, by family: at most 162 rows."""
    out: dict[str, list] = {}
    for r in nets.select(F.left("lead", F.lit(1)).alias("family"), F.length("lead").alias("n")).distinct().collect():
        out.setdefault(r.family, []).append(r)
    return out


def origin_details(origins: DataFrame, prefixes: DataFrame, geo: DataFrame, reputation: DataFrame) -> DataFrame:
    """``origins(email_id, origin_ip, ...)`` with network, place and abuse; only public addresses are looked up."""
    public = F.coalesce(ip_class(F.col("origin_ip")) == "public", F.lit(False))
    keyed = origins.withColumn("ip", F.when(F.col("origin_ip").isNotNull() & public, F.col("origin_ip")))
    nets = networks(keyed.select("ip"), prefixes).withColumnsRenamed({"country": "net_country"})
    places = geo.dropDuplicates(["ip"]).withColumnsRenamed({"country": "geo_country"})
    abuse = reputation.groupBy("ip").agg(F.max("abuse_score").alias("abuse_score"), F.max("reports").alias("reports"), F.bool_or("tor").alias("tor"))
    out = keyed.join(nets, "ip", "left").join(places, "ip", "left").join(abuse, "ip", "left")
    state = F.when(F.col("ip").isNull(), "skipped").when(F.col("abuse_score").isNull(), "not_found").otherwise("available")
    flags = {"cloud": _named(F.col("org"), CLOUD), "vpn": _named(F.col("org"), VPN), "tor": F.coalesce("tor", F.lit(False))}
    named = {"geo_status": F.when(F.col("ip").isNull(), "skipped").when(F.col("geo_country").isNull(), "not_found").otherwise("available"), "abuse_status": state, "country": F.coalesce("geo_country", "net_country"), "isp": F.coalesce("isp", "org")}
    return out.withColumns({**flags, **named, "abuse_malicious": F.coalesce(F.col("abuse_score") >= ABUSE_SUSPICIOUS, F.lit(False))}).drop("ip", "net_country", "geo_country")


def confirmed(status: Column, malicious: Column) -> Column:
    """whether a look-up says malicious and its state means anything."""
    return ~F.lower(F.coalesce(status, F.lit(""))).isin(*SILENT) & F.coalesce(malicious, F.lit(False))


def hash_verdicts(attachments: DataFrame, hashes: DataFrame) -> DataFrame:
    """``attachments(email_id, filename, sha256)`` with status, engines and malicious (any engine)."""
    known = hashes.groupBy("sha256").agg(F.max("status").alias("status"), F.max("engines").alias("engines"))
    out = attachments.select("email_id", "filename", "sha256").join(known, "sha256", "left").withColumns({"status": F.coalesce("status", F.lit("not_found")), "engines": F.coalesce("engines", F.lit(0))})
    return out.withColumn("malicious", confirmed(F.col("status"), F.col("engines") > 0))


def url_verdicts(urls: DataFrame, links: DataFrame, providers: tuple[str, ...] = PROVIDERS, most: int = MOST_URLS) -> DataFrame:
    """of each email's first ``most`` URLs (email_id, n, url) the verdict of every provider; the cut is the feature's own."""
    first = urls.withColumn("k", F.row_number().over(Window.partitionBy("email_id").orderBy("n"))).filter(F.col("k") <= most).drop("k")
    asked = first.withColumn("provider", F.explode(F.array(*map(F.lit, providers))))
    known = links.groupBy("provider", "url").agg(F.max("status").alias("status"), F.bool_or("malicious").alias("malicious"), F.max("score").alias("score"))
    out = asked.join(known, ["provider", "url"], "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
    return out.withColumn("malicious", confirmed(F.col("status"), F.col("malicious")))


def found_signals(origins: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """F8: signals (email_id, signal_id, level, category, text) from ``origin_details``, ``hash_verdicts`` and ``url_verdicts``."""
    score = F.col("abuse_score")
    row = lambda ident, level, category, text: (F.lit(ident).alias("signal_id"), level.alias("level"), F.lit(category).alias("category"), text.alias("text"))
    bad_ip = origins.filter("abuse_malicious").select("email_id", *row("TI_ABUSE_SCORE", F.when(score >= ABUSE_MALICIOUS, "critical").otherwise("high"), "origin", F.concat(F.lit("sending address reported with a score of "), score.cast("string"))))
    bad_file = files.filter("malicious").select("email_id", *row("TI_MALICIOUS_FILE", F.lit("critical"), "ioc", F.concat(F.lit("attachment found malicious by "), F.col("engines").cast("string"), F.lit(" engines"))))
    bad_link = links.filter("malicious").select("email_id", *row("TI_MALICIOUS_URL", F.lit("high"), "ioc", F.concat(F.lit("link found malicious by "), F.col("provider"))))
    return bad_ip.unionByName(bad_file).unionByName(bad_link)


def marked_urls(urls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """F8: ``urls(email_id, n, url, suspicious)``; a URL that any provider calls malicious is suspicious."""
    bad = verdicts.filter("malicious").select("email_id", "url", F.lit(True).alias("bad")).distinct()
    return urls.join(bad, ["email_id", "url"], "left").withColumn("suspicious", F.col("suspicious") | F.coalesce("bad", F.lit(False))).drop("bad")
