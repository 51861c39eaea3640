"""Knowledge graph as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as norm

# Labels with their key, and relationship types.
LABELS = {"Email": "email_id", "Domain": "name", "IP": "address", "URL": "url_hash", "Hash": "value", "Campaign": "campaign_id", "ASN": "number"}
RELATIONSHIPS = ("SENT_FROM", "CONTAINS_DOMAIN", "CONTAINS_URL", "CONTAINS_HASH", "HOSTED_ON_DOMAIN", "RESOLVES_TO", "BELONGS_TO_ASN", "MEMBER_OF", "USES_DOMAIN", "USES_IP", "USES_URL", "USES_HASH", "SAME_INFRASTRUCTURE")


def check_label(label: str) -> str:
    """J6."""
    if label not in LABELS:
        raise ValueError(f"unknown label {label!r}")
    return label


def _edges(df: DataFrame, src: str, src_key: Column, rel: str, dst: str, dst_key: Column) -> DataFrame:
    if rel not in RELATIONSHIPS:
        raise ValueError(f"unknown relationship {rel!r}")
    out = df.select(F.lit(check_label(src)).alias("src_label"), src_key.alias("src_key"), F.lit(rel).alias("rel"), F.lit(check_label(dst)).alias("dst_label"), dst_key.alias("dst_key"))
    return out.filter("coalesce(src_key, '') <> '' AND coalesce(dst_key, '') <> ''")


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def edges(emails: DataFrame, iocs: DataFrame, resolves: DataFrame, asn: DataFrame | None = None) -> DataFrame:
    """Distinct edges of emails, their indicators, ``resolves(domain, ip)`` and ``asn(ip, number)``."""
    kind = lambda k: iocs.filter(F.col("kind") == k)
    url = F.sha2("value", 256)
    parts = [
        _edges(emails, "Email", F.col("email_id"), "SENT_FROM", "Domain", F.col("sender_domain")),
        _edges(kind("domain"), "Email", F.col("email_id"), "CONTAINS_DOMAIN", "Domain", F.col("value")),
        _edges(kind("url"), "Email", F.col("email_id"), "CONTAINS_URL", "URL", url),
        _edges(kind("url"), "URL", url, "HOSTED_ON_DOMAIN", "Domain", url_host(F.col("value"))),
        _edges(kind("hash"), "Email", F.col("email_id"), "CONTAINS_HASH", "Hash", F.col("value")),
        _edges(resolves, "Domain", F.col("domain"), "RESOLVES_TO", "IP", F.col("ip")),
    ]
    if asn is not None:
        parts.append(_edges(asn, "IP", F.col("ip"), "BELONGS_TO_ASN", "ASN", F.col("number")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def upsert_nodes(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows (label, key, seq, risk_score, name) merged: the latest non-null value of each property wins.

    The result has created_seq and updated_seq; a stored table of that shape
    goes in as the earliest writer.
    """
    log = batch.select("label", "key", "seq", "risk_score", "name", F.col("seq").alias("created_seq"))
    if stored is not None:
        log = log.unionByName(stored.select("label", "key", F.col("updated_seq").alias("seq"), "risk_score", "name", "created_seq"))
    latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return log.groupBy("label", "key").agg(latest("risk_score"), latest("name"), F.min("created_seq").alias("created_seq"), F.max("seq").alias("updated_seq"))


def node_writes(emails: DataFrame, edges: DataFrame) -> DataFrame:
    """Property writes (label, key, seq, risk_score, name): emails with their subject, indicators with the risk of the emails naming them."""
    risk = emails.select(F.col("email_id").alias("src_key"), F.col("doc_id").alias("seq"), "risk_score")
    own = emails.select(F.lit("Email").alias("label"), F.col("email_id").alias("key"), F.col("doc_id").alias("seq"), "risk_score", F.col("subject").alias("name"))
    named = edges.filter("src_label = 'Email'").join(risk, "src_key").select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"), "seq", "risk_score", F.lit(None).cast("string").alias("name"))
    rest = edges.filter("src_label <> 'Email'")
    ends = rest.select(F.col("src_label").alias("label"), F.col("src_key").alias("key")).unionByName(rest.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))).distinct()
    bare = ends.select("label", "key", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("double").alias("risk_score"), F.lit(None).cast("string").alias("name"))
    return own.unionByName(named).unionByName(bare)


def payload_graph(payloads: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """J1/J2 of ingest payloads in the standard form (D13): node writes (label, key, risk_score, name, order) and edges.

    Values are normalised (D1-D5); what can't be is left out.  A name resolved to
    an address, and the network of an address, say nothing about risk.
    """
    risk, e = norm.score(F.col("detection.risk_score")), F.col("email")
    some = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    kinds = {f.name: f.dataType.simpleString() for f in payloads.schema["iocs"].dataType.fields}
    items = {k: some(f"iocs.{k}", kinds[k]) for k in ("domains", "ips", "urls", "hashes")}
    sender = F.coalesce(F.nullif(norm.domain(e["sender_domain"]), F.lit("")), norm.address_domain(e["sender"]))
    rows = payloads.select(
        order.alias("order"), risk.alias("risk_score"), e["email_id"].alias("email_id"), e["subject"].alias("subject"), sender.alias("sender_domain"),
        F.transform(items["domains"], lambda d: norm.domain(d["value"])).alias("domains"),
        F.transform(items["ips"], lambda i: F.struct(norm.ip(i["value"]).alias("ip"), i["asn"].alias("asn"))).alias("ips"),
        F.transform(items["urls"], lambda u: norm.url_record(u["value"])).alias("urls"), F.transform(items["hashes"], lambda h: norm.hash_value(h["value"])).alias("hashes"),
        F.transform(F.map_entries(F.coalesce(F.col("iocs.ip_domain_mapping"), F.create_map().cast("map<string,string>"))), lambda m: F.struct(norm.ip(m["key"]).alias("ip"), norm.domain(m["value"]).alias("domain"))).alias("resolved"),
    )
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    node = lambda label, key, risk=F.col("risk_score"), name=text: F.struct(F.lit(check_label(label)).alias("label"), key.alias("key"), risk.alias("risk_score"), name.alias("name"))
    each = lambda c, *nodes: F.flatten(F.transform(c, lambda x: F.array(*(n(x) for n in nodes))))
    found = F.concat(
        F.array(node("Email", F.col("email_id"), name=F.col("subject")), node("Domain", F.col("sender_domain"))), each("domains", lambda d: node("Domain", d)), each("urls", lambda u: node("URL", u["url_hash"], name=u["value"]), lambda u: node("Domain", u["domain"])),
        each("ips", lambda i: node("IP", i["ip"]), lambda i: node("ASN", i["asn"], none)), each("resolved", lambda r: node("Domain", r["domain"], none), lambda r: node("IP", r["ip"], none)), each("hashes", lambda h: node("Hash", h)),
    )
    nodes = rows.select("order", F.explode(found).alias("n")).select("n.*", "order").filter("coalesce(key, '') <> ''")
    own = lambda c, name: rows.select("email_id", F.explode(c).alias(name))
    url, ip, resolved = (rows.select("email_id", F.explode(c).alias("x")).select("email_id", "x.*") for c in ("urls", "ips", "resolved"))
    parts = [
        _edges(rows, "Email", F.col("email_id"), "SENT_FROM", "Domain", F.col("sender_domain")), _edges(own("domains", "d"), "Email", F.col("email_id"), "CONTAINS_DOMAIN", "Domain", F.col("d")),
        _edges(url, "Email", F.col("email_id"), "CONTAINS_URL", "URL", F.col("url_hash")), _edges(url, "URL", F.col("url_hash"), "HOSTED_ON_DOMAIN", "Domain", F.col("domain")),
        _edges(ip, "IP", F.col("ip"), "BELONGS_TO_ASN", "ASN", F.col("asn")), _edges(resolved, "Domain", F.col("domain"), "RESOLVES_TO", "IP", F.col("ip")), _edges(own("hashes", "h"), "Email", F.col("email_id"), "CONTAINS_HASH", "Hash", F.col("h")),
    ]
    return nodes, reduce(DataFrame.unionByName, parts).distinct()


def payload_tables(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What campaigns are computed from, out of payloads in the standard form (one for each email): emails, ``iocs(email_id, kind, value)`` and ``resolves(domain, ip)``.

    A URL's value is its hash, as in the graph.
    """
    e, none = F.col("email"), F.lit(None).cast("int")
    status = lambda k: norm.auth_status(F.col(f"authentication.{k}")).alias(k)
    sender = F.coalesce(F.nullif(norm.domain(e["sender_domain"]), F.lit("")), norm.address_domain(e["sender"]))
    emails = payloads.select(e["email_id"].alias("email_id"), e["subject"].alias("subject"), sender.alias("sender_domain"), norm.timestamp(e["timestamp"]).alias("ts"), *map(status, ("spf", "dkim", "dmarc")), F.col("detection.classification").alias("classification"), norm.score(F.col("detection.risk_score")).alias("risk_score"))
    _, edges = payload_graph(payloads, none)
    kind = F.when(F.col("rel") == "CONTAINS_DOMAIN", "domain").when(F.col("rel") == "CONTAINS_URL", "url").when(F.col("rel") == "CONTAINS_HASH", "hash")
    iocs = edges.select(F.col("src_key").alias("email_id"), kind.alias("kind"), F.col("dst_key").alias("value")).filter("kind IS NOT NULL")
    return emails, iocs, edges.filter("rel = 'RESOLVES_TO'").select(F.col("src_key").alias("domain"), F.col("dst_key").alias("ip"))


def upsert_edges(stored: DataFrame | None, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends exist."""
    all_ = batch if stored is None else stored.unionByName(batch)
    ends = nodes.select("label", "key")
    has = lambda df, side: df.join(ends.withColumnsRenamed({"label": f"{side}_label", "key": f"{side}_key"}), [f"{side}_label", f"{side}_key"], "left_semi")
    return has(has(all_, "src"), "dst").select("src_label", "src_key", "rel", "dst_label", "dst_key").distinct()


def ingest_counts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Of the batch's distinct nodes, per label those that are new and those that were stored."""
    seen = stored.select("label", "key").withColumn("stored", F.lit(True))
    marked = batch.select("label", "key").distinct().join(seen, ["label", "key"], "left")
    return marked.groupBy("label").agg(F.count_if(F.col("stored").isNull()).alias("created"), F.count("stored").alias("matched"))


def lookup(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """J7."""
    return nodes.filter((F.col("label") == check_label(label)) & (F.col("key") == key)).limit(1)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n) for every label and relationship, also those without any."""
    spark = nodes.sparkSession
    types = spark.createDataFrame([("node", x) for x in LABELS] + [("edge", x) for x in RELATIONSHIPS], "kind string, type string")
    found = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("type")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("rel").alias("type"))).groupBy("kind", "type").agg(F.count("*").alias("n"))
    return types.join(found, ["kind", "type"], "left").select("kind", "type", F.coalesce("n", F.lit(0)).alias("n"))


def export_id(label: Column, key: Column) -> Column:
    """``type:key``."""
    return F.concat(F.lower(label), F.lit(":"), key)


def export_page(nodes: DataFrame, edges: DataFrame, skip: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page of nodes in order of label and key, and the edges leaving them."""
    page = nodes.orderBy("label", "key").offset(skip).limit(limit)
    out = page.select(export_id(F.col("label"), F.col("key")).alias("id"), "label", F.when(F.col("label") == "ASN", F.concat(F.lit("AS"), "key")).otherwise(F.substring(F.coalesce("name", "key"), 1, 35)).alias("text"))
    named = edges.select(export_id(F.col("src_label"), F.col("src_key")).alias("source"), export_id(F.col("dst_label"), F.col("dst_key")).alias("target"), "rel")
    named = named.join(out.select(F.col("id").alias("source")), "source", "left_semi")
    return out, named.select(F.concat(F.lit("edge:"), "source", F.lit("->"), "target", F.lit(":"), "rel").alias("id"), "source", "target", "rel")


def repeated_keys(nodes: DataFrame) -> DataFrame:
    """Keys that break uniqueness; must be empty."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).filter("n > 1")
