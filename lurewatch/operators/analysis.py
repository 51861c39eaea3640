"""Raw messages to verdicts in one job (B, C, E, F, G12 into G1-G7, G15-G17).

``reports`` builds the report table that ``functions.signals`` reads: one decoding
pass over the messages, then column expressions for what a message says by itself and
joins with snapshot tables for what others know.  ``analyze`` adds signals, score,
verdict, timeline, briefing and graph.  A message that can't be read keeps its row,
with its error, empty lists and no signals of content.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import scoring
from ..functions import signals as sg
from ..functions.normalize import let
from . import authentication as auth
from . import enrichment, relay
from . import messages as m
from .tables import attach, written
from .training import ThreatModel, predict

#: What each snapshot table holds.
SCHEMAS = {
    "spf": "domain string, record string", "a": "host string, ip string", "mx": "domain string, host string", "dmarc": "domain string, record string", "keys": "domain string, selector string, key_bits int",
    "prefixes": "network string, asn string, org string, country string", "geo": "ip string, city string, region string, country string, isp string, latitude double, longitude double",
    "reputation": "ip string, abuse_score int, reports int, tor boolean", "hashes": "sha256 string, status string, engines int", "links": "provider string, url string, status string, malicious boolean, score int",
    "assessments": "email_id string, status string, label string, confidence double",
}


class Snapshots(NamedTuple):
    """Tables of DNS records, networks, places, reputations and supporting assessments; see ``SCHEMAS``."""

    spf: DataFrame
    a: DataFrame
    mx: DataFrame
    dmarc: DataFrame
    keys: DataFrame
    prefixes: DataFrame
    geo: DataFrame
    reputation: DataFrame
    hashes: DataFrame
    links: DataFrame
    assessments: DataFrame


def snapshots(spark: SparkSession, **known: DataFrame) -> Snapshots:
    """The snapshots at hand; the others are empty."""
    return Snapshots(**{k: known.get(k, spark.createDataFrame([], schema)) for k, schema in SCHEMAS.items()})


def _first_wins(*sources: tuple[str, Column]) -> Column:
    """Array of struct(value, source) with each value once, under the first source that has it."""
    each = F.concat(*(F.transform(F.array_distinct(values), lambda v, name=name: F.struct(v.alias("value"), F.lit(name).alias("source"))) for name, values in sources))

    def of(each: Column) -> Column:
        values = F.array_distinct(F.filter(F.transform(each, lambda e: e["value"]), lambda v: F.coalesce(v, F.lit("")) != ""))
        return F.transform(values, lambda v: F.struct(v.alias("value"), F.get(F.filter(each, lambda e: e["value"] == v), 0)["source"].alias("source")))

    return let(each, of)  # texts are searched once, not once for each value


def _content(messages: DataFrame) -> DataFrame:
    """What the bodies hold: email_id, urls, domains, ips, attachments, bodies."""
    html, text = F.coalesce("text_html", F.lit("")), F.coalesce("text_plain", F.lit(""))
    urls = ind.without_prefixes(F.array_distinct(F.concat(F.transform(ind.urls_in_text(text), ind.refang), ind.urls_in_html(html))))
    head = m.header_table(messages).select("email_id", F.array_compact(F.array(*(m.domain(F.col(c)) for c in ("from_address", "reply_to", "return_path")))).alias("own"))
    rows = messages.join(head, "email_id").select("*", urls.alias("found"))
    names = _first_wins(("header", F.col("own")), ("url", F.transform("found", lambda u: ind.host(u))), ("body", F.concat(ind.domains_in_text(text), ind.domains_in_text(html))))
    domain = lambda d: F.struct(d["value"].alias("domain"), d["source"].alias("source"), ind.has_homoglyph(d["value"]).alias("homoglyph"), ind.is_typosquat(d["value"], ind.split_suffix(d["value"])["registered"]).alias("typosquat"))
    raw = F.array_join(F.transform("headers", lambda h: F.when(F.lower(h["name"]) != "received", h["raw"]).otherwise("")), "\n")
    ips = _first_wins(("header", ind.ips_in_text(raw)), ("body", F.array_union(ind.ips_in_text(text), ind.ips_in_text(html))))
    return rows.select(
        "email_id", F.transform("found", lambda u: ind.url_record(u, F.lit("body"))).alias("urls"), F.transform(names, domain).alias("domains"), F.transform(ips, lambda i: i["value"]).alias("ips"),
        F.transform("attachments", lambda a: F.struct(a["filename"].alias("filename"), a["content_type"].alias("content_type"), a["size"].alias("size"), a["sha256"].alias("sha256"), *(c.alias(k) for k, c in m.attachment_kinds(a["filename"]).items()))).alias("attachments"),
    )


def _hops(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relay hops of each message as one array, and origin and sender address."""
    path = written(m.relay_path(messages), "relay-path")
    hop = F.struct("hop", "from_host", "from_ip", "by_host", "protocol", "delay_s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "flags")
    return path.groupBy("email_id").agg(F.array_sort(F.collect_list(hop)).alias("hops")), relay.origins(path)


def _checks(rows: DataFrame, known: Snapshots) -> DataFrame:
    """E1-E10 for ``rows(email_id, from_domain, sender_ip, signature, seals, recorded_*)``: verdicts, and what they rest on."""
    asked = rows.filter("from_domain IS NOT NULL AND sender_ip IS NOT NULL").select(F.struct(F.col("from_domain").alias("domain"), F.col("sender_ip").alias("ip")).alias("asked"), "email_id")
    sizes = asked.groupBy("asked").agg(F.count("*").alias("size"))
    results = auth.spf_results(asked.select("asked.domain", "asked.ip"), known.spf, known.a, known.mx)
    results = results.select(F.struct("domain", "ip").alias("asked"), F.col("result").alias("live_spf")).join(sizes, "asked")
    spf = attach(asked, results, "asked", "size", F.col("email_id")).select("email_id", "live_spf")
    rows = rows.join(spf, "email_id", "left").withColumn("t", auth.dkim_tags(F.col("signature")))
    rows = rows.withColumns({"dkim_domain": F.col("t.domain"), "dkim_selector": F.col("t.selector"), "arc": auth.arc_result(F.col("seals"))["result"]})
    rows = written(auth.with_keys(rows, known.keys), "auth-rows")
    # signatures aren't verified here, so DKIM alignment has the recorded verdict
    dkim = auth.preferred("dkim", F.lit("none"), F.col("recorded_dkim"))
    live = rows.select("email_id", "from_domain", F.coalesce("live_spf", F.lit("none")).alias("spf"), F.col("from_domain").alias("spf_domain"), dkim["result"].alias("dkim"), "dkim_domain")
    policy = auth.dmarc_results(live.filter("from_domain IS NOT NULL"), known.dmarc).select("email_id", F.col("policy").alias("dmarc_policy"), F.col("dmarc").alias("live_dmarc"))
    rows = rows.join(policy, "email_id", "left")
    verdicts = {"spf": auth.preferred("spf", F.col("live_spf"), F.col("recorded_spf")), "dkim": dkim, "dmarc": auth.preferred("dmarc", F.col("live_dmarc"), F.col("recorded_dmarc"))}
    return rows.select("email_id", *(v["result"].alias(k) for k, v in verdicts.items()), *(v["source"].alias(f"{k}_source") for k, v in verdicts.items()), "arc", F.col("from_domain").alias("spf_domain"), "dkim_selector", "dkim_key_bits", "dmarc_policy", F.col("from_domain").alias("dmarc_domain"))


def reports(raw: DataFrame, known: Snapshots, analyzed_at: str, model: ThreatModel | None = None) -> DataFrame:
    """One report for each row of ``raw(email_id, content BINARY)``; without a model the heuristic classifies."""
    decoded = m.decoded(raw)
    short = F.transform("attachments", lambda a: F.struct(a["filename"].alias("filename"), a["content_type"].alias("content_type"), F.octet_length(a["content"]).cast("long").alias("size"), F.sha2(a["content"], 256).alias("sha256")))
    mails = written(decoded.withColumn("attachments", short), "decoded")  # contents of attachments end here
    heads = m.header_table(mails)
    hops, origins = _hops(mails)
    origins = written(origins, "origins")
    h = F.col("headers")
    marks = mails.select("email_id", m.first(h, "dkim-signature").alias("signature"), m.named(h, "arc-seal", "raw").alias("seals"))
    asked = heads.select("email_id", m.domain(F.col("from_address")).alias("from_domain"), *(f"recorded_{k}" for k in ("spf", "dkim", "dmarc"))).join(marks, "email_id").join(origins.select("email_id", "sender_ip"), "email_id", "left")
    checks = written(_checks(asked, known), "auth-verdicts")
    content = written(_content(mails), "content")
    place = enrichment.origin_details(origins.select("email_id", "origin_ip"), known.prefixes, known.geo, known.reputation)
    place = place.select("email_id", F.struct(F.col("origin_ip").alias("ip"), "asn", "org", "isp", "country", "city", "cloud", "vpn", "tor").alias("origin"), F.struct(F.col("abuse_status").alias("status"), F.col("abuse_score").alias("score")).alias("abuse"))
    files = enrichment.hash_verdicts(content.select("email_id", F.explode("attachments").alias("x")).select("email_id", "x.filename", "x.sha256"), known.hashes)
    files = files.groupBy("email_id").agg(F.count_if("malicious").cast("int").alias("file_hits"), F.count_if(F.col("status") == "available").cast("int").alias("file_seen"))
    links = content.select("email_id", F.posexplode("urls").alias("n", "u")).select("email_id", "n", F.col("u.url").alias("url"))
    links = written(enrichment.url_verdicts(links, known.links), "link-verdicts")
    scanner, sandbox = enrichment.PROVIDERS
    hits = links.groupBy("email_id").agg(
        F.count_if(F.col("malicious") & (F.col("provider") == scanner)).cast("int").alias("link_hits"), F.count_if(F.col("status") == "available").cast("int").alias("link_seen"),
        F.count_if(F.col("malicious") & (F.col("provider") == sandbox)).cast("int").alias("sandbox_hits"), F.collect_set(F.when(F.col("malicious"), F.col("url"))).alias("bad_urls"),
    )
    bodies = mails.select("email_id", F.coalesce(F.nullif("text_plain", F.lit("")), "text_html", F.lit("")).alias("body"), "error")
    rows = heads.join(checks, "email_id").join(content, "email_id").join(bodies, "email_id").join(mails.select("email_id", "sha256", "size"), "email_id")
    for part in (hops, place, files, hits):
        rows = rows.join(part, "email_id", "left")
    supporting = known.assessments.groupBy("email_id").agg(F.max_by(F.struct("status", "label", "confidence"), F.struct("status", "confidence")).alias("assessment"))
    rows = rows.join(supporting, "email_id", "left")
    bad = F.coalesce("bad_urls", F.array().cast("array<string>"))
    none = F.array().cast(hops.schema["hops"].dataType)
    rows = rows.withColumns({
        "hops": F.coalesce("hops", none), "urls": F.transform("urls", lambda u: u.withField("suspicious", u["suspicious"] | F.array_contains(bad, u["url"]))),
        "ips": F.array_distinct(F.concat(F.filter(F.transform(F.coalesce("hops", none), lambda x: x["from_ip"]), lambda i: i.isNotNull()), F.col("ips"))),
        **{c: F.coalesce(c, F.lit(0)) for c in ("link_hits", "link_seen", "file_hits", "file_seen", "sandbox_hits")}, "analyzed_at": F.lit(analyzed_at),
    }).drop("bad_urls")
    rows = written(rows, "report-rows")
    ml = rows.select(
        "email_id", "subject", "body", F.col("from_address").alias("sender"), "reply_to", "return_path", "spf", "dkim", "dmarc", "arc", F.transform("urls", lambda u: u["url"]).alias("urls"), F.size("hops").alias("received_hop_count"), F.size("ips").alias("ip_count"),
        F.size("attachments").alias("attachment_count"), F.size(F.filter("attachments", lambda a: a["executable"])).alias("executable_attachments"),
    )
    judged = predict(ml, "email_id", model=model).select("email_id", F.struct("label", "confidence").alias("model"))
    return rows.join(judged, "email_id").drop("body")


def analyze(raw: DataFrame, known: Snapshots, analyzed_at: str, model: ThreatModel | None = None) -> DataFrame:
    """The reports with signals (G1, G2), factors, risk_score, risk_level, telemetry, verdict, actions (G3-G6), timeline (G7), the answer's fields (G16), briefing (G14, G15) and graph."""
    rows = reports(raw, known, analyzed_at, model).withColumn("signals", sg.risk_signals()).withColumn("factors", sg.score_factors(assessment="assessment"))
    rows = rows.withColumns({k: v for k, v in sg.explained(F.col("factors"), assessment="assessment").items()})
    label = F.col("model.label")
    nodes, edges = sg.graph(F.col("signals"))
    executable = F.size(F.filter("attachments", lambda a: a["executable"]))
    briefing = F.struct(
        sg.attack_vector(label, F.size("urls")).alias("vector"), sg.soc_actions(F.col("risk_level"), label).alias("actions"), sg.technique_details(scoring.techniques(label, executable)).alias("techniques"),
        sg.incident_summary(label, F.col("risk_score"), F.col("risk_level"), F.transform("factors", lambda f: f["factor"])).alias("summary"),
    )
    answer = F.struct(*(c.alias(k) for k, c in sg.response().items()))
    return rows.withColumns({"timeline": sg.timeline(), "answer": answer, "briefing": briefing, "graph": F.struct(nodes.alias("nodes"), edges.alias("links"))})
