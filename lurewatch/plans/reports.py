"""Queries of sender authentication (E), enrichment (F) and reports (G1-G7, G12, G14-G17), with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals as sg
from ..functions.scoring import techniques
from ..operators import analysis as an
from ..operators import authentication as au
from ..operators import enrichment as en
from ..operators.tables import written
from .fixtures import table
from .mail_fixtures import MAIL_SQL, messages

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- authentication: DNS snapshots by domain number, over the mails' domains and addresses

#: Over a domain's number k: its records; ``{s}`` is the dialect's text type.
_RECORDS = {
    "spf": "case k % 6 when 0 then concat('v=spf1 ip4:45.33.', cast(k % 200 as {s}), '.0/25 ~all') when 1 then concat('v=spf1 include:d', cast(k - 1 as {s}), '.example.net -all') when 2 then 'v=spf1 a mx ?all' "
    "when 3 then concat('v=spf1 redirect=d', cast(k - 1 as {s}), '.example.net') when 4 then concat('v=spf1 ip6:2001:db8::/32 -ip4:45.33.0.0/16 +all') end",
    "dmarc": "case k % 4 when 0 then 'v=DMARC1; p=reject; pct=50; rua=mailto:a@x.org,mailto:b@x.org' when 1 then 'v=DMARC1;p=none;aspf=s' when 2 then 'v=DMARC1; p=quarantine; sp=none; adkim=s' end",
}


def _domains(spark, sf_dir) -> DataFrame:
    d = messages(spark, sf_dir).select(F.regexp_extract("domain", "d([0-9]+)", 1).try_cast("long").alias("k"), "domain").distinct()
    return d.select("k", "domain", *(F.expr(e.format(s="string")).alias(c) for c, e in _RECORDS.items()))


_DOMAINS_SQL = f"dom AS (SELECT k, domain, {', '.join(f'{e.format(s="varchar")} AS {c}' for c, e in _RECORDS.items())} FROM (SELECT DISTINCT regexp_extract(domain, 'd([0-9]+)', 1)::BIGINT AS k, domain FROM mail))"
#: The last byte and the second last of 45.33.x.y; a host's address is 45.33.k % 250.k % 100.
_SPF_SQL = f"""{MAIL_SQL}, {_DOMAINS_SQL},
c AS (SELECT DISTINCT m.domain, m.hop_ip AS ip, d.k, split_part(m.hop_ip, '.', 3)::INT AS x, split_part(m.hop_ip, '.', 4)::INT AS y FROM mail m JOIN dom d USING (domain)),
own AS (SELECT c.*, p.domain AS parent, (x = c.k % 200 AND y < 128) AS zero, (x = (c.k - 1) % 200 AND y < 128 AND p.domain IS NOT NULL) AS below, (x = c.k % 250 AND y = c.k % 100) AS host, (p.domain IS NOT NULL AND x = (c.k - 1) % 250 AND y = (c.k - 1) % 100) AS below_host
  FROM c LEFT JOIN dom p ON p.k = c.k - 1)
SELECT domain, ip, CASE k % 6 WHEN 0 THEN CASE WHEN zero THEN 'pass' ELSE 'softfail' END WHEN 1 THEN CASE WHEN below THEN 'pass' ELSE 'fail' END WHEN 2 THEN CASE WHEN host THEN 'pass' ELSE 'neutral' END
  WHEN 3 THEN CASE WHEN parent IS NULL THEN 'permerror' WHEN below_host THEN 'pass' ELSE 'neutral' END WHEN 4 THEN 'fail' ELSE 'none' END AS result FROM own"""


@_query(_SPF_SQL)
def e1_e4_spf(spark, sf_dir):
    doms = _domains(spark, sf_dir)
    ip = F.concat(F.lit("45.33."), (F.col("k") % 250).cast("string"), F.lit("."), (F.col("k") % 100).cast("string"))
    a = doms.filter("k % 12 IN (2, 3)").select(F.col("domain").alias("host"), ip.alias("ip")).unionByName(doms.filter("k % 12 IN (8, 9)").select(F.concat(F.lit("mx."), "domain").alias("host"), ip.alias("ip")))
    mx = doms.filter("k % 12 IN (8, 9)").select("domain", F.concat(F.lit("mx."), "domain", F.lit(".")).alias("host"))
    return au.spf_results(messages(spark, sf_dir).select("domain", F.col("hop_ip").alias("ip")), doms.select("domain", F.col("spf").alias("record")), a, mx)


_NUM = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"


@_query("SELECT event_id, ip, net, (event_id % 256 // (1 << (8 - bits))) = (user_id % 256 // (1 << (8 - bits))) AS inside, true AS six FROM (SELECT event_id, user_id, event_id % 9 AS bits, concat('10.', event_id % 256, '.1.2') AS ip, concat('10.', user_id % 256, '.0.0/', 8 + event_id % 9) AS net FROM events)")
def e4_networks(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("10."), (F.col("event_id") % 256).cast("string"), F.lit(".1.2")).alias("ip"), F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit(".0.0/"), (8 + F.col("event_id") % 9).cast("string")).alias("net"))
    six = F.concat(F.lit("2001:db8::"), F.concat_ws(":", *(F.hex(F.shiftrightunsigned("event_id", k).bitwiseAND(0xFFFF)) for k in (48, 32, 16, 0))))
    return t.select("event_id", "ip", "net", au.in_network(F.col("ip"), F.col("net")).alias("inside"), (au.in_network(six, F.lit("2001:db8::/64")) & ~au.in_network(six, F.lit("2001:db9::/32"))).alias("six"))


_DMARC_SQL = f"""{MAIL_SQL}, {_DOMAINS_SQL},
j AS (SELECT m.*, d.k, CASE WHEN d.k % 3 = 0 THEN concat('mail.', m.domain) ELSE m.domain END AS from_domain, CASE WHEN d.k % 3 = 0 AND d.k % 2 = 0 THEN 0 ELSE d.k % 4 END AS r FROM mail m JOIN dom d USING (domain)),
s AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'own' ELSE 'org' END ELSE 'own' END AS src FROM j),
t AS (SELECT *, CASE WHEN src = 'org' THEN 1 WHEN k % 3 = 0 THEN k % 4 ELSE k % 4 END AS rec FROM s),
u AS (SELECT *, CASE rec WHEN 0 THEN 'reject' WHEN 1 THEN 'none' WHEN 2 THEN 'quarantine' END AS policy, CASE rec WHEN 2 THEN 'none' END AS subdomain_policy, CASE rec WHEN 0 THEN 50 WHEN 3 THEN NULL ELSE 100 END AS pct FROM t)
SELECT email_id, from_domain, policy, subdomain_policy, pct, CASE WHEN rec = 0 THEN 2 ELSE 0 END AS n_rua, CASE WHEN rec = 3 THEN 'none' WHEN (spf = 'pass' AND (rec <> 1 OR from_domain = domain)) OR (dkim = 'pass' AND (rec <> 2 OR from_domain = domain)) THEN 'pass' ELSE 'fail' END AS dmarc FROM u"""


@_query(_DMARC_SQL)
def e5_e7_dmarc(spark, sf_dir):
    doms = _domains(spark, sf_dir)
    sub = F.concat(F.lit("mail."), "domain")
    # domains whose number is divisible by 3 send from a subdomain: it has its parent's record if the number is even, else the organisation's
    own = doms.select(F.when(F.col("k") % 3 == 0, sub).otherwise(F.col("domain")).alias("domain"), F.col("dmarc").alias("record")).filter("NOT (domain LIKE 'mail.%' AND cast(regexp_extract(domain, 'd([0-9]+)', 1) AS BIGINT) % 2 = 1)")
    records = own.unionByName(spark.range(1).select(F.lit("example.net").alias("domain"), F.lit("v=DMARC1;p=none;aspf=s").alias("record"))).filter("record IS NOT NULL")
    # a record of the organisation would also serve domains without one of their own; those with k % 4 = 3 have an unreadable one
    none = doms.filter("k % 4 = 3 AND NOT (k % 3 = 0 AND k % 2 = 1)").select(F.when(F.col("k") % 3 == 0, sub).otherwise(F.col("domain")).alias("from_domain"))
    mails = messages(spark, sf_dir).join(doms.select("domain", "k"), "domain")
    mails = mails.select("email_id", F.when(F.col("k") % 3 == 0, sub).otherwise(F.col("domain")).alias("from_domain"), "spf", F.col("domain").alias("spf_domain"), "dkim", F.col("domain").alias("dkim_domain"))
    found = au.dmarc_results(mails, records).join(none.withColumn("blank", F.lit(True)), "from_domain", "left")
    blank = F.coalesce("blank", F.lit(False))
    keep = lambda c, other=None: F.when(blank, other).otherwise(F.col(c)).alias(c)
    return found.select("email_id", "from_domain", keep("policy"), keep("subdomain_policy"), keep("pct"), F.when(blank, 0).otherwise(F.size("rua")).alias("n_rua"), keep("dmarc", "none"))


@_query(f"{MAIL_SQL} SELECT email_id, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'pass' WHEN 2 THEN 'pass' ELSE 'fail' END AS result, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 2 END AS chain_length, CASE doc_id % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'pass' WHEN 3 THEN 'fail' WHEN 4 THEN 'invalid' END AS cv FROM mail")
def e8_arc(spark, sf_dir):
    seal = lambda i, cv: F.lit(f"i={i}; a=rsa-sha256; t=1; cv={cv}; d=x.org; b=abc==")
    k = F.col("doc_id") % 5
    seals = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(seal(1, "none"))).when(k == 2, F.array(seal(2, "pass"), seal(1, "none"))).when(k == 3, F.array(seal(2, "fail"), seal(1, "none"))).otherwise(F.array(seal(3, "pass"), seal(1, "none")))
    return messages(spark, sf_dir).select("email_id", au.arc_result(seals).alias("a")).select("email_id", "a.*")


@_query(f"{MAIL_SQL} SELECT email_id, doc_id % 3 <> 0 AS present, CASE WHEN doc_id % 3 <> 0 THEN domain END AS domain, CASE WHEN doc_id % 3 <> 0 THEN concat('s', doc_id % 2) END AS selector, CASE WHEN doc_id % 3 <> 0 THEN 512 + 1536 * (doc_id % 2) END AS key_bits, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS weak_key FROM mail")
def e9_dkim_tags(spark, sf_dir):
    signature = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("v=1; a=rsa-sha256; d="), "domain", F.lit("; s=s"), (F.col("doc_id") % 2).cast("string"), F.lit("; b=a=b=")))
    mails = messages(spark, sf_dir)
    keys = mails.select("domain", F.explode(F.array(*(F.struct(F.lit(f"s{i}").alias("selector"), F.lit(512 + 1536 * i).alias("key_bits")) for i in (0, 1)))).alias("x")).select("domain", "x.*").distinct()
    tagged = mails.select("email_id", au.dkim_tags(signature).alias("t")).select("email_id", "t.present", F.col("t.domain").alias("dkim_domain"), F.col("t.selector").alias("dkim_selector"))
    return au.with_keys(tagged, keys).select("email_id", "present", F.col("dkim_domain").alias("domain"), F.col("dkim_selector").alias("selector"), F.col("dkim_key_bits").alias("key_bits"), "weak_key")


@_query(f"{MAIL_SQL} SELECT email_id, CASE WHEN doc_id % 2 = 0 THEN 'fail' WHEN kind = 0 THEN 'none' ELSE spf END AS result, CASE WHEN doc_id % 2 = 0 OR kind = 0 THEN 'evaluated' ELSE 'recorded' END AS source, spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass' AS all_pass FROM mail")
def e10_e11_precedence(spark, sf_dir):
    live = F.when(F.col("doc_id") % 2 == 0, "fail").otherwise("none")
    recorded = F.when(F.col("kind") == 0, "bestguesspass").otherwise(F.upper("spf"))
    return messages(spark, sf_dir).select("email_id", au.preferred("spf", live, recorded).alias("p"), au.all_pass(*map(F.col, ("spf", "dkim", "dmarc"))).alias("all_pass")).select("email_id", "p.*", "all_pass")


# ---- enrichment

#: Prefixes over a number k: 45.33.k.0/24, with one /16 and one /6 around them.
_NETS_SQL = """nets AS (SELECT concat('45.33.', k, '.0/24') AS network, concat('AS', k) AS asn, CASE k % 4 WHEN 0 THEN 'Amazon AWS' WHEN 1 THEN 'NordVPN Ltd' ELSE concat('Net ', k) END AS org, 'US' AS country FROM (SELECT DISTINCT doc_id % 250 AS k FROM mail) WHERE k % 3 <> 0
  UNION ALL SELECT '45.33.0.0/16', 'AS9000', 'Wide Net', 'DE' UNION ALL SELECT '44.0.0.0/6', 'AS1', 'Wider', 'FR')"""


def _nets(spark, sf_dir) -> DataFrame:
    k = messages(spark, sf_dir).select((F.col("doc_id") % 250).alias("k")).distinct().filter("k % 3 <> 0")
    own = k.select(F.concat(F.lit("45.33."), F.col("k").cast("string"), F.lit(".0/24")).alias("network"), F.concat(F.lit("AS"), F.col("k").cast("string")).alias("asn"), F.when(F.col("k") % 4 == 0, "Amazon AWS").when(F.col("k") % 4 == 1, "NordVPN Ltd").otherwise(F.concat(F.lit("Net "), F.col("k").cast("string"))).alias("org"), F.lit("US").alias("country"))
    return own.unionByName(spark.createDataFrame([("45.33.0.0/16", "AS9000", "Wide Net", "DE"), ("44.0.0.0/6", "AS1", "Wider", "FR")], "network string, asn string, org string, country string"))


_ORIGIN_SQL = f"""{MAIL_SQL}, {_NETS_SQL},
org AS (SELECT email_id, doc_id, CASE doc_id % 4 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN NULL ELSE hop_ip END AS origin_ip FROM mail),
o AS (SELECT email_id, origin_ip, CASE WHEN doc_id % 4 > 1 THEN origin_ip END AS ip, split_part(origin_ip, '.', 3)::INT AS k, split_part(origin_ip, '.', 4)::INT AS y FROM org)
SELECT email_id, origin_ip, CASE WHEN ip IS NULL THEN NULL WHEN k % 3 <> 0 THEN concat('AS', k) ELSE 'AS9000' END AS asn,
  CASE WHEN ip IS NULL THEN NULL WHEN k % 2 = 0 THEN 'GB' WHEN k % 3 <> 0 THEN 'US' ELSE 'DE' END AS country, ip IS NOT NULL AND k % 3 <> 0 AND k % 4 = 0 AS cloud, ip IS NOT NULL AND k % 3 <> 0 AND k % 4 = 1 AS vpn,
  CASE WHEN ip IS NULL THEN 'skipped' WHEN k % 2 = 0 THEN 'available' ELSE 'not_found' END AS geo_status, CASE WHEN ip IS NULL THEN 'skipped' WHEN y % 2 = 0 THEN 'available' ELSE 'not_found' END AS abuse_status,
  CASE WHEN ip IS NOT NULL AND y % 2 = 0 THEN y % 101 END AS abuse_score, ip IS NOT NULL AND y % 2 = 0 AND y % 101 >= 25 AS abuse_malicious FROM o"""


def _origins(spark, sf_dir) -> DataFrame:
    mails = messages(spark, sf_dir)
    k, y = (F.split_part("ip", F.lit("."), F.lit(i)).cast("int") for i in (3, 4))
    ips = mails.select(F.col("hop_ip").alias("ip")).distinct()
    geo = ips.filter(k % 2 == 0).select("ip", F.lit("Leeds").alias("city"), F.lit("North").alias("region"), F.lit("GB").alias("country"), F.lit(None).cast("string").alias("isp"), F.lit(53.8).alias("latitude"), F.lit(-1.5).alias("longitude"))
    abuse = ips.filter(y % 2 == 0).select("ip", (y % 101).alias("abuse_score"), F.lit(3).alias("reports"), (y % 50 == 0).alias("tor"))
    origins = mails.select("email_id", F.when(F.col("doc_id") % 4 == 0, "10.0.0.1").when(F.col("doc_id") % 4 > 1, F.col("hop_ip")).alias("origin_ip"))
    return en.origin_details(origins, _nets(spark, sf_dir), geo, abuse)


@_query(_ORIGIN_SQL)
def f3_f5_origins(spark, sf_dir):
    return _origins(spark, sf_dir).select("email_id", "origin_ip", "asn", "country", "cloud", "vpn", "geo_status", "abuse_status", "abuse_score", "abuse_malicious")


#: Addresses of both families from a digest of the event's content, and the networks of every second leading group that occurs.
_BOTH_IPS = "SELECT event_id, substr(d, 1, 1) AS a, substr(d, 2, 2) AS b, CASE WHEN substr(d, 4, 1) < '8' THEN concat('2A0', substr(d, 1, 1), ':', substr(d, 2, 2), '::', substr(d, 4, 4)) ELSE concat('77.', length(d), '.', event_id % 256, '.', event_id % 100) END AS ip FROM {digests}"
_DIGESTS = "(SELECT event_id, md5(concat(event_type, props, user_id)) AS d FROM events)"


@_query(f"""WITH i AS ({_BOTH_IPS.format(digests=_DIGESTS)}), six AS (SELECT ip, contains(ip, ':') AS six, a, b, ('0x' || b)::INT % 2 = 0 AS even FROM i)
SELECT DISTINCT ip, CASE WHEN NOT six THEN 'AS77' WHEN even THEN concat('AS-', a, b) WHEN a < '8' THEN concat('AS-', a) ELSE 'AS-2A' END AS asn,
  CASE WHEN NOT six THEN 'Four' WHEN even THEN 'Near' WHEN a < '8' THEN 'Mid' ELSE 'Wide' END AS org FROM six""")
def f3_both_families(spark, sf_dir):
    digests = table(spark, sf_dir, "events").select("event_id", F.md5(F.concat("event_type", "props", F.col("user_id").cast("string"))).alias("d"))
    ips = spark.sql(_BOTH_IPS.format(digests="{digests}"), digests=digests)
    row = lambda df, net, asn, org: df.select(net.alias("network"), asn.alias("asn"), F.lit(org).alias("org"), F.lit(None).cast("string").alias("country")).distinct()
    near = row(ips.filter("conv(b, 16, 10) % 2 = 0"), F.concat(F.lit("2a0"), "a", F.lit(":"), "b", F.lit("::/32")), F.concat(F.lit("AS-"), "a", "b"), "Near")
    mid = row(ips.filter("a < '8'"), F.concat(F.lit("2a0"), "a", F.lit("::/16")), F.concat(F.lit("AS-"), "a"), "Mid")
    wide = spark.createDataFrame([("2a00::/12", "AS-2A", "Wide", None), ("77.0.0.0/8", "AS77", "Four", None), ("::ffff/128", "AS0", "None", None)], "network string, asn string, org string, country string")
    return en.networks(ips, near.unionByName(mid).unionByName(wide)).select("ip", "asn", "org")


_FILES_SQL = "f AS (SELECT email_id, filename, sha, CASE WHEN doc_id % 9 IN (1, 4) THEN CASE doc_id % 2 WHEN 0 THEN 'available' ELSE 'error' END ELSE 'not_found' END AS status, CASE WHEN doc_id % 9 IN (1, 4) THEN doc_id % 4 ELSE 0 END AS engines FROM mail WHERE kind = 1)"


def _file_verdicts(spark, sf_dir) -> DataFrame:
    mails = messages(spark, sf_dir).filter("kind = 1")
    # the digest of this fixture names the mail, so that equal texts have verdicts of their own
    digest = F.sha2(F.concat("sha", "email_id"), 256)
    known = mails.filter("doc_id % 9 IN (1, 4)").select(digest.alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "available").otherwise("error").alias("status"), (F.col("doc_id") % 4).cast("int").alias("engines"))
    return en.hash_verdicts(mails.select("email_id", "filename", digest.alias("sha256")), known)


@_query(f"{MAIL_SQL}, {_FILES_SQL} SELECT email_id, filename, status, engines, status = 'available' AND engines > 0 AS malicious FROM f")
def f6_f9_files(spark, sf_dir):
    return _file_verdicts(spark, sf_dir).select("email_id", "filename", "status", "engines", "malicious")


_LINKS_SQL = """l AS (SELECT email_id, n, concat('http://h', doc_id % 40 + n, '.example.org/') AS url, (doc_id % 40 + n) AS h FROM mail, range(1, 8) AS r(n) WHERE n <= doc_id % 8),
v AS (SELECT l.*, provider, CASE WHEN h % 3 = 0 THEN 'available' WHEN h % 3 = 1 THEN 'Timeout' ELSE 'not_found' END AS status, h % 3 < 2 AND (h + length(provider)) % 2 = 0 AS bad FROM l, (VALUES ('scanner'), ('sandbox')) AS p(provider) WHERE n <= 5)"""


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    each = messages(spark, sf_dir).filter("doc_id % 8 > 0").select("email_id", "doc_id", F.explode(F.expr("sequence(1, cast(doc_id % 8 as int))")).alias("n"))
    h = F.col("doc_id") % 40 + F.col("n")
    urls = each.select("email_id", "n", F.concat(F.lit("http://h"), h.cast("string"), F.lit(".example.org/")).alias("url"), h.alias("h"))
    known = urls.select("url", "h").distinct().filter("h % 3 < 2").withColumn("provider", F.explode(F.array(F.lit("scanner"), F.lit("sandbox"))))
    known = known.select("provider", "url", F.when(F.col("h") % 3 == 0, "available").otherwise("Timeout").alias("status"), ((F.col("h") + F.length("provider")) % 2 == 0).alias("malicious"), F.lit(50).alias("score"))
    return urls.select("email_id", "n", "url", F.lit(False).alias("suspicious")), known


@_query(f"{MAIL_SQL}, {_LINKS_SQL} SELECT email_id, n, url, provider, status, status = 'available' AND bad AS malicious FROM v")
def f7_links(spark, sf_dir):
    return en.url_verdicts(*_links(spark, sf_dir)).select("email_id", "n", "url", "provider", "status", "malicious")


@_query(f"""WITH o AS ({_ORIGIN_SQL}), {_FILES_SQL.replace("FROM mail", "FROM (" + MAIL_SQL + " SELECT * FROM mail)")}, {_LINKS_SQL.replace("FROM mail,", "FROM (" + MAIL_SQL + " SELECT * FROM mail),")}
SELECT email_id, 'TI_ABUSE_SCORE' AS signal_id, CASE WHEN abuse_score >= 75 THEN 'critical' ELSE 'high' END AS level, 'origin' AS category, concat('sending address reported with a score of ', abuse_score) AS text FROM o WHERE abuse_malicious
UNION ALL SELECT email_id, 'TI_MALICIOUS_FILE', 'critical', 'ioc', concat('attachment found malicious by ', engines, ' engines') FROM f WHERE status = 'available' AND engines > 0
UNION ALL SELECT email_id, 'TI_MALICIOUS_URL', 'high', 'ioc', concat('link found malicious by ', provider) FROM v WHERE status = 'available' AND bad""")
def f8_found_signals(spark, sf_dir):
    return en.found_signals(_origins(spark, sf_dir), _file_verdicts(spark, sf_dir), en.url_verdicts(*_links(spark, sf_dir)))


@_query(f"{MAIL_SQL}, {_LINKS_SQL} SELECT email_id, n, url, coalesce(bool_or(v.status = 'available' AND v.bad), false) AS suspicious FROM l LEFT JOIN v USING (email_id, n, url) GROUP BY email_id, n, url")
def f8_marked_urls(spark, sf_dir):
    urls, known = _links(spark, sf_dir)
    return en.marked_urls(urls, en.url_verdicts(urls, known)).select("email_id", "n", "url", "suspicious")


# ---- reports

_URLS = [(i, f"concat('http://u', cast(doc_id % 30 + {i} as {{s}}), '.d{i}.example.org/x')", f"(doc_id + {i}) % 3 = 0") for i in range(10)]


def reports(spark, sf_dir) -> DataFrame:
    """The report table of ``functions.signals``."""
    m = messages(spark, sf_dir)
    d = F.col("doc_id")
    flags = lambda *pairs: F.array_compact(F.array(*(F.when(c, n) for c, n in pairs)))
    hop = lambda n, host, ip, by, protocol, delay, ts, fl: F.struct(F.lit(n).alias("hop"), host.alias("from_host"), ip.alias("from_ip"), by.alias("by_host"), protocol.alias("protocol"), delay.alias("delay_s"), ts.alias("ts"), fl.alias("flags"))
    none = F.lit(None)
    hops = F.array(
        hop(1, F.lit("edge"), F.lit("10.1.2.3"), none.cast("string"), F.when(d % 9 == 0, "HTTP").otherwise("ESMTP"), none.cast("double"), F.col("iso1"), flags((F.lit(True), "private_ip"), (d % 9 == 0, "protocol_mismatch"))),
        hop(2, F.lit("relay2"), F.col("hop_ip"), F.lit("mx.corp.example"), F.lit("ESMTPS"), F.col("late").cast("double"), F.col("iso3"), flags((F.col("late") > 300, "time_skew"))),
    )
    url = lambda i, e, c: F.struct(F.expr(e.format(s="string")).alias("url"), F.when(d % 4 != 1, F.concat(F.lit(f"d{i}"), F.lit(".Example.org"))).alias("domain"), F.replace(F.expr(e.format(s="string")), F.lit("http"), F.lit("hxxp")).alias("defanged"), F.lit("body").alias("source"), F.expr(c).alias("suspicious"))
    urls = F.slice(F.array(*(url(*u) for u in _URLS)), 1, (d % 11).cast("int"))
    domains = F.array(F.struct(F.upper("domain").alias("domain"), (d % 7 == 0).alias("homoglyph"), F.lit(False).alias("typosquat")), F.struct(F.lit("paypa1.example").alias("domain"), F.lit(False).alias("homoglyph"), (d % 5 == 0).alias("typosquat")))
    file = F.struct(F.col("filename"), F.lit("application/x").alias("content_type"), F.lit(10).alias("size"), F.col("sha").alias("sha256"), (d % 5 == 0).alias("executable"), (d % 5 == 1).alias("archive"), (d % 5 == 2).alias("office"))
    origin = F.struct(F.when(d % 6 != 0, F.col("hop_ip")).alias("ip"), F.when(d % 5 != 0, F.concat(F.lit("AS"), (d % 30).cast("string"))).alias("asn"), F.lit("Some Org").alias("org"), F.lit("An Isp").alias("isp"), F.when(d % 2 == 0, "US").alias("country"), F.when(d % 3 == 0, "Boston").alias("city"), (d % 4 == 0).alias("cloud"), (d % 9 == 0).alias("vpn"), (d % 31 == 0).alias("tor"))
    label = F.element_at(F.array(*map(F.lit, ("benign", "spam", "phishing", "bec", "impersonation"))), (d % 5 + 1).cast("int"))
    return m.withColumns({
        "hops": F.when(d % 10 == 3, F.slice(hops, 1, 0)).otherwise(hops), "urls": urls, "domains": domains, "attachments": F.when(F.col("kind") == 1, F.array(file)).otherwise(F.slice(F.array(file), 1, 0)), "origin": origin, "to": F.array("to1", "to2", F.lit("c@x"), F.lit("d@x")),
        "ips": F.array(F.lit("9.9.9.9")), "originating_ip": F.when(d % 12 != 0, F.lit("8.8.4.4")), "spf_domain": F.col("domain"), "sender_ip": F.col("hop_ip"), "dkim_key_bits": F.when(d % 8 == 0, 512).otherwise(2048), "dmarc_policy": F.when(d % 2 == 0, "reject"), "dmarc_domain": F.col("domain"),
        "reply_to_mismatch": d % 5 == 0, "return_path_mismatch": d % 4 == 0, "display_name_spoofing": d % 4 == 1, "spam_score": F.when(d % 6 == 0, 12.4).when(d % 6 == 1, 0.3), "analyzed_at": F.lit("2024-06-01T00:00:00Z"),
        "model": F.struct(label.alias("label"), ((d % 10) / 10.0).alias("confidence")), "abuse": F.struct(F.when(d % 2 == 0, "available").otherwise("error").alias("status"), (d * 7 % 100).alias("score")),
        "link_hits": (d % 13 == 0).cast("int"), "link_seen": (d % 2).cast("int"), "file_hits": (d % 17 == 0).cast("int"), "file_seen": F.lit(0), "sandbox_hits": (d % 11 == 0).cast("int"),
    })


_REP = f"""{MAIL_SQL},
rep AS (SELECT *, element AS label, (doc_id % 10) / 10.0::DOUBLE AS conf, CASE WHEN doc_id % 6 = 0 THEN 12.4::DOUBLE WHEN doc_id % 6 = 1 THEN 0.3::DOUBLE END AS spam_score, CASE WHEN doc_id % 6 <> 0 THEN hop_ip END AS origin_ip, doc_id % 10 <> 3 AS has_hops
  FROM (SELECT *, ['benign', 'spam', 'phishing', 'bec', 'impersonation'][doc_id % 5 + 1] AS element FROM mail)),
u AS ({" UNION ALL ".join(f"SELECT doc_id, email_id, domain AS own, {i} AS i, {e.format(s='varchar')} AS url, CASE WHEN doc_id % 4 <> 1 THEN 'd{i}.Example.org' END AS dom, {c} AS bad FROM rep WHERE doc_id % 11 > {i}" for i, e, c in _URLS)})"""
_SIG = f"""{_REP},
sig AS (
  SELECT email_id, 'auth' AS category, 1 AS g, 0 AS j, CASE spf WHEN 'fail' THEN 'high' ELSE 'medium' END AS level, concat('SPF ', spf, ': address not allowed by ', domain) AS text FROM rep WHERE spf IN ('fail', 'softfail')
  UNION ALL SELECT email_id, 'auth', 2, 0, 'low', 'no SPF record' FROM rep WHERE spf = 'none'
  UNION ALL SELECT email_id, 'auth', 3, 0, 'high', 'DKIM signature does not verify' FROM rep WHERE dkim = 'fail'
  UNION ALL SELECT email_id, 'auth', 4, 0, 'low', 'no DKIM signature' FROM rep WHERE dkim = 'none'
  UNION ALL SELECT email_id, 'auth', 5, 0, 'high', concat('DMARC failed, policy ', CASE WHEN doc_id % 2 = 0 THEN 'reject' ELSE '?' END) FROM rep WHERE dmarc = 'fail'
  UNION ALL SELECT email_id, 'auth', 6, 0, 'low', 'no DMARC record' FROM rep WHERE dmarc = 'none'
  UNION ALL SELECT email_id, 'auth', 7, 0, 'medium', 'weak DKIM key of 512 bits' FROM rep WHERE doc_id % 8 = 0
  UNION ALL SELECT email_id, 'header', 1, 0, 'medium', concat('Reply-To ', coalesce(reply_to, '?'), ' is of another domain') FROM rep WHERE doc_id % 5 = 0
  UNION ALL SELECT email_id, 'header', 2, 0, 'medium', concat('Return-Path ', coalesce(return_path, '?'), ' is of another domain') FROM rep WHERE doc_id % 4 = 0
  UNION ALL SELECT email_id, 'header', 3, 0, 'high', concat('display name holds an address: ', display_name) FROM rep WHERE doc_id % 4 = 1
  UNION ALL SELECT email_id, 'header', 4, 0, 'high', 'flagged as spam upstream: 12.4' FROM rep WHERE doc_id % 6 = 0
  UNION ALL SELECT email_id, 'header', 5, 0, 'medium', 'highest priority (urgency)' FROM rep WHERE doc_id % 8 = 0
  UNION ALL SELECT email_id, 'smtp', 1, 1, 'low', 'inner address at hop 1: 10.1.2.3' FROM rep WHERE has_hops
  UNION ALL SELECT email_id, 'smtp', 1, 2, 'medium', 'protocol HTTP at hop 1' FROM rep WHERE has_hops AND doc_id % 9 = 0
  UNION ALL SELECT email_id, 'smtp', 2, 0, 'medium', 'time skew at hop 2: 900.0 s' FROM rep WHERE has_hops AND doc_id % 7 = 0
  UNION ALL SELECT email_id, 'ioc', 1, i, 'high', concat('suspicious link ', replace(url, 'http', 'hxxp')) FROM u WHERE bad
  UNION ALL SELECT email_id, 'ioc', 2, 0, 'high', concat('lookalike letters in ', upper(domain)) FROM rep WHERE doc_id % 7 = 0
  UNION ALL SELECT email_id, 'ioc', 2, 1, 'high', 'resembles a brand: paypa1.example' FROM rep WHERE doc_id % 5 = 0
  UNION ALL SELECT email_id, 'ioc', 3, 0, CASE doc_id % 5 WHEN 0 THEN 'critical' ELSE 'medium' END, concat(CASE doc_id % 5 WHEN 0 THEN 'executable' ELSE 'risky' END, ' attachment ', filename) FROM rep WHERE kind = 1 AND doc_id % 5 < 3
  UNION ALL SELECT email_id, 'origin', 1, 0, 'info', 'sent from a hosting provider: Some Org' FROM rep WHERE doc_id % 4 = 0
  UNION ALL SELECT email_id, 'origin', 2, 0, 'medium', 'sent through an anonymizer: Some Org' FROM rep WHERE doc_id % 9 = 0
  UNION ALL SELECT email_id, 'origin', 3, 0, 'high', concat('sent from a Tor exit: ', coalesce(origin_ip, '?')) FROM rep WHERE doc_id % 31 = 0),
signals AS (SELECT email_id, concat(upper(category), '-', lpad(CAST(row_number() OVER (PARTITION BY email_id, category ORDER BY g, j) AS VARCHAR), 3, '0')) AS signal_id, category, level, text,
  row_number() OVER (PARTITION BY email_id ORDER BY list_position(['auth', 'header', 'smtp', 'ioc', 'origin'], category), g, j) AS k FROM sig)"""


@_query(f"{_SIG} SELECT email_id, signal_id, category, level, text FROM signals")
def g1_g2_signals(spark, sf_dir):
    return reports(spark, sf_dir).select("email_id", F.explode(sg.risk_signals()).alias("s")).select("email_id", "s.*")


#: (condition, factor, category, points) in order.
_FACTORS_SQL = (
    ("spf = 'fail'", "spf_fail", "auth", "15"), ("spf = 'softfail'", "spf_softfail", "auth", "8"), ("dkim = 'fail'", "dkim_fail", "auth", "15"), ("dmarc = 'fail'", "dmarc_fail", "auth", "15"), ("doc_id % 5 = 0", "reply_to_mismatch", "header", "10"),
    ("doc_id % 4 = 0", "return_path_mismatch", "header", "8"), ("doc_id % 4 = 1", "display_name_spoofing", "header", "12"), ("doc_id % 6 = 0", "spam_flagged", "header", "12"), ("doc_id % 8 = 0", "high_priority", "header", "5"),
    ("n_bad > 0", "suspicious_url", "ioc", "least(20, 10 * n_bad)"), ("doc_id % 7 = 0", "homoglyph_domain", "ioc", "12"), ("doc_id % 5 = 0", "typosquat_domain", "ioc", "12"), ("kind = 1 AND doc_id % 5 = 0", "executable_attachment", "ioc", "20"),
    ("conf >= 0.6 AND label IN ('phishing', 'bec', 'impersonation')", "model_threat", "content_ml", "least(20, round_even(conf * 20, 0))"), ("conf >= 0.6 AND label = 'spam'", "model_spam", "content_ml", "least(15, round_even(conf * 15, 0))"),
    ("doc_id % 8 = 0", "content_urgency", "content_ml", "8"), ("doc_id % 31 = 0", "tor_exit", "origin", "15"), ("doc_id % 9 = 0", "vpn", "origin", "8"), ("doc_id % 2 = 0 AND doc_id * 7 % 100 >= 75", "abuse_malicious", "origin", "15"),
    ("doc_id % 2 = 0 AND doc_id * 7 % 100 BETWEEN 25 AND 74", "abuse_suspicious", "origin", "8"), ("doc_id % 13 = 0", "link_verdict", "threat_intel", "20"), ("doc_id % 17 = 0", "file_verdict", "threat_intel", "20"), ("doc_id % 11 = 0 AND doc_id % 13 <> 0", "sandbox_verdict", "threat_intel", "15"),
)
_LEVEL = "CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
_SCORE = f"""{_REP},
nb AS (SELECT rep.*, coalesce(n, 0) AS n_bad FROM rep LEFT JOIN (SELECT email_id, count(*) AS n FROM u WHERE bad GROUP BY email_id) USING (email_id)),
sc AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN '{f}' END" for c, f, _, _ in _FACTORS_SQL)}], lambda x: x IS NOT NULL) AS factors, least(100, {" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, _, p in _FACTORS_SQL)})::INT AS risk_score,
  {" OR ".join(f"({c})" for c, f, g, _ in _FACTORS_SQL if g in ("ioc", "threat_intel"))} AS malicious, {" OR ".join(f"({c})" for c, f, _, _ in _FACTORS_SQL if f in ("spf_fail", "dkim_fail", "dmarc_fail"))} AS auth, doc_id % 7 = 0 OR doc_id % 5 = 0 AS alike,
  doc_id % 6 = 0 OR (conf >= 0.6 AND label = 'spam') AS spam, round_even(greatest(0.2, ((spf IN ('pass', 'fail', 'softfail'))::INT + (dkim <> 'none')::INT + (dmarc <> 'none')::INT + (doc_id % 2 = 0)::INT + (doc_id % 13 = 0 OR doc_id % 2 = 1)::INT + (doc_id % 17 = 0)::INT) / 6.0::DOUBLE), 2) AS telemetry FROM nb),
scored AS (SELECT *, {_LEVEL.format('risk_score')} AS risk_level FROM sc)"""
_VERDICT_SQL = """CASE risk_level WHEN 'CRITICAL' THEN CASE WHEN malicious THEN 'CRITICAL RISK - CONFIRMED MALICIOUS INDICATORS' ELSE 'CRITICAL RISK - MULTIPLE AUTH & INFRASTRUCTURE ANOMALIES' END
  WHEN 'HIGH' THEN CASE WHEN alike AND (auth OR malicious) THEN 'HIGH RISK - BRAND TYPOSQUATTING & DECEPTION DETECTED' WHEN auth AND malicious THEN 'HIGH RISK - PHISHING INDICATORS WITH AUTH FAILURE' WHEN malicious THEN 'HIGH RISK - SUSPICIOUS INFRASTRUCTURE & INDICATORS'
    WHEN auth THEN 'HIGH RISK - AUTHENTICATION FAILURE & SPOOFING DETECTED' ELSE 'HIGH RISK - MULTIPLE THREAT INDICATORS' END
  WHEN 'MEDIUM' THEN CASE WHEN spam THEN 'MEDIUM RISK - SPAM / UNWANTED EMAIL DETECTED' ELSE 'MEDIUM RISK - SUSPICIOUS INDICATORS REQUIRE REVIEW' END
  ELSE CASE WHEN len(factors) = 0 THEN 'LOW RISK - NO THREAT INDICATORS DETECTED' ELSE 'LOW RISK - MINOR ANOMALIES DETECTED' END END"""


def _explained(spark, sf_dir) -> DataFrame:
    rows = reports(spark, sf_dir).withColumn("found", sg.score_factors())
    return rows.withColumns(sg.explained(F.col("found")))


@_query(f"{_SCORE} SELECT email_id, factors, risk_score, risk_level, telemetry, {_VERDICT_SQL} AS verdict, CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN 4 + auth::INT WHEN risk_level = 'MEDIUM' THEN 3 ELSE 2 END AS n_actions FROM scored")
def g3_g6_explained_score(spark, sf_dir):
    names = F.transform("found", lambda f: f["factor"]).alias("factors")
    return _explained(spark, sf_dir).select("email_id", names, "risk_score", "risk_level", "telemetry", "verdict", F.size("actions").alias("n_actions"))


_EVENTS_SQL = f"""{_REP},
e AS (
  SELECT email_id, date AS moment, 0 AS g, 0 AS j, 'email' AS category, 'EMAIL_COMPOSED' AS event, 'info' AS severity, concat('written by ', from_address) AS text FROM rep
  UNION ALL SELECT email_id, iso1, 1, 1, 'smtp', 'SMTP_HOP_1', 'low', 'relayed by edge' FROM rep WHERE has_hops
  UNION ALL SELECT email_id, iso3, 1, 2, 'smtp', 'SMTP_HOP_2', CASE WHEN doc_id % 7 = 0 THEN 'medium' ELSE 'info' END, concat('relayed by mx.corp.example, after ', CASE WHEN doc_id % 7 = 0 THEN '900.0' ELSE '60.0' END, ' s') FROM rep WHERE has_hops
  UNION ALL SELECT email_id, now, 2, 1, 'auth', 'SPF_CHECK', CASE spf WHEN 'fail' THEN 'high' WHEN 'softfail' THEN 'medium' ELSE 'info' END, concat('SPF result: ', spf) FROM rep, n
  UNION ALL SELECT email_id, now, 2, 2, 'auth', 'DKIM_CHECK', CASE dkim WHEN 'fail' THEN 'high' ELSE 'info' END, concat('DKIM result: ', dkim) FROM rep, n
  UNION ALL SELECT email_id, now, 2, 3, 'auth', 'DMARC_CHECK', CASE dmarc WHEN 'fail' THEN 'high' ELSE 'info' END, concat('DMARC result: ', dmarc) FROM rep, n
  UNION ALL SELECT email_id, now, 3, 1, 'header', 'REPLY_TO_MISMATCH', 'medium', concat('reply to ', coalesce(reply_to, '?')) FROM rep, n WHERE doc_id % 5 = 0
  UNION ALL SELECT email_id, now, 3, 2, 'header', 'RETURN_PATH_MISMATCH', 'medium', concat('return to ', coalesce(return_path, '?')) FROM rep, n WHERE doc_id % 4 = 0
  UNION ALL SELECT email_id, now, 3, 3, 'header', 'DISPLAY_NAME_SPOOFING', 'high', concat('named ', display_name) FROM rep, n WHERE doc_id % 4 = 1
  UNION ALL SELECT email_id, now, 4, i, 'ioc', 'SUSPICIOUS_URL_FOUND', 'high', concat('suspicious link ', replace(url, 'http', 'hxxp')) FROM u, n WHERE bad
  UNION ALL SELECT email_id, now, 5, 0, 'ioc', 'ATTACHMENT_FOUND', CASE WHEN doc_id % 5 = 0 THEN 'critical' ELSE 'medium' END, concat('attachment ', filename) FROM rep, n WHERE kind = 1
  UNION ALL SELECT email_id, now, 6, 0, 'origin', 'ORIGIN_IP_IDENTIFIED', CASE WHEN doc_id % 31 = 0 THEN 'critical' WHEN doc_id % 9 = 0 THEN 'high' ELSE 'info' END, concat('sent from ', origin_ip, ' (', CASE WHEN doc_id % 2 = 0 THEN 'US' ELSE 'unknown' END, ')') FROM rep, n WHERE origin_ip IS NOT NULL
  UNION ALL SELECT email_id, now, 7, 0, 'system', 'FORENSIC_ANALYSIS_COMPLETE', 'info', 'analysis complete' FROM rep, n)"""
_EVENTS_SQL = _EVENTS_SQL.replace("\ne AS (", "\nn AS (SELECT '2024-06-01T00:00:00Z' AS now),\ne AS (", 1)


@_query(f"{_EVENTS_SQL} SELECT email_id, row_number() OVER (PARTITION BY email_id ORDER BY moment, g, j)::INT AS n, moment, category, event, severity, text FROM e")
def g7_timeline(spark, sf_dir):
    each = reports(spark, sf_dir).select("email_id", F.posexplode(sg.timeline()).alias("n", "e"))
    return each.select("email_id", (F.col("n") + 1).alias("n"), F.col("e.at").alias("moment"), "e.category", "e.event", "e.severity", "e.text")


@_query(f"""{_SCORE} SELECT email_id, CASE label WHEN 'benign' THEN 'none' WHEN 'bec' THEN 'executive impersonation' WHEN 'phishing' THEN 'credential harvesting' WHEN 'impersonation' THEN 'brand impersonation' ELSE 'social engineering' END AS deception,
  CASE WHEN label = 'benign' THEN 'compliant' WHEN spf = 'fail' OR dmarc = 'fail' THEN 'failed' WHEN doc_id % 5 = 0 THEN 'manipulated headers' ELSE 'bypassed or failed' END AS authentication,
  CASE WHEN label = 'benign' THEN 'clean' WHEN kind = 1 AND doc_id % 5 = 0 THEN 'executable' WHEN doc_id % 11 > 0 THEN 'link' ELSE 'none' END AS payload,
  list_concat(CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN ['P1', 'P1'] ELSE [] END, list_concat(CASE WHEN label IN ('phishing', 'impersonation') THEN ['P2'] ELSE [] END, list_concat(CASE WHEN label = 'bec' THEN ['P1'] ELSE [] END, CASE WHEN risk_level IN ('LOW', 'MEDIUM') AND label IN ('benign', 'spam') THEN ['P3'] ELSE [] END))) AS priorities,
  CASE WHEN label = 'benign' THEN concat('mail ''', subject, ''' from ', from_address, ': nothing found, score ', risk_score, ' of 100') ELSE concat(risk_level, ' ', label, ', score ', risk_score, ' of 100: mail ''', subject, ''' from ', from_address, CASE WHEN len(factors) > 0 THEN concat('; ', array_to_string(factors[1:3], '; ')) ELSE '' END) END AS summary,
  list_concat(CASE label WHEN 'phishing' THEN ['Phishing: Spearphishing Link', 'Application Layer Protocol: Web Protocols'] WHEN 'bec' THEN ['Internal Spearphishing', 'Phishing'] WHEN 'impersonation' THEN ['Phishing: Spearphishing Link', 'Masquerading: Double File Extension / Name'] WHEN 'spam' THEN ['Phishing'] ELSE [] END,
    CASE WHEN kind = 1 AND doc_id % 5 = 0 THEN ['Phishing: Spearphishing Attachment'] ELSE [] END) AS techniques FROM scored""")
def g14_g15_briefing(spark, sf_dir):
    rows, label = _explained(spark, sf_dir), F.col("model.label")
    executable = F.size(F.filter("attachments", lambda a: a["executable"]))
    vector = sg.attack_vector(label, F.size("urls"))
    priorities = F.transform(sg.soc_actions(F.col("risk_level"), label), lambda a: a["priority"])
    names = F.transform(sg.technique_details(techniques(label, executable)), lambda t: t["name"])
    summary = sg.incident_summary(label, F.col("risk_score"), F.col("risk_level"), F.transform("found", lambda f: f["factor"]))
    return rows.select("email_id", vector.alias("v"), priorities.alias("priorities"), summary.alias("summary"), names.alias("techniques")).select("email_id", "v.*", "priorities", "summary", "techniques")


@_query(f"""{_REP} SELECT email_id, domain AS sender_domain, coalesce(origin_ip, CASE WHEN doc_id % 12 <> 0 THEN '8.8.4.4' END, CASE WHEN has_hops THEN '10.1.2.3' END, '9.9.9.9') AS origin_ip, spf AS spf_status, doc_id % 11 AS n_urls, (kind = 1)::INT AS attachment_count,
  CASE WHEN has_hops THEN 2 ELSE 0 END AS smtp_hops, doc_id % 5 = 0 AS reply_to_mismatch, CASE WHEN doc_id % 2 = 0 THEN 'US' ELSE 'Unknown' END AS country, CASE WHEN doc_id % 5 <> 0 THEN concat('AS', doc_id % 30) ELSE 'An Isp' END AS asn FROM rep""")
def g16_response(spark, sf_dir):
    r = reports(spark, sf_dir).select("email_id", *(c.alias(k) for k, c in sg.response().items()))
    return r.select("email_id", "sender_domain", "origin_ip", "spf_status", F.size("extracted_urls").alias("n_urls"), "attachment_count", "smtp_hops", "reply_to_mismatch", "country", "asn")


_GRAPH_SQL = f"""{_SIG},
x AS (SELECT *, concat('Email: ', CASE WHEN left(subject, 28) = '' THEN email_id ELSE left(subject, 28) END) AS mid, concat('From: ', from_address) AS fid, concat('Domain: ', domain) AS did, concat('Origin IP: ', origin_ip) AS oid, concat('ASN: ', CASE WHEN doc_id % 5 <> 0 THEN concat('AS', doc_id % 30) ELSE 'An' END) AS aid,
  concat('Geo: ', CASE WHEN doc_id % 2 = 0 THEN 'US' ELSE 'Unknown' END, CASE WHEN doc_id % 3 = 0 THEN ', Boston' ELSE '' END) AS gid, concat('SPF [', upper(spf), ']') AS s1, concat('DKIM [', upper(dkim), ']') AS s2, concat('DMARC [', upper(dmarc), ']') AS s3 FROM rep),
w AS (SELECT u.*, x.mid, x.did, concat('URL-', i + 1, ': ', coalesce(dom, concat(left(url, 24), '...'))) AS uid FROM u JOIN x USING (email_id) WHERE i < 8),
links AS (
  SELECT email_id, mid AS source, fid AS target, 'TRANSMITTED_BY' AS rel, 'email' AS st, 'identity' AS tt FROM x UNION ALL SELECT email_id, fid, did, 'HOSTED_ON_DOMAIN', 'identity', 'domain' FROM x
  UNION ALL SELECT email_id, mid, concat('To: ', t), 'DELIVERED_TO', 'email', 'identity' FROM x, LATERAL (SELECT unnest([to1, to2, 'c@x']) AS t)
  UNION ALL SELECT email_id, did, 'Hop 1: edge', 'INITIAL_INJECTION', 'domain', 'hop' FROM x WHERE has_hops UNION ALL SELECT email_id, 'Hop 1: edge', 'Hop 2: mx.corp.example', concat('RELAYS_TO (+', CASE WHEN doc_id % 7 = 0 THEN '900.0' ELSE '60.0' END, 's)'), 'hop', 'hop' FROM x WHERE has_hops
  UNION ALL SELECT email_id, 'Hop 1: edge', 'IP: 10.1.2.3', 'RESOLVES_IP', 'hop', 'ip' FROM x WHERE has_hops UNION ALL SELECT email_id, 'Hop 2: mx.corp.example', concat('IP: ', hop_ip), 'RESOLVES_IP', 'hop', 'ip' FROM x WHERE has_hops
  UNION ALL SELECT email_id, CASE WHEN has_hops THEN 'Hop 2: mx.corp.example' ELSE did END, mid, CASE WHEN has_hops THEN 'INGRESS_GATEWAY' ELSE 'DIRECT_DISPATCH' END, CASE WHEN has_hops THEN 'hop' ELSE 'domain' END, 'email' FROM x
  UNION ALL SELECT email_id, did, oid, 'RESOLVES_ORIGIN', 'domain', 'ip' FROM x WHERE origin_ip IS NOT NULL UNION ALL SELECT email_id, oid, aid, 'ROUTED_THROUGH_ASN', 'ip', 'asn' FROM x WHERE origin_ip IS NOT NULL UNION ALL SELECT email_id, oid, gid, 'LOCATED_IN', 'ip', 'geo' FROM x WHERE origin_ip IS NOT NULL
  UNION ALL SELECT email_id, did, s1, 'SPF_CHECK', 'domain', 'auth' FROM x UNION ALL SELECT email_id, did, s2, 'DKIM_SIGNATURE', 'domain', 'auth' FROM x UNION ALL SELECT email_id, did, s3, 'DMARC_POLICY', 'domain', 'auth' FROM x
  UNION ALL SELECT email_id, mid, uid, 'EMBEDS_HYPERLINK', 'email', 'url' FROM w UNION ALL SELECT email_id, uid, concat('Domain: ', lower(dom)), 'HOSTED_ON_DOMAIN', 'url', 'domain' FROM w WHERE dom IS NOT NULL
  UNION ALL SELECT email_id, mid, 'Domain: paypa1.example', 'REFERENCES_DOMAIN', 'email', 'domain' FROM x
  UNION ALL SELECT email_id, mid, concat('File: ', filename), 'CARRIES_ATTACHMENT', 'email', 'attachment' FROM x WHERE kind = 1 UNION ALL SELECT email_id, concat('File: ', filename), concat('Hash: ', left(sha, 12), '...'), 'PAYLOAD_HASH', 'attachment', 'hash' FROM x WHERE kind = 1
  UNION ALL SELECT email_id, mid, concat('Alert: ', signal_id), 'FLAGGED_ANOMALY', 'email', 'threat' FROM x JOIN signals USING (email_id) WHERE k <= 3)"""


def _graph(spark, sf_dir, part: str) -> DataFrame:
    """The mails' ``nodes`` or ``links``, a row each; the arrays are written first, or the filter for empty ones would be pushed below the reports and spell all of them out."""
    parts = dict(zip(("nodes", "links"), sg.graph(F.col("alerts")), strict=True))
    held = reports(spark, sf_dir).withColumn("alerts", sg.risk_signals()).select("email_id", parts[part].alias(part))
    return written(held, "graph").select("email_id", F.explode(part).alias("n")).select("email_id", "n.*")


@_query(f"{_GRAPH_SQL} SELECT DISTINCT email_id, source AS id, st AS type FROM links UNION SELECT email_id, target, tt FROM links")
def g17_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir, "nodes")


@_query(f"{_GRAPH_SQL} SELECT DISTINCT email_id, source, target, rel FROM links")
def g17_graph_links(spark, sf_dir):
    return _graph(spark, sf_dir, "links")


# ---- the whole job, from raw messages

#: (condition, factor, points) of the derived messages; networks and reputations go by the last two numbers of the relay's address.
_RULES = (
    ("spf = 'fail'", "spf_fail", 15), ("spf = 'softfail'", "spf_softfail", 8), ("dkim = 'fail'", "dkim_fail", 15), ("dmarc = 'fail'", "dmarc_fail", 15), ("doc_id % 5 = 0", "reply_to_mismatch", 10), ("doc_id % 4 = 0", "return_path_mismatch", 8), ("doc_id % 4 = 1", "display_name_spoofing", 12),
    ("spam_status LIKE 'Yes%' OR spam_header IS NOT NULL", "spam_flagged", 12), ("doc_id % 8 = 0", "high_priority", 5), ("kind = 1 AND doc_id % 5 = 0", "executable_attachment", 20), ("doc_id % 8 = 0", "content_urgency", 8), ("y % 50 = 0", "tor_exit", 15), ("k % 3 <> 0 AND k % 4 = 1", "vpn", 8),
    ("y % 2 = 0 AND y % 101 >= 75", "abuse_malicious", 15), ("y % 2 = 0 AND y % 101 BETWEEN 25 AND 74", "abuse_suspicious", 8), ("doc_id % 10 = 7", "assessment_sure", 15), ("doc_id % 10 = 8", "assessment_other", 10),
)


@_query(f"""{MAIL_SQL}, r AS (SELECT email_id, doc_id, kind, hop_ip, spam_status, spam_header, doc_id % 250 AS k, doc_id % 200 AS y, spf, CASE WHEN kind = 2 THEN 'none' ELSE dkim END AS dkim, CASE WHEN kind = 2 THEN 'none' ELSE dmarc END AS dmarc, domain FROM mail)
SELECT email_id, spf, dkim, dmarc, hop_ip AS origin_ip, CASE WHEN k % 3 <> 0 THEN concat('AS', k) ELSE 'AS9000' END AS asn, domain AS sender_domain, 3 AS n_hops, (kind = 1)::INT AS n_attachments,
  list_filter([{", ".join(f"CASE WHEN {c} THEN '{f}' END" for c, f, _ in _RULES)}], lambda x: x IS NOT NULL) AS factors, ({" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in _RULES)})::INT AS points,
  round_even(least(1.0, greatest(0.2, ((spf IN ('pass', 'fail', 'softfail'))::INT + (dkim <> 'none')::INT + (dmarc <> 'none')::INT + (y % 2 = 0)::INT + (doc_id % 10 IN (7, 8))::INT) / 6.0)), 2)::DOUBLE AS telemetry FROM r""")
def g_raw_to_verdict(spark, sf_dir):
    """The points of all factors but the classifier's, whose features have queries of their own."""
    mails = messages(spark, sf_dir)
    y = F.split_part("ip", F.lit("."), F.lit(4)).cast("int")
    ips = mails.select(F.col("hop_ip").alias("ip")).distinct()
    abuse = ips.filter(y % 2 == 0).select("ip", (y % 101).cast("int").alias("abuse_score"), F.lit(3).alias("reports"), (y % 50 == 0).alias("tor"))
    last = F.col("doc_id") % 10
    told = mails.filter(last.isin(7, 8, 9)).select("email_id", F.when(last == 9, "error").otherwise("available").alias("status"), F.when(last == 7, "Malware").otherwise("suspicious").alias("label"), F.when(last == 7, 85.0).otherwise(0.9).alias("confidence"))
    known = an.snapshots(spark, prefixes=_nets(spark, sf_dir), reputation=abuse, assessments=told)
    found = an.analyze(mails.select("email_id", "content"), known, "2024-06-01T00:00:00Z")
    rules = F.filter("factors", lambda f: ~f["factor"].startswith("model"))
    return found.select(
        "email_id", "spf", "dkim", "dmarc", "origin.ip", "origin.asn", "answer.sender_domain", F.size("hops").alias("n_hops"), F.size("attachments").alias("n_attachments"), F.transform(rules, lambda f: f["factor"]).alias("factors"),
        F.aggregate(rules, F.lit(0), lambda a, f: a + f["points"]).alias("points"), "telemetry",
    ).withColumnRenamed("ip", "origin_ip")
