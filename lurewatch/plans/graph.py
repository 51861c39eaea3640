"""Queries of the graph (J1-J8, J23-J32), relays and bursts (B13, F1, K2) and evaluation (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.indicators import SPECIAL_V4, _v4
from ..operators import campaigns as camp
from ..operators import evaluation as ev
from ..operators import graph as g
from ..operators import pivots as p
from ..operators import relay
from ..operators.tables import written
from .campaigns import _M
from .campaigns import SQL as CAMPAIGN_SQL
from .fixtures import emails, iocs, resolves, table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _asn(found):
    return found.select("ip", F.concat(F.lit("6450"), (F.split_part("ip", F.lit("."), F.lit(4)).try_cast("int") % 7).cast("string")).alias("number")).distinct()


def _graph(spark, sf_dir):
    mails = written(emails(spark, sf_dir).drop("body"), "mails")
    contained, found = iocs(mails), resolves(mails)
    return mails, contained, found, g.edges(mails, contained, found, _asn(found))


def _full(spark, sf_dir):
    mails, contained, found, edges = _graph(spark, sf_dir)
    rows = written(camp.indicator_rows(mails, contained, found), "indicator-rows")
    return written(edges.unionByName(camp.campaign_edges(rows, camp.members(rows, linked=camp.links(rows)))), "graph-edges")


_HOST = r"regexp_replace(lower(regexp_extract(value, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_EDGES = f"""
edges AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT 'Email' AS src_label, email_id AS src_key, 'SENT_FROM' AS rel, 'Domain' AS dst_label, sender_domain AS dst_key FROM emails
    UNION ALL SELECT 'Email', email_id, 'CONTAINS_DOMAIN', 'Domain', value FROM iocs WHERE kind = 'domain'
    UNION ALL SELECT 'Email', email_id, 'CONTAINS_URL', 'URL', sha256(value) FROM iocs WHERE kind = 'url'
    UNION ALL SELECT 'URL', sha256(value), 'HOSTED_ON_DOMAIN', 'Domain', {_HOST} FROM iocs WHERE kind = 'url'
    UNION ALL SELECT 'Email', email_id, 'CONTAINS_HASH', 'Hash', value FROM iocs WHERE kind = 'hash'
    UNION ALL SELECT 'Domain', domain, 'RESOLVES_TO', 'IP', ip FROM resolves
    UNION ALL SELECT 'IP', ip, 'BELONGS_TO_ASN', 'ASN', concat('6450', split_part(ip, '.', 4)::INT % 7) FROM resolves)
  WHERE src_key <> '' AND dst_key <> '')"""
from .fixtures import BASE_SQL  # noqa: E402

_E = f"{BASE_SQL},{_EDGES}"
_FULL = f"{_M},{_EDGES}, full_edges AS MATERIALIZED (SELECT * FROM edges UNION ALL SELECT * FROM ({CAMPAIGN_SQL['j14_campaign_edges'][len(_M):]}))"
_NODES = """
writes AS (
  SELECT 'Email' AS label, email_id AS key, doc_id AS seq, risk_score, subject AS name FROM emails
  UNION ALL SELECT e.dst_label, e.dst_key, m.doc_id, m.risk_score, NULL FROM edges e JOIN emails m ON e.src_label = 'Email' AND e.src_key = m.email_id
  UNION ALL SELECT DISTINCT label, key, -1::BIGINT, NULL::DOUBLE, NULL FROM (SELECT src_label AS label, src_key AS key FROM edges WHERE src_label <> 'Email' UNION ALL SELECT dst_label, dst_key FROM edges WHERE src_label <> 'Email')),
nodes AS MATERIALIZED (SELECT label, key, arg_max(risk_score, seq) AS risk_score, arg_max(name, seq) AS name, min(seq) AS created_seq, max(seq) AS updated_seq FROM writes GROUP BY ALL)"""


def _nodes(mails, edges):
    return g.upsert_nodes(None, g.node_writes(mails, edges))


@_query(f"{_E},{_NODES} SELECT label, key, risk_score, name, created_seq, updated_seq FROM nodes")
def j1_j3_nodes(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    return _nodes(mails, edges)


@_query(f"{_E} SELECT * FROM edges")
def j2_j4_edges(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    edges = written(edges, "edges-in")
    return g.upsert_edges(None, edges, _nodes(mails, edges))


@_query(f"{_E},{_NODES}, middle AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS m FROM emails) SELECT label, count(*) FILTER (NOT old) AS created, count(*) FILTER (old) AS matched FROM (SELECT n.label, n.key, o.key IS NOT NULL AS old FROM nodes n LEFT JOIN (SELECT DISTINCT label, key FROM writes, middle WHERE seq BETWEEN 0 AND m) o USING (label, key)) GROUP BY label")
def j5_ingest_counts_half(spark, sf_dir):
    """The stored graph is that of the emails up to the middle of the time span, so it grows with the table."""
    mails, _, _, edges = _graph(spark, sf_dir)
    middle = mails.agg(F.floor((F.min("doc_id") + F.max("doc_id")) / 2)).first()[0] or 0
    writes = written(g.node_writes(mails, edges), "writes")
    return g.ingest_counts(writes, g.upsert_nodes(None, writes.filter(F.col("seq").between(0, middle))))


@_query(f"{_E},{_NODES} SELECT label, key, name FROM nodes WHERE label = 'Email' AND key = 'email-7'")
def j7_lookup(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    return g.lookup(_nodes(mails, edges), "Email", "email-7").select("label", "key", "name")


@_query(f"{_E},{_NODES}, types AS (" + " UNION ALL ".join(f"SELECT 'node' AS kind, '{x}' AS type" for x in g.LABELS) + "".join(f" UNION ALL SELECT 'edge', '{x}'" for x in g.RELATIONSHIPS) + ") SELECT kind, type, coalesce(n, 0) AS n FROM types LEFT JOIN (SELECT 'node' AS kind, label AS type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY ALL) USING (kind, type)")
def j8_statistics(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    return g.statistics(_nodes(mails, edges), edges)


_COLLECT = lambda table, key, name: f"(SELECT {key}, list_sort(list(DISTINCT {name})) AS x FROM {table} GROUP BY 1)"
_REL = """
r AS (SELECT src_key AS domain, dst_key AS ip FROM full_edges WHERE rel = 'RESOLVES_TO'),
md AS (SELECT DISTINCT src_key AS email, dst_key AS domain FROM full_edges WHERE rel IN ('SENT_FROM', 'CONTAINS_DOMAIN')),
rm AS (SELECT ip, email FROM r JOIN md USING (domain)),
ui AS (SELECT src_key AS campaign, dst_key AS ip FROM full_edges WHERE rel = 'USES_IP'),
asn AS (SELECT src_key AS ip, dst_key AS asn FROM full_edges WHERE rel = 'BELONGS_TO_ASN'),
ud AS (SELECT src_key AS campaign, dst_key AS domain FROM full_edges WHERE rel = 'USES_DOMAIN'),
ho AS (SELECT src_key AS url, dst_key AS domain FROM full_edges WHERE rel = 'HOSTED_ON_DOMAIN'),
ch AS (SELECT src_key AS email, dst_key AS hash FROM full_edges WHERE rel = 'CONTAINS_HASH'),
uh AS (SELECT src_key AS campaign, dst_key AS hash FROM full_edges WHERE rel = 'USES_HASH'),
ad AS (SELECT asn, domain FROM asn JOIN r USING (ip)),
am AS (SELECT asn, email FROM ad JOIN md USING (domain))"""


def _listed(key: str, **parts: tuple[str, str]) -> str:
    """Distinct members of each kind."""
    return " UNION ".join(f"SELECT {key}, '{kind}' AS kind, {c} AS value FROM {t}" for kind, (t, c) in parts.items())


def _paths(base: str, key: str, **parts: tuple[str, str]) -> str:
    """Distinct members of each kind as lists, for all keys of ``base``."""
    joins = " ".join(f"LEFT JOIN {_COLLECT(t, key, c)} {name} ON {name}.{key} = b.{key}" for name, (t, c) in parts.items())
    return f"(SELECT b.{key}, {', '.join(f'coalesce({name}.x, []) AS {name}' for name in parts)} FROM (SELECT DISTINCT {key} FROM {base}) b {joins})"


_IP = _paths("r", "ip", domains=("r", "domain"), emails=("rm", "email"), campaigns=("ui", "campaign"), asns=("asn", "asn"))
_OF_IP = {"domain": ("r", "domain"), "email": ("rm", "email"), "campaign": ("ui", "campaign"), "asn": ("asn", "asn")}
_OF_DOMAIN = {"ip": ("r", "ip"), "url": ("ho", "url"), "email": ("md", "email"), "campaign": ("ud", "campaign")}
_OF_HASH = {"email": ("ch", "email"), "campaign": ("uh", "campaign")}
_OF_ASN = {"ip": ("asn", "ip"), "domain": ("ad", "domain"), "email": ("am", "email")}


@_query(f"{_FULL},{_REL} SELECT *, round(greatest(0.2, least(1.0, len(domains) * 0.25 + len(emails) * 0.1 + len(campaigns) * 0.35))::DOUBLE, 6) AS strength FROM {_IP}")
def j23_ip_pivot(spark, sf_dir):
    return p.ip_lists(_full(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@_query(f"{_FULL},{_REL} {_listed('ip', **_OF_IP)}")
def j23_ip_members(spark, sf_dir):
    return p.ip_members(_full(spark, sf_dir))


@_query(f"{_FULL},{_REL} SELECT *, round(greatest(0.2, least(1.0, len(ips) * 0.3 + len(emails) * 0.15 + len(campaigns) * 0.35))::DOUBLE, 6) AS strength FROM {_paths('(SELECT domain FROM md UNION SELECT domain FROM r UNION SELECT domain FROM ho UNION SELECT domain FROM ud)', 'domain', ips=('r', 'ip'), urls=('ho', 'url'), emails=('md', 'email'), campaigns=('ud', 'campaign'))}")
def j24_domain_pivot(spark, sf_dir):
    return p.domain_lists(_full(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@_query(f"{_FULL},{_REL} {_listed('domain', **_OF_DOMAIN)}")
def j24_domain_members(spark, sf_dir):
    return p.domain_members(_full(spark, sf_dir))


@_query(f"{_FULL},{_REL} SELECT *, round(least(1.0, len(emails) * 0.3 + len(campaigns) * 0.4)::DOUBLE, 6) AS strength FROM {_paths('ch', 'hash', emails=('ch', 'email'), campaigns=('uh', 'campaign'))}")
def j25_hash_pivot(spark, sf_dir):
    return p.hash_lists(_full(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@_query(f"{_FULL},{_REL} {_listed('hash', **_OF_HASH)}")
def j25_hash_members(spark, sf_dir):
    return p.hash_members(_full(spark, sf_dir))


@_query(f"{_FULL},{_REL} SELECT * FROM {_paths('asn', 'asn', ips=('asn', 'ip'), domains=('ad', 'domain'), emails=('am', 'email'))}")
def j26_asn_pivot(spark, sf_dir):
    return p.asn_lists(_full(spark, sf_dir))


@_query(f"{_FULL},{_REL} {_listed('asn', **_OF_ASN)}")
def j26_asn_members(spark, sf_dir):
    return p.asn_members(_full(spark, sf_dir))


@_query(f"{_FULL},{_REL} SELECT ip, len(domains)::INT AS n_domains, len(emails)::INT AS n_emails, campaigns, round(least(1.0, len(domains) * 0.3 + len(emails) * 0.15 + len(campaigns) * 0.35)::DOUBLE, 6) AS strength FROM {_IP} WHERE len(domains) >= 2 OR len(emails) >= 2 ORDER BY n_domains DESC, n_emails DESC, ip LIMIT 20")
def j27_clusters(spark, sf_dir):
    return p.cluster_lists(_full(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@_query(f"{_FULL},{_REL}, sd AS (SELECT src_key AS email, dst_key AS domain FROM full_edges WHERE rel = 'SENT_FROM'), cd AS (SELECT src_key AS email, dst_key AS domain FROM full_edges WHERE rel = 'CONTAINS_DOMAIN'), si AS (SELECT email, ip FROM sd JOIN r USING (domain)), ci AS (SELECT email, ip FROM cd JOIN r USING (domain)), cu AS (SELECT src_key AS email, dst_key AS url FROM full_edges WHERE rel = 'CONTAINS_URL'), mo AS (SELECT src_key AS email, dst_key AS campaign FROM full_edges WHERE rel = 'MEMBER_OF') SELECT t.*, s.sender_domain FROM {_paths('(SELECT email_id AS email FROM emails)', 'email', sender_ips=('si', 'ip'), domains=('cd', 'domain'), resolved_ips=('ci', 'ip'), urls=('cu', 'url'), hashes=('ch', 'hash'), campaigns=('mo', 'campaign'))} t LEFT JOIN (SELECT email, min(domain) AS sender_domain FROM sd GROUP BY 1) s USING (email)")
def j28_email_paths(spark, sf_dir):
    return p.email_paths(_full(spark, sf_dir))


_BFS = f"""{_E}, both_ways AS MATERIALIZED (SELECT src_label || ':' || src_key AS a, dst_label || ':' || dst_key AS b FROM edges UNION SELECT dst_label || ':' || dst_key, src_label || ':' || src_key FROM edges),
c0 AS (SELECT 'Email:' || email_id AS centre FROM emails WHERE doc_id % 20 = 0), d1 AS (SELECT DISTINCT centre, b AS node FROM c0 JOIN both_ways ON a = centre),
d2 AS (SELECT DISTINCT centre, b AS node FROM d1 JOIN both_ways ON a = node),
seen AS (SELECT centre, node, min(d) AS distance FROM (SELECT centre, centre AS node, 0 AS d FROM c0 UNION ALL SELECT centre, node, 1 FROM d1 UNION ALL SELECT centre, node, 2 FROM d2) GROUP BY ALL)"""


def _centres(spark, sf_dir):
    """Around every email whose id is divisible by 20."""
    mails, _, _, edges = _graph(spark, sf_dir)
    return p.whole_neighbourhood(written(edges, "edges-in"), mails.filter("doc_id % 20 = 0").select(F.lit("Email").alias("label"), F.col("email_id").alias("key")))


@_query(f"{_BFS} SELECT centre, node, distance FROM seen")
def j29_neighbourhood_20(spark, sf_dir):
    return _centres(spark, sf_dir)[0].select("centre", F.concat_ws(":", "label", "key").alias("node"), "distance")


@_query(f"{_BFS} SELECT x.centre, e.src_key, e.rel, e.dst_key FROM edges e JOIN seen x ON x.node = e.src_label || ':' || e.src_key JOIN seen y ON y.centre = x.centre AND y.node = e.dst_label || ':' || e.dst_key WHERE least(x.distance, y.distance) <= 1")
def j29_neighbourhood_edges_20(spark, sf_dir):
    return _centres(spark, sf_dir)[1].select("centre", "src_key", "rel", "dst_key")


@_query(f"{_E},{_NODES} SELECT lower(label) || ':' || key AS id, label, CASE WHEN label = 'ASN' THEN 'AS' || key ELSE substr(coalesce(name, key), 1, 35) END AS text FROM (SELECT * FROM nodes ORDER BY label, key LIMIT 100 OFFSET 50)")
def j30_j31_export_page(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    return g.export_page(_nodes(mails, edges), edges, 50, 100)[0]


@_query(f"{_E},{_NODES} SELECT label, key, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1")
def j32_repeated_keys(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    return g.repeated_keys(_nodes(mails, edges))


_HOPS = "SELECT user_id AS email_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS hop, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts, concat('h', event_id % 50) AS from_host, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('10.0.', event_id % 256, '.1') WHEN 2 THEN concat('8.8.', event_id % 256, '.8') ELSE concat('192.168.1.', event_id % 256) END AS from_ip FROM events"


def _hops(spark, sf_dir):
    return spark.sql(_HOPS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@_query(f"SELECT email_id, hop, round(delay, 6) AS delay_s, coalesce(abs(delay) > 300, false) AS time_skew, ts IS NULL AS timestamp_missing FROM (SELECT *, (epoch_us(ts) - epoch_us(last_value(ts IGNORE NULLS) OVER (PARTITION BY email_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 1e6 AS delay FROM ({_HOPS}))")
def b13_hop_delays(spark, sf_dir):
    return relay.hop_delays(_hops(spark, sf_dir)).select("email_id", "hop", F.round("delay_s", 6).alias("delay_s"), "time_skew", "timestamp_missing")


_N = "(split_part(from_ip, '.', 1)::BIGINT * 16777216 + split_part(from_ip, '.', 2)::BIGINT * 65536 + split_part(from_ip, '.', 3)::BIGINT * 256 + split_part(from_ip, '.', 4)::BIGINT)"
_PUBLIC = "from_ip IS NOT NULL AND NOT (" + " OR ".join(f"{_N} BETWEEN {_v4(net)} AND {_v4(net) + (1 << (32 - bits)) - 1}" for _, net, bits in SPECIAL_V4) + ")"


@_query(f"SELECT email_id, min(hop) FILTER ({_PUBLIC}) AS origin_hop, arg_min(from_ip, hop) FILTER ({_PUBLIC}) AS origin_ip, arg_min(from_host, hop) AS fallback_host, arg_min(from_ip, hop) FILTER (from_ip IS NOT NULL) AS sender_ip, CASE min(hop) FILTER ({_PUBLIC}) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE CASE WHEN min(hop) FILTER ({_PUBLIC}) IS NULL THEN 'none' ELSE 'low' END END AS confidence FROM ({_HOPS}) GROUP BY email_id")
def f1_f2_origins(spark, sf_dir):
    return relay.origins(_hops(spark, sf_dir))


@_query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k")
def k2_bursts(spark, sf_dir):
    return relay.bursts(table(spark, sf_dir, "events"), "user_id")


_SCORED = "SELECT doc_id, toxic AS y, round(((doc_id * 37) % 101) / 101.0::DOUBLE * 0.6::DOUBLE + toxic * 0.4::DOUBLE, 6) AS score FROM labels"


def _scored(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.col("toxic").alias("y"), F.round(((F.col("doc_id") * 37) % 101) / F.lit(101.0) * 0.6 + F.col("toxic") * 0.4, 6).alias("score"))


_CURVE = f"points AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM ({_SCORED}) GROUP BY 1), curve AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM points)"


@_query(f"WITH {_CURVE}, c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y <> 1) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y <> 1) AS tn FROM ({_SCORED})), t AS (SELECT sum(p) AS np, sum(n) AS nn, sum(n * (tp - p / 2)) AS area, sum(p * tp / (tp + fp)) AS ap FROM curve) SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(area / (np * nn), 6) AS roc_auc, round(ap / np, 6) AS pr_auc FROM c, t")
def i11_binary_metrics(spark, sf_dir):
    m = ev.binary_metrics(_scored(spark, sf_dir))
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1", "roc_auc", "pr_auc")))


@_query(f"WITH {_CURVE} SELECT min(score) AS threshold, CAST(max(tp) AS BIGINT) AS tp FROM curve WHERE tp / (tp + fp) >= 0.8")
def i12_best_threshold(spark, sf_dir):
    return ev.best_threshold(_scored(spark, sf_dir), 0.8)


_GUESS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'benign' WHEN 1 THEN 'spam' WHEN 2 THEN 'phishing' WHEN 3 THEN 'bec' ELSE 'impersonation' END AS label, CASE (doc_id + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'benign' WHEN 1 THEN 'spam' WHEN 2 THEN 'phishing' WHEN 3 THEN 'bec' ELSE 'impersonation' END AS guess FROM labels"
_PER = f"conf AS (SELECT label, guess, count(*) AS n FROM ({_GUESS}) GROUP BY ALL), per0 AS (SELECT class, (SELECT coalesce(sum(n), 0) FROM conf WHERE label = class AND guess = class) AS hits, (SELECT coalesce(sum(n), 0) FROM conf WHERE label = class) AS support, (SELECT coalesce(sum(n), 0) FROM conf WHERE guess = class) AS predicted FROM (SELECT DISTINCT label AS class FROM conf)), per AS (SELECT class, hits / predicted AS precision, hits / support AS recall, 2 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support) AS f1, support::BIGINT AS support FROM per0)"


def _guess(spark, sf_dir):
    return spark.sql(_GUESS.replace("FROM labels", "FROM {labels}"), labels=table(spark, sf_dir, "labels"))


@_query(f"WITH {_PER} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per")
def i13_multiclass_metrics(spark, sf_dir):
    m = ev.multiclass_metrics(_guess(spark, sf_dir))
    return m.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@_query(f"WITH {_PER} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS accuracy FROM per")
def i13_averages(spark, sf_dir):
    m = ev.averages(ev.multiclass_metrics(_guess(spark, sf_dir)))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@_query(f"WITH {_PER} SELECT class, precision >= a AND recall >= b AND f1 >= c AS passed FROM per JOIN (VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]})" for k, v in ev.GATES.items()) + ") t(class, a, b, c) USING (class)")
def i14_gates(spark, sf_dir):
    return ev.gates(ev.multiclass_metrics(_guess(spark, sf_dir)))


@_query("SELECT doc_id, CASE WHEN k <= floor(total * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(total * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS total FROM labels)")
def i2_stratified_split(spark, sf_dir):
    return ev.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "split")


@_query(
    f"{_E},{_NODES}, page AS (SELECT concat(lower(label), ':', key) AS source FROM (SELECT label, key FROM nodes ORDER BY label, key LIMIT 100 OFFSET 50)), named AS (SELECT concat(lower(src_label), ':', src_key) AS source, concat(lower(dst_label), ':', dst_key) AS target, rel FROM edges) "
    "SELECT concat('edge:', source, '->', target, ':', rel) AS id, source, target, rel FROM named WHERE source IN (SELECT source FROM page)"
)
def j31_export_page_edges(spark, sf_dir):
    mails, _, _, edges = _graph(spark, sf_dir)
    return g.export_page(_nodes(mails, edges), edges, 50, 100)[1]


@_query(f"{_E},{_NODES} SELECT label, key, count(*) AS n FROM writes GROUP BY ALL HAVING count(*) > 1")
def j32_repeated_writes(spark, sf_dir):
    """The same job on the writes before they are merged, where keys do repeat."""
    mails, _, _, edges = _graph(spark, sf_dir)
    return g.repeated_keys(g.node_writes(mails, edges))
