"""Campaign queries (J9-J22) over the derived emails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import campaigns as c
from ..operators.graph import payload_tables
from ..operators.tables import work_path, written
from ..sources.readers import PAYLOAD, repaired
from ..streaming.ingest import ingest_batch
from ..streaming.store import GraphStore
from .fixtures import BASE_SQL, emails, iocs, resolves


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = written(emails(spark, sf_dir).drop("body"), "mails")
    return written(c.indicator_rows(mails, iocs(mails), resolves(mails)), "indicator-rows")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    return rows, c.members(rows, linked=c.links(rows))


def j9_indicator_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("email_id", "domains", "urls", "hashes", "ips")


def j10_pair_similarity(spark, sf_dir):
    found = c.similar_pairs(_rows(spark, sf_dir))
    return found.select("a", "b", *(F.round(k, 6).alias(k) for k in c.PAIR_WEIGHTS))


def j11_similar_pairs(spark, sf_dir):
    return c.similar_pairs(_rows(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"))


def j12_components(spark, sf_dir):
    return _both(spark, sf_dir)[1].select("email_id", "component")


def j13_campaigns(spark, sf_dir):
    found = c.campaigns(*_both(spark, sf_dir))
    return found.withColumns({k: F.round(k, 6) for k in ("mean_risk", "confidence")})


def payload_documents(spark, sf_dir) -> DataFrame:
    """Each email as an ingest payload in JSON: json."""
    mails = written(emails(spark, sf_dir).drop("body"), "mails")
    held = iocs(mails).groupBy("email_id").agg(*(F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("value")))).alias(f"{k}s") for k in ("domain", "url")), F.collect_list(F.when(F.col("kind") == "hash", F.struct(F.col("value")))).alias("hashes"))
    rows = mails.join(held, "email_id", "left").join(resolves(mails).withColumnRenamed("domain", "sender_domain"), "sender_domain", "left")
    email = F.struct("email_id", "subject", "sender", "sender_domain", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    found = F.struct("domains", "urls", "hashes", F.when(F.col("ip").isNotNull(), F.create_map("ip", "sender_domain")).alias("ip_domain_mapping"))
    return rows.select(F.to_json(F.struct(email.alias("email"), F.struct("spf", "dkim", "dmarc").alias("authentication"), found.alias("iocs"), F.struct("classification", "risk_score", F.lit(0.9).alias("confidence")).alias("detection"))).alias("json"))


def k1_payloads_to_campaigns(spark, sf_dir):
    """JSON payloads, repaired and normalised, to graph tables and campaigns in one job."""
    payloads = payload_documents(spark, sf_dir).select(F.from_json("json", PAYLOAD).alias("p")).select("p.*")
    rows = written(c.indicator_rows(*payload_tables(written(repaired(payloads), "payloads"))), "indicator-rows")
    return c.members(rows, linked=c.links(rows))


def k1_stored_graph(spark, sf_dir):
    """The edges of the keyed store after the payloads came in three batches, the second of them twice."""
    payloads = payload_documents(spark, sf_dir).select(F.from_json("json", PAYLOAD).alias("p"), F.pmod(F.xxhash64("json"), F.lit(3)).alias("batch")).select("p.*", "batch")
    payloads = written(payloads, "payloads")
    store = GraphStore(spark, work_path(spark, "graph-store"), buckets=16)
    for batch in (0, 1, 1, 2):
        ingest_batch(store, payloads.filter(F.col("batch") == batch).drop("batch").withColumn("place", F.lit(0)), batch)
    return store.edges().select("src_label", "src_key", "rel", "dst_label", "dst_key")


def j14_campaign_edges(spark, sf_dir):
    return c.campaign_edges(*_both(spark, sf_dir))


def j15_campaign_details(spark, sf_dir):
    rows, members = _both(spark, sf_dir)
    page = written(c.details(c.campaigns(rows, members), limit=50), "campaign-page")
    return page.join(c.membership(page, members), "campaign_id").select("campaign_id", "email_count", "email_id", F.round("confidence", 6).alias("confidence"))


def j11_low_threshold(spark, sf_dir):
    """Pairs down to 0.3, of which many share no indicator."""
    return c.similar_pairs(_rows(spark, sf_dir), 0.3).select("a", "b", F.round("score", 6).alias("score"))


def j16_telemetry(spark, sf_dir):
    return c.telemetry(*_both(spark, sf_dir)).withColumn("span_hours", F.round("span_hours", 6))


def j20_subject_likeness(spark, sf_dir):
    return c.subject_likeness(*_both(spark, sf_dir)).withColumn("likeness", F.round("likeness", 6))


def j21_confidence(spark, sf_dir):
    parts = (*c.CONFIDENCE_WEIGHTS, "confidence")
    return c.confidence(*_both(spark, sf_dir)).withColumns({k: F.round(k, 6) for k in parts})


def j21_evidence(spark, sf_dir):
    return c.evidence(*_both(spark, sf_dir))


def j22_campaign_report(spark, sf_dir):
    kept = ["campaign_id", "email_count", "infrastructure", "temporal", "behaviour", "content", "level", "attribution"]
    return c.report(*_both(spark, sf_dir)).select(*kept).withColumn("attribution", F.round("attribution", 6)).withColumns({k: F.round(k, 6) for k in kept[2:6]})


QUERIES = {f.__name__: f for f in (j13_campaigns, j9_indicator_rows, j10_pair_similarity, j11_similar_pairs, j11_low_threshold, j12_components, k1_payloads_to_campaigns, k1_stored_graph, j14_campaign_edges, j15_campaign_details, j16_telemetry, j20_subject_likeness, j21_confidence, j21_evidence, j22_campaign_report)}

_ROWS = """
contained AS (SELECT i.email_id, list(DISTINCT r.ip) FILTER (r.ip IS NOT NULL) AS own, bool_or(r.ip IS NULL) AS open FROM iocs i LEFT JOIN resolves r ON r.domain = i.value WHERE i.kind = 'domain' GROUP BY 1),
rowset AS (
  SELECT e.*, coalesce(f.domains, []) AS domains, coalesce(f.urls, []) AS urls, coalesce(f.hashes, []) AS hashes,
         list_sort(list_distinct(list_concat(coalesce(k.own, []), CASE WHEN coalesce(k.open, true) THEN coalesce(s.ips, []) ELSE [] END))) AS ips
  FROM emails e
  LEFT JOIN (SELECT email_id, list_sort(list(value) FILTER (kind = 'domain')) AS domains, list_sort(list(value) FILTER (kind = 'url')) AS urls, list_sort(list(value) FILTER (kind = 'hash')) AS hashes FROM iocs GROUP BY 1) f USING (email_id)
  LEFT JOIN contained k USING (email_id)
  LEFT JOIN (SELECT e.email_id, list(DISTINCT r.ip) AS ips FROM emails e JOIN resolves r ON r.domain = e.sender_domain GROUP BY 1) s USING (email_id)),
ready AS MATERIALIZED (
  SELECT email_id, ts, spf, dmarc, classification, list_concat(urls, hashes) AS payload, ips, list_distinct(list_append(domains, sender_domain)) AS doms,
         list_distinct(list_filter(string_split_regex(lower(subject), '\\s+'), lambda w: w <> '')) AS words
  FROM rowset),
parts AS (
  SELECT x.email_id AS a, y.email_id AS b,
         CASE WHEN len(list_distinct(list_concat(x.payload, y.payload))) > 0 THEN len(list_intersect(x.payload, y.payload)) / len(list_distinct(list_concat(x.payload, y.payload))) ELSE 0.0 END AS ioc,
         (len(list_intersect(x.doms, y.doms)) + len(list_intersect(x.ips, y.ips))) / (len(list_distinct(list_concat(x.doms, y.doms))) + len(list_distinct(list_concat(x.ips, y.ips)))) AS infra0,
         len(list_intersect(x.ips, y.ips)) > 0 OR (len(list_intersect(x.doms, y.doms)) > 0 AND NOT list_has_any(list_intersect(x.doms, y.doms), ['gmail.com', 'outlook.com', 'yahoo.com'])) AS strong,
         CASE WHEN len(list_distinct(list_concat(x.words, y.words))) > 0 THEN len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) ELSE 0.0 END AS subject,
         abs(epoch_us(x.ts) - epoch_us(y.ts)) / 3.6e9 AS hours,
         ((x.spf = y.spf AND x.spf <> 'unknown')::INT + (x.dmarc = y.dmarc AND x.dmarc <> 'unknown')::INT + (x.classification = y.classification)::INT) / 3.0::DOUBLE AS behaviour
  FROM ready x JOIN ready y ON x.email_id < y.email_id),
scored AS (
  SELECT *, CASE WHEN strong THEN greatest(infra0, 0.8::DOUBLE) ELSE infra0 END AS infra,
         CASE WHEN hours <= 1 THEN 1.0::DOUBLE WHEN hours <= 24 THEN 0.85::DOUBLE WHEN hours <= 72 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS temporal
  FROM parts),
pairs AS MATERIALIZED (
  SELECT * FROM (SELECT *, least(1.0, ioc * 0.35::DOUBLE + infra * 0.30::DOUBLE + subject * 0.15::DOUBLE + temporal * 0.10::DOUBLE + behaviour * 0.10::DOUBLE) AS score FROM scored)
  WHERE round(score, 3) >= 0.45)"""

_MEMBERS = """
links AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(u, v) AS (SELECT DISTINCT u, u FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u AS email_id, min(v) AS component FROM reach GROUP BY 1),
ids AS (SELECT component, 'camp-' || substr(sha256(concat_ws(':', component, count(*), sum(('0x' || substr(md5(email_id), 1, 15))::HUGEINT))), 1, 12) AS campaign_id FROM comp GROUP BY 1),
members AS MATERIALIZED (SELECT email_id, component, campaign_id FROM comp JOIN ids USING (component)),
joined AS MATERIALIZED (SELECT r.*, m.campaign_id FROM rowset r JOIN members m USING (email_id)),
flat AS (
  SELECT campaign_id, 'domain' AS kind, unnest(list_distinct(list_append(domains, sender_domain))) AS value FROM joined
  UNION ALL SELECT campaign_id, 'ip', unnest(ips) FROM joined UNION ALL SELECT campaign_id, 'url', unnest(urls) FROM joined UNION ALL SELECT campaign_id, 'hash', unnest(hashes) FROM joined),
used AS (SELECT campaign_id, kind, value, count(*) AS n_emails FROM flat GROUP BY ALL HAVING count(*) >= 2),
camp0 AS (
  SELECT j.*, coalesce(u.shared_domains, []) AS shared_domains, coalesce(u.shared_ips, []) AS shared_ips, coalesce(u.shared_urls, []) AS shared_urls, coalesce(u.shared_hashes, []) AS shared_hashes
  FROM (SELECT campaign_id, count(*) AS email_count, min(ts) AS first_seen, max(ts) AS last_seen, avg(risk_score) AS mean_risk FROM joined GROUP BY 1) j
  LEFT JOIN (SELECT campaign_id, list_sort(list(value) FILTER (kind = 'domain')) AS shared_domains, list_sort(list(value) FILTER (kind = 'ip')) AS shared_ips,
                    list_sort(list(value) FILTER (kind = 'url')) AS shared_urls, list_sort(list(value) FILTER (kind = 'hash')) AS shared_hashes FROM used GROUP BY 1) u USING (campaign_id)),
camp AS (
  SELECT *, least(1.0, greatest(0.4, least(1.0, len(shared_domains) * 0.3::DOUBLE + len(shared_ips) * 0.4::DOUBLE + len(shared_hashes) * 0.3::DOUBLE) * 0.6::DOUBLE + mean_risk * 0.4::DOUBLE)) AS confidence,
         list_filter([CASE WHEN len(shared_domains) > 0 THEN len(shared_domains) || ' shared domain(s)' END, CASE WHEN len(shared_ips) > 0 THEN len(shared_ips) || ' shared address(es)' END,
                      CASE WHEN len(shared_urls) > 0 THEN len(shared_urls) || ' shared link(s)' END, CASE WHEN len(shared_hashes) > 0 THEN len(shared_hashes) || ' shared payload(s)' END,
                      email_count || ' correlated messages'], lambda x: x IS NOT NULL) AS reasons
  FROM camp0),
tele AS (
  SELECT t.*, coalesce(u.n_ip, 0) AS n_ip, coalesce(u.n_domain, 0) AS n_domain, coalesce(u.n_url, 0) AS n_url, coalesce(u.n_hash, 0) AS n_hash
  FROM (SELECT campaign_id, count(*) AS n_emails, count(ts) AS n_times, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span_hours,
               count(*) FILTER (spf IN ('fail', 'softfail')) AS spf_bad, count(*) FILTER (dmarc = 'fail') AS dmarc_bad, count(DISTINCT classification) AS n_classes FROM joined GROUP BY 1) t
  LEFT JOIN (SELECT campaign_id, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'domain') AS n_domain, count(*) FILTER (kind = 'url') AS n_url, count(*) FILTER (kind = 'hash') AS n_hash FROM used GROUP BY 1) u USING (campaign_id)),
subj AS (SELECT j.campaign_id, j.email_id, r.words FROM joined j JOIN ready r USING (email_id) WHERE len(r.words) > 0),
likeness AS (
  SELECT n.campaign_id, n.n::DOUBLE AS n_subjects, coalesce(p.mean, 0.0) AS likeness
  FROM (SELECT campaign_id, count(*) AS n FROM subj GROUP BY 1) n
  LEFT JOIN (SELECT x.campaign_id, avg(len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words)))) AS mean
             FROM subj x JOIN subj y ON x.campaign_id = y.campaign_id AND x.email_id < y.email_id GROUP BY 1) p USING (campaign_id)),
rated0 AS (
  SELECT t.campaign_id, t.n_emails,
         least(1.0, 0.2 + CASE WHEN n_emails >= 2 THEN least(0.35, n_ip * 0.18) + least(0.30, n_domain * 0.15) + least(0.25, n_url * 0.15) + least(0.20, n_hash * 0.15) ELSE 0 END)::DOUBLE AS infrastructure,
         CASE WHEN n_emails < 2 THEN 0.3 WHEN n_times < 2 THEN 0.4 WHEN span_hours <= 2 THEN 0.95 WHEN span_hours <= 24 THEN 0.85 WHEN span_hours <= 72 THEN 0.65 ELSE 0.40 END::DOUBLE AS temporal,
         CASE WHEN n_emails < 2 THEN 0.3 ELSE least(1.0, 0.5 + CASE WHEN spf_bad = n_emails OR dmarc_bad = n_emails THEN 0.35 WHEN spf_bad > 0 THEN 0.2 ELSE 0 END + CASE WHEN n_classes = 1 THEN 0.15 ELSE 0 END) END::DOUBLE AS behaviour,
         CASE WHEN coalesce(l.n_subjects, 0) < 2 THEN 0.3 WHEN l.likeness >= 0.7 THEN 0.90 WHEN l.likeness >= 0.4 THEN 0.65 ELSE 0.35 END::DOUBLE AS content
  FROM tele t LEFT JOIN likeness l USING (campaign_id)),
rated AS (SELECT *, infrastructure * 0.35::DOUBLE + temporal * 0.25::DOUBLE + behaviour * 0.25::DOUBLE + content * 0.15::DOUBLE AS total FROM rated0),
level AS (SELECT *, CASE WHEN total >= 0.9 THEN 'very_high' WHEN total >= 0.7 THEN 'high' WHEN total >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM rated)"""

_R = f"{BASE_SQL},{_ROWS}"
_M = f"{_R},{_MEMBERS}"
_PARTS4 = "round(infrastructure, 6) AS infrastructure, round(temporal, 6) AS temporal, round(behaviour, 6) AS behaviour, round(content, 6) AS content"
SQL = {
    "j9_indicator_rows": f"{_R} SELECT email_id, domains, urls, hashes, ips FROM rowset",
    "j10_pair_similarity": f"{_R} SELECT a, b, round(ioc, 6) AS ioc, round(infra, 6) AS infra, round(subject, 6) AS subject, round(temporal, 6) AS temporal, round(behaviour, 6) AS behaviour FROM pairs",
    "j11_similar_pairs": f"{_R} SELECT a, b, round(score, 6) AS score FROM pairs",
    "j11_low_threshold": f"{_R.replace('round(score, 3) >= 0.45', 'round(score, 3) >= 0.3')} SELECT a, b, round(score, 6) AS score FROM pairs",
    "k1_payloads_to_campaigns": f"""{_M.replace("'url', url FROM emails", "'url', regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?]*)([?]|$)', '\\1/\\2') FROM emails")} SELECT email_id, component, campaign_id FROM members""",
    "k1_stored_graph": f"""{BASE_SQL}, u AS (SELECT email_id, value, regexp_replace(value, '#.*$', '') AS clean FROM iocs WHERE kind = 'url'),
      v AS (SELECT email_id, regexp_replace(clean, '^([a-z]+://[^/?]*)([?]|$)', '\\1/\\2') AS url FROM u)
      SELECT DISTINCT * FROM (
        SELECT 'Email' AS src_label, email_id AS src_key, 'SENT_FROM' AS rel, 'Domain' AS dst_label, sender_domain AS dst_key FROM emails
        UNION ALL SELECT 'Email', email_id, 'CONTAINS_' || upper(kind), CASE kind WHEN 'hash' THEN 'Hash' ELSE 'Domain' END, value FROM iocs WHERE kind <> 'url'
        UNION ALL SELECT 'Email', email_id, 'CONTAINS_URL', 'URL', sha256(url) FROM v
        UNION ALL SELECT 'URL', sha256(url), 'HOSTED_ON_DOMAIN', 'Domain', regexp_replace(regexp_extract(url, '^[a-z]+://([^/?:]*)', 1), '^www\\.', '') FROM v
        UNION ALL SELECT 'Domain', domain, 'RESOLVES_TO', 'IP', ip FROM resolves)""",
    "j12_components": f"{_M} SELECT email_id, component FROM members",
    "j13_campaigns": f"{_M} SELECT campaign_id, email_count, first_seen, last_seen, round(mean_risk, 6) AS mean_risk, shared_domains, shared_ips, shared_urls, shared_hashes, round(confidence, 6) AS confidence, reasons FROM camp",
    "j14_campaign_edges": f"""{_M} SELECT 'Email' AS src_label, email_id AS src_key, 'MEMBER_OF' AS rel, 'Campaign' AS dst_label, campaign_id AS dst_key FROM members
        UNION ALL SELECT 'Campaign', campaign_id, 'USES_' || upper(kind), CASE kind WHEN 'domain' THEN 'Domain' WHEN 'ip' THEN 'IP' WHEN 'url' THEN 'URL' ELSE 'Hash' END, CASE WHEN kind = 'url' THEN sha256(value) ELSE value END FROM used""",
    "j15_campaign_details": f"{_M} SELECT campaign_id, email_count, m.email_id, round(confidence, 6) AS confidence FROM (SELECT * FROM camp ORDER BY confidence DESC, first_seen DESC, campaign_id LIMIT 50) JOIN members m USING (campaign_id)",
    "j16_telemetry": f"{_M} SELECT * REPLACE (round(span_hours, 6) AS span_hours) FROM tele",
    "j20_subject_likeness": f"{_M} SELECT campaign_id, n_subjects, round(likeness, 6) AS likeness FROM likeness",
    "j21_confidence": f"{_M} SELECT campaign_id, n_emails, {_PARTS4}, round(total, 6) AS confidence, level FROM level",
    "j21_evidence": f"""{_M} SELECT campaign_id, list_filter([CASE WHEN n_ip > 0 THEN concat(n_ip, ' shared addresses') END, CASE WHEN n_domain > 0 THEN concat(n_domain, ' shared domains') END, CASE WHEN n_url > 0 THEN concat(n_url, ' shared links') END,
      CASE WHEN n_hash > 0 THEN concat(n_hash, ' shared payloads') END, CASE WHEN span_hours <= 24 THEN 'sent within a day' END, CASE WHEN n_classes = 1 THEN 'one classification' END, CASE WHEN spf_bad > 0 THEN concat(spf_bad, ' failing SPF') END, CASE WHEN dmarc_bad > 0 THEN concat(dmarc_bad, ' failing DMARC') END], lambda x: x IS NOT NULL) AS evidence,
      list_filter([CASE WHEN n_emails < 3 THEN 'few emails' END, CASE WHEN n_times < 2 THEN 'few times known' END, CASE WHEN n_ip + n_hash = 0 THEN 'no shared address or payload' END, 'shared infrastructure is no proof of a common author'], lambda x: x IS NOT NULL) AS limitations FROM tele""",
    "j22_campaign_report": f"{_M} SELECT campaign_id, n_emails AS email_count, {_PARTS4}, level, round(total, 6) AS attribution FROM level",
}
