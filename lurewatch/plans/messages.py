"""Queries of raw messages (A1, A7, A8, B1-B12, B14, B15); the SQL says what each message was made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import messages as m
from .mail_fixtures import MAIL_SQL, messages, raw_message

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{MAIL_SQL} {sql}"
        return f

    return add


def _decoded(spark, sf_dir) -> DataFrame:
    return m.decoded(messages(spark, sf_dir).select("email_id", "content"))


_NUMBER = "CASE WHEN spam_header IS NOT NULL THEN 7.5 WHEN spam_status LIKE 'Yes%' THEN 12.4 WHEN spam_status IS NOT NULL THEN 0.3 END::DOUBLE"


@_query(f"""SELECT email_id, display_name, from_address, [to1, to2] AS "to", reply_to, return_path, trim(subject) AS subject, date, concat('m', doc_id, '@', domain) AS message_id, ['<a@x>', '<b@y>'] AS refs,
  hop_ip AS originating_ip, priority, spam_status, {_NUMBER} AS spam_score, coalesce(reply_to LIKE '%reply.example.org', false) AS reply_to_mismatch,
  coalesce(return_path LIKE '%other.example.com', false) AS return_path_mismatch, coalesce(display_name LIKE '%@%', false) AS display_name_spoofing FROM mail""")
def b1_b7_b11_headers(spark, sf_dir):
    h = m.header_table(_decoded(spark, sf_dir)).withColumnRenamed("references", "refs")
    return h.select("email_id", "display_name", "from_address", "to", "reply_to", "return_path", "subject", "date", "message_id", "refs", "originating_ip", "priority", "spam_status", "spam_score", "reply_to_mismatch", "return_path_mismatch", "display_name_spoofing")


@_query("SELECT email_id, spf, CASE WHEN kind <> 2 THEN dkim END AS dkim, CASE WHEN kind <> 2 THEN dmarc END AS dmarc, 'X-Campaign=c' AS custom FROM mail")
def b5_b10_recorded(spark, sf_dir):
    h = m.header_table(_decoded(spark, sf_dir))
    odd = F.filter(F.map_entries("custom_headers"), lambda e: ~e["key"].isin("X-Priority"))
    custom = F.array_join(F.transform(odd, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return h.select("email_id", F.col("recorded_spf").alias("spf"), F.col("recorded_dkim").alias("dkim"), F.col("recorded_dmarc").alias("dmarc"), custom.alias("custom"))


@_query("""SELECT email_id, md5(text) AS plain_md5, CASE WHEN kind = 1 THEN concat('<p>', from_address, '</p>') END AS html, (kind = 1)::INT AS n_attachments FROM mail""")
def b6_b8_bodies(spark, sf_dir):
    return _decoded(spark, sf_dir).select("email_id", F.md5("text_plain").alias("plain_md5"), F.col("text_html").alias("html"), F.size("attachments").alias("n_attachments"))


@_query("""SELECT email_id, 1 AS n, filename, 'application/octet-stream' AS content_type, octet_length(encode(concat(filename, text))) AS size, md5(concat(filename, text)) AS md5, sha1(concat(filename, text)) AS sha1, sha256(concat(filename, text)) AS sha256,
  doc_id % 5 = 0 AS executable, doc_id % 5 = 1 AS archive, doc_id % 5 = 2 AS office FROM mail WHERE kind = 1""")
def b8_b9_attachments(spark, sf_dir):
    return m.attachment_table(_decoded(spark, sf_dir))


_HOPS = """SELECT email_id, 1 AS hop, '[192.168.0.7]' AS from_host, '192.168.0.7' AS from_ip, 'edge' AS by_host, 'SMTP' AS protocol, concat('q1-', doc_id) AS queue_id, NULL AS for_address, CASE WHEN doc_id % 5 <> 0 THEN iso1 END AS ts, NULL::DOUBLE AS delay_s,
  CASE WHEN doc_id % 5 = 0 THEN ['private_ip', 'timestamp_missing'] ELSE ['private_ip'] END AS flags FROM mail
UNION ALL SELECT email_id, 2, 'edge', '10.1.2.3', 'relay2.example.org', 'HTTP', concat('q2-', doc_id), NULL, iso2, CASE WHEN doc_id % 5 <> 0 THEN 30.0 END, ['private_ip', 'protocol_mismatch'] FROM mail
UNION ALL SELECT email_id, 3, 'relay2.example.org', hop_ip, 'mx.corp.example', 'ESMTPS', concat('q3-', doc_id), to1, iso3, late, CASE WHEN late > 300 THEN ['time_skew'] ELSE [] END FROM mail"""


@_query(_HOPS)
def b12_b15_relay_path(spark, sf_dir):
    h = m.relay_path(_decoded(spark, sf_dir))
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")
    return h.select("email_id", "hop", "from_host", "from_ip", "by_host", "protocol", "queue_id", "for_address", ts, "delay_s", "flags")


@_query("""SELECT concat('<m', doc_id, '@', domain, '>') AS email_id, domain AS from_domain, regexp_extract(reply_to, '@(.*)$', 1) AS reply_to_domain, regexp_extract(return_path, '@(.*)$', 1) AS return_path_domain, md5(trim(subject)) AS subject_md5, length(trim(text)) AS body_length,
  CASE WHEN kind = 2 THEN '' ELSE spf END AS spf, CASE WHEN kind = 2 THEN '' ELSE dmarc END AS dmarc, (kind = 1)::INT AS attachment_count, (kind = 1 AND doc_id % 5 = 0)::INT AS executable_attachments, '' AS urls FROM mail""")
def a7_a8_ml_rows(spark, sf_dir):
    r = m.ml_rows(m.mail_rows(_decoded(spark, sf_dir)))
    return r.select("email_id", "from_domain", "reply_to_domain", "return_path_domain", F.md5("subject").alias("subject_md5"), F.length(F.trim("body")).alias("body_length"), "spf", "dmarc", "attachment_count", "executable_attachments", "urls")


@_query("SELECT email_id, CASE WHEN length(raw) > 0 THEN false END AS failed, sha256(raw) AS sha256, octet_length(encode(raw)) AS size FROM (SELECT email_id, " + raw_message(False) + " AS raw FROM mail)")
def a1_raw_messages(spark, sf_dir):
    return _decoded(spark, sf_dir).select("email_id", F.col("error").isNotNull().alias("failed"), "sha256", "size")
