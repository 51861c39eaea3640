"""Email tables derived from the given tables, in Spark and as the same projection in DuckDB SQL.

An email per document: subject and body from the text, sender domains in groups
of eight, one URL from ``pages``, and authentication results, labels and times
by arithmetic on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Expressions over documents (doc_id, text) that Spark and DuckDB read alike.
EMAIL = {
    "email_id": "concat('email-', cast(doc_id as {string}))",
    "subject": "{subject}",
    "body": "concat(text, case doc_id % 7 when 0 then ' Please verify your account password immediately at http://203.0.113.9/login?u=1 or https://d1.example.net/a. ' when 1 then ' Wire transfer of the invoice is urgent! Reply to pay@bank.example.org, see 198.51.100.7 and 10.1.2.3. ' when 2 then ' Buy a gift card? Cost $5 [192.0.2.44] hash d41d8cd98f00b204e9800998ecf8427e ' else '' end)",
    "sender": "concat(case doc_id % 6 when 0 then '\"PayPal Support\" <alerts@' when 1 then 'Chief Officer <ceo@' when 2 then '<desk@' else 'mail@' end, {domain}, case when doc_id % 6 < 3 then '>' else '' end)",
    "sender_domain": "{domain}",
    "reply_to": "case doc_id % 5 when 0 then 'help@reply.example.org' when 1 then concat('mail@', {domain}) else '' end",
    "return_path": "case doc_id % 4 when 0 then '<bounce@other.example.com>' when 1 then concat('<b@', {domain}, '>') else null end",
    "ts_seconds": "1704067200 + doc_id * 420",
    "spf": "case doc_id % 5 when 0 then 'fail' when 1 then 'softfail' when 2 then 'neutral' when 3 then 'pass' else 'unknown' end",
    "dkim": "case doc_id % 3 when 0 then 'fail' when 1 then 'pass' else 'unknown' end",
    "dmarc": "case doc_id % 4 when 0 then 'fail' when 1 then 'pass' when 2 then 'pass' else 'unknown' end",
    "hash": "{sha}",
    "doc_id": "doc_id",
}
_SPARK = {"string": "string", "domain": "concat('d', cast(floor(doc_id / 8) as string), '.example.net')", "subject": r"array_join(slice(filter(split(text, '[ \\n]+', 8), w -> w <> ''), 1, 6), ' ')", "sha": "sha2(text, 256)"}
_DUCK = {"string": "varchar", "domain": "concat('d', cast(doc_id // 8 as varchar), '.example.net')", "subject": r"array_to_string(regexp_extract_all(text, '[^ \n]+')[1:6], ' ')", "sha": "sha256(text)"}


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per email with its url (from ``pages``), label, risk and indicators."""
    docs, pages, labels = (table(spark, sf_dir, t) for t in ("documents", "pages", "labels"))
    out = docs.select(*(F.expr(e.format(**_SPARK)).alias(c) for c, e in EMAIL.items()))
    n_pages = pages.count()
    urls = pages.select(F.col("page_id").alias("p"), "url")
    out = out.join(urls, F.col("doc_id") % n_pages == F.col("p"), "left").drop("p")
    label = F.expr("case when toxic = 1 then 'phishing' when quality = 1 then 'benign' else 'suspicious' end").alias("classification")
    risk = F.expr("case when toxic = 1 then 0.9D when quality = 1 then 0.1D else 0.5D end").alias("risk_score")
    labelled = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    out = out.join(labelled, "doc_id", "left").select(*(c for c in out.columns), label, risk)
    return out.withColumn("ts", F.timestamp_seconds("ts_seconds"))


EMAILS_SQL = f"""
emails AS (
  SELECT {", ".join(f"d.{c}" for c in EMAIL)}, p.url,
         CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.quality = 1 THEN 'benign' ELSE 'suspicious' END AS classification,
         CASE WHEN l.toxic = 1 THEN 0.9::DOUBLE WHEN l.quality = 1 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS risk_score,
         to_timestamp(d.ts_seconds) AT TIME ZONE 'UTC' AS ts
  FROM (SELECT {", ".join(f"{e.format(**_DUCK)} AS {c}" for c, e in EMAIL.items())} FROM documents) d
  LEFT JOIN pages p ON d.doc_id % (SELECT count(*) FROM pages) = p.page_id
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def resolves(emails: DataFrame) -> DataFrame:
    """domain, ip: three sender domains share an address."""
    d = F.regexp_extract("sender_domain", "d([0-9]+)", 1).try_cast("long")
    k = F.floor(d / 3)
    return emails.select(F.col("sender_domain").alias("domain"), F.concat(F.lit("198.51."), (F.floor(k / 256) % 256).cast("string"), F.lit("."), (k % 256).cast("string")).alias("ip")).distinct()


RESOLVES_SQL = """
resolves AS (
  SELECT DISTINCT sender_domain AS domain, concat('198.51.', ((doc_id // 24) // 256) % 256, '.', (doc_id // 24) % 256) AS ip FROM emails)"""


def iocs(emails: DataFrame) -> DataFrame:
    """email_id, kind, value: what each email contains."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    some = emails.select("email_id", "doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("domain", "url", "hash"))), F.array(host, "url", "hash"))).alias("kind", "value"))
    return some.filter("value <> '' AND NOT (kind = 'domain' AND doc_id % 3 = 0)").select("email_id", "kind", "value").distinct()


IOCS_SQL = """
iocs AS (
  SELECT DISTINCT email_id, kind, value FROM (
    SELECT email_id, doc_id, 'domain' AS kind, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS value FROM emails
    UNION ALL SELECT email_id, doc_id, 'url', url FROM emails
    UNION ALL SELECT email_id, doc_id, 'hash', hash FROM emails)
  WHERE value <> '' AND NOT (kind = 'domain' AND doc_id % 3 = 0))"""

BASE_SQL = "WITH RECURSIVE " + ",".join([EMAILS_SQL, RESOLVES_SQL, IOCS_SQL])
