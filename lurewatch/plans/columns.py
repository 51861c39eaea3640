"""Queries of the column functions: normalisation (D), indicators (C), features (H) and scores (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import indicators as ind
from ..functions import normalize as norm
from ..functions import scoring as sc
from ..operators.suffixes import split_hosts
from .fixtures import BASE_SQL, emails, table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PAGES = "SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN upper(url) WHEN 1 THEN concat(' ', url, ' ') ELSE replace(url, 'http://', '') END) AS raw FROM pages"


def _raw(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr("CASE page_id % 3 WHEN 0 THEN upper(url) WHEN 1 THEN concat(' ', url, ' ') ELSE replace(url, 'http://', '') END").alias("raw"))


_DOMAIN = r"split_part(split_part(regexp_replace(lower(trim({})), '^[a-z][a-z0-9+.-]*://', ''), '/', 1), ':', 1)"


@_query(f"SELECT page_id, {_DOMAIN.format('raw')} AS domain, regexp_replace({_DOMAIN.format('raw')}, '^www\\.', '') AS url_domain FROM ({_PAGES})")
def d1_normalize_domain(spark, sf_dir):
    return _raw(spark, sf_dir).select("page_id", norm.domain(F.col("raw")).alias("domain"), norm.url_domain(F.col("raw")).alias("url_domain"))


_IPS = "SELECT event_id, concat(CASE WHEN event_id % 7 = 0 THEN ' ' ELSE '' END, event_id % 300, '.', user_id % 256, '.', event_id % 256, '.', user_id % 270) AS raw FROM events"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _ips(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("concat(CASE WHEN event_id % 7 = 0 THEN ' ' ELSE '' END, event_id % 300, '.', user_id % 256, '.', event_id % 256, '.', user_id % 270)").alias("raw"))


@_query(f"SELECT event_id, CASE WHEN regexp_matches(trim(raw), '^({_OCTET}\\.){{3}}{_OCTET}$') THEN trim(raw) END AS ip FROM ({_IPS})")
def d2_normalize_ip(spark, sf_dir):
    return _ips(spark, sf_dir).select("event_id", norm.ip(F.col("raw")).alias("ip"))


_FULL = r"CASE WHEN regexp_matches(trim(raw), '^[A-Za-z][A-Za-z0-9+.-]*://') THEN trim(raw) ELSE concat('http://', trim(raw)) END"
_PART = r"regexp_extract(full_url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', {})"
_URL = f"concat(lower({_PART.format(1)}), '://', lower({_PART.format(2)}), CASE WHEN {_PART.format(3)} = '' THEN '/' ELSE {_PART.format(3)} END, CASE WHEN {_PART.format(4)} = '?' THEN '' ELSE {_PART.format(4)} END)"


@_query(f"SELECT page_id, {_URL} AS url FROM (SELECT page_id, {_FULL} AS full_url FROM ({_PAGES}))")
def d3_normalize_url(spark, sf_dir):
    return _raw(spark, sf_dir).select("page_id", norm.url(F.col("raw")).alias("url"))


@_query("SELECT page_id, sha256(url) AS url_hash FROM pages")
def d4_url_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", norm.url_hash(F.col("url")).alias("url_hash"))


_HASHES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN sha256(text) WHEN 2 THEN sha1(text) WHEN 3 THEN concat(' ', md5(text)) ELSE concat('x', md5(text)) END AS raw FROM documents"
_CLEAN = "CASE WHEN regexp_matches(lower(trim(raw)), '^[a-f0-9]+$') THEN lower(trim(raw)) END"


@_query(f"SELECT doc_id, hash, CASE length(hash) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' WHEN 128 THEN 'sha512' ELSE 'unknown' END AS type FROM (SELECT doc_id, {_CLEAN} AS hash FROM ({_HASHES}))")
def d5_d11_hashes(spark, sf_dir):
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN sha2(text, 256) WHEN 2 THEN sha1(text) WHEN 3 THEN concat(' ', md5(text)) ELSE concat('x', md5(text)) END")
    hashed = table(spark, sf_dir, "documents").select("doc_id", norm.hash_value(raw).alias("hash"))
    return hashed.withColumn("type", norm.hash_type(F.col("hash")))


@_query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS iso, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS ts FROM events")
def d6_normalize_timestamp(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", norm.iso(raw).alias("iso"), norm.timestamp(raw).alias("ts"))


@_query(f"{BASE_SQL} SELECT email_id, lower(regexp_extract(sender, '@([A-Za-z0-9.-]+)[^@]*$', 1)) AS domain, CASE WHEN reply_to = '' THEN ['a@x.org'] ELSE ['a@x.org', reply_to] END AS recipients, CASE WHEN trim(spf) = '' THEN 'unknown' ELSE lower(trim(spf)) END AS spf FROM emails", )
def d7_d8_email_defaults(spark, sf_dir):
    mails = emails(spark, sf_dir)
    to = norm.recipients(F.array(F.lit("a@x.org")), F.col("reply_to"))
    return mails.select("email_id", norm.address_domain(F.col("sender")).alias("domain"), to.alias("recipients"), norm.auth_status(F.concat(F.lit(" "), F.upper("spf"))).alias("spf"))


@_query("SELECT page_id, [url, concat('u', page_id)] AS values FROM pages")
def d9_ioc_items(spark, sf_dir):
    items = F.array(F.to_json(F.struct(F.col("url").alias("value"), F.lit("body").alias("source"))), F.concat(F.lit("u"), "page_id"), F.lit("{}"))
    return table(spark, sf_dir, "pages").select("page_id", norm.ioc_values(items).alias("values"))


@_query(f"SELECT page_id, u AS value, regexp_replace({_DOMAIN.format('u')}, '^www\\.', '') AS domain, sha256(u) AS url_hash FROM (SELECT page_id, {_URL} AS u FROM (SELECT page_id, {_FULL} AS full_url FROM ({_PAGES})))")
def d10_url_record(spark, sf_dir):
    return _raw(spark, sf_dir).select("page_id", norm.url_record(F.col("raw")).alias("r")).select("page_id", "r.*")


@_query("SELECT event_id, greatest(0.0, least(1.0, coalesce(value / 50 - 0.2, 0.0)))::DOUBLE AS score, CASE WHEN value / 50 - 0.2 > 0.6 THEN 'phishing' ELSE 'suspicious' END AS classification, CASE WHEN value / 50 - 0.2 > 0.6 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM events")
def d12_d13_detection(spark, sf_dir):
    risk = F.col("value") / 50 - 0.2
    return table(spark, sf_dir, "events").select("event_id", norm.detection(risk).alias("d")).select("event_id", F.col("d.risk_score").alias("score"), "d.classification", "d.confidence")


_URLRE = ind.URL_PATTERN.replace("'", "''")


@_query(f"{BASE_SQL} SELECT email_id, list_distinct_ordered AS urls FROM (SELECT email_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS list_distinct_ordered FROM (SELECT email_id, regexp_extract_all(body, '{_URLRE}') AS u FROM emails))")
def c1_urls_in_text(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", ind.urls_in_text(F.col("body")).alias("urls"))


_HTML = f"""
SELECT page_id, list_filter(u, lambda x: NOT list_has_any([true], list_transform(u, lambda o: o <> x AND starts_with(o, x)))) AS urls FROM (
  SELECT page_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS u FROM (
    SELECT page_id, list_filter(list_transform(list_concat(regexp_extract_all(html, '(?i)\\b(?:href|src|action)\\s*=\\s*["'']?([^"''\\s>]+)', 1), regexp_extract_all(html, '{_URLRE}')),
      lambda x: replace(replace(regexp_replace(trim(x), '^(?i)hxxp', 'http'), '[.]', '.'), '&amp;', '&')), lambda x: regexp_matches(x, '^https?://')) AS u
    FROM (SELECT page_id, concat(html, ' <a href="', url, '"> hxxp <img src=''', url, '/x.png''>') AS html FROM pages)))"""


@_query(_HTML)
def c2_c3_urls_in_html(spark, sf_dir):
    html = F.expr("concat(html, ' <a href=\"', url, '\"> hxxp <img src=\\'', url, '/x.png\\'>')")
    return table(spark, sf_dir, "pages").select("page_id", ind.urls_in_html(html).alias("urls"))


_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@_query(f"SELECT user_id, value, CASE min(p) WHEN 1 THEN 'view' WHEN 2 THEN 'click' ELSE 'other' END AS source FROM (SELECT user_id, event_id % 97 AS value, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM events) GROUP BY ALL")
def c4_first_source(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 97).alias("value"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("other").alias("source"))
    return ind.first_source(found, "user_id", "value", ("view", "click", "other"))


@_query(rf"SELECT page_id, url, split_part(url, ':', 1) AS scheme, array_to_string(string_split(h, '.')[-2:], '.') AS domain, concat(replace(split_part(url, '://', 1), 'http', 'hxxp'), '://', replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '[.]'), regexp_extract(url, '://[^/?#]*(.*)$', 1)) AS defanged FROM (SELECT page_id, url, {_HOST.format('url')} AS h FROM pages)")
def c5_c7_url_record(spark, sf_dir):
    r = table(spark, sf_dir, "pages").select("page_id", ind.url_record(F.col("url"), F.lit("body")).alias("r"))
    return r.select("page_id", "r.url", "r.scheme", "r.domain", "r.defanged")


@_query(r"SELECT page_id, regexp_matches(url, '^https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') OR regexp_matches(lower(url), 'login|verify|secure|account|update|confirm|banking|paypal|signin|password|credential|suspend|unlock|alert|invoice|wire') OR length(url) > 200 OR regexp_matches(url, '^https?://[^/?#]*\.(tk|ml|ga|cf|gq|xyz|top|work|click|link|info|online|site|pw)([/?#]|$)') AS suspicious FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(url, '/login') WHEN 1 THEN replace(url, 'example.com', 'example.top') WHEN 2 THEN concat('http://203.0.113.', page_id % 250, '/a') ELSE url END AS url FROM pages)")
def c6_suspicious_url(spark, sf_dir):
    url = F.expr("CASE page_id % 5 WHEN 0 THEN concat(url, '/login') WHEN 1 THEN replace(url, 'example.com', 'example.top') WHEN 2 THEN concat('http://203.0.113.', page_id % 250, '/a') ELSE url END")
    return table(spark, sf_dir, "pages").select("page_id", ind.is_suspicious_url(url).alias("suspicious"))


_V4RE = ind.IPV4_PATTERN


@_query(f"{BASE_SQL} SELECT email_id, list_sort(list_distinct(list_concat(regexp_extract_all(body, '\\[([0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}})\\]', 1), regexp_extract_all(body, '{_V4RE}')))) AS ips FROM emails")
def c8_ips_in_text(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", ind.ips_in_text(F.col("body")).alias("ips"))


_NUM = "(split_part(raw, '.', 1)::BIGINT * 16777216 + split_part(raw, '.', 2)::BIGINT * 65536 + split_part(raw, '.', 3)::BIGINT * 256 + split_part(raw, '.', 4)::BIGINT)"
_CLASS = " ".join(f"WHEN n BETWEEN {ind._v4(net)} AND {ind._v4(net) + (1 << (32 - bits)) - 1} THEN '{kind}'" for kind, net, bits in ind.SPECIAL_V4)
_ADDR = "concat(CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 127 WHEN 2 THEN 192 ELSE event_id % 256 END, '.', CASE WHEN event_id % 6 = 2 THEN 168 ELSE user_id % 256 END, '.', event_id % 256, '.', user_id % 256)"


@_query(f"SELECT event_id, CASE {_CLASS} ELSE 'public' END AS class FROM (SELECT event_id, {_NUM} AS n FROM (SELECT event_id, {_ADDR} AS raw FROM events))")
def c10_ip_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ind.ip_class(F.expr(_ADDR)).alias("class"))


@_query(f"{BASE_SQL} SELECT email_id, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(body, '{_URLRE}'), lambda u: {_HOST.format('u')}), list_transform(regexp_extract_all(body, '{ind.ADDRESS_PATTERN.replace(chr(39), chr(39) * 2)}'), lambda a: lower(regexp_extract(a, '@(.*)$', 1)))))) AS domains FROM emails")
def c11_domains_in_text(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", F.array_sort(ind.domains_in_text(F.col("body"))).alias("domains"))


_LABEL = "concat(CASE doc_id % 6 WHEN 0 THEN 'paypa1-secure' WHEN 1 THEN 'g00gle' WHEN 2 THEN 'micros0ft' WHEN 3 THEN 'apps.microsoft' WHEN 4 THEN 'netfl' ELSE 'garden' END, CASE WHEN doc_id % 12 = 4 THEN 'ixx' ELSE '' END, CASE doc_id % 2 WHEN 0 THEN '.com' ELSE '.com' END)"


@_query(f"SELECT doc_id, domain, CASE doc_id % 6 WHEN 3 THEN false WHEN 5 THEN false WHEN 4 THEN doc_id % 12 = 4 OR levenshtein('netfl', 'netflix') <= 2 ELSE true END AS typosquat, regexp_matches(domain, '[{ind.HOMOGLYPHS}]') AS homoglyph, translate(domain, '10354@8', 'loesaab') AS leet FROM (SELECT doc_id, {_LABEL} AS domain FROM documents)")
def c13_c16_lookalikes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LABEL).alias("domain"))
    return d.select("doc_id", "domain", ind.is_typosquat(F.col("domain")).alias("typosquat"), ind.has_homoglyph(F.col("domain")).alias("homoglyph"), ind.leet(F.col("domain")).alias("leet"))


@_query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def c17_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ind.fingerprints(F.col("text")).alias("f")).select("doc_id", "f.*")


@_query(f"""{BASE_SQL} SELECT email_id, list_sort(list_distinct(list_transform(regexp_extract_all(body, 'https?://[^\\s<>"'']+'), lambda u: rtrim(u, '.,;:)]}}')))) AS urls, list_sort(list_distinct(regexp_extract_all(body, '{_V4RE}'))) AS ips,
  list_sort(list_distinct(list_transform(regexp_extract_all(body, '\\b[a-fA-F0-9]{{32}}\\b'), lambda x: lower(x)))) AS hashes FROM emails""")
def c18_fallback(spark, sf_dir):
    f = emails(spark, sf_dir).select("email_id", ind.fallback(F.col("body")).alias("f"))
    return f.select("email_id", *(F.array_sort(f"f.{c}").alias(c) for c in ("urls", "ips", "hashes")))


def _mails(spark, sf_dir) -> DataFrame:
    mails = emails(spark, sf_dir)
    extra = {"urls": F.array_distinct(F.concat(F.array("url"), ind.urls_in_text(F.col("body")))), "executable_attachments": (F.col("doc_id") % 11 == 0).cast("int"), "html_destination_mismatch": (F.col("doc_id") % 13 == 0).cast("int"), "attachment_count": F.col("doc_id") % 3}
    return mails.withColumns(extra)


def _features(spark, sf_dir) -> DataFrame:
    return feat.extract(_mails(spark, sf_dir), "email_id", "doc_id")


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _hits(words) -> str:
    return "(" + " + ".join(f"contains(lower(combined), '{w}')::INT" for w in words) + ")::DOUBLE"


def _left(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


_DOM = r"lower(regexp_extract({}, '@([a-zA-Z0-9.\-]+)[^@]*$', 1))"
_ENT = "-list_sum(list_transform(list_distinct(string_split(u, '')), lambda c: ((length(u) - length(replace(u, c, ''))) / length(u)) * log2((length(u) - length(replace(u, c, ''))) / length(u))))"
_TLD = "(" + "|".join(t.replace(".", r"\.") for t in feat.TLDS) + ")$"
_PARTS = {
    **{c: "length(body)::DOUBLE" for c in ("text_length", "body_length", "body_char_count")},
    "subject_length": "length(subject)::DOUBLE", "combined_length": "length(combined)::DOUBLE", "word_count": "len(words)::DOUBLE",
    "subject_word_count": "len(list_filter(string_split_regex(subject, '\\s+'), lambda w: w <> ''))::DOUBLE",
    "uppercase_ratio": _left("body", "[^\\p{Lu}]") + " / greatest(length(body), 1)", "digit_ratio": _left("body", "[^\\p{Nd}]") + " / greatest(length(body), 1)", "space_ratio": _left("body", "[^ ]") + " / greatest(length(body), 1)",
    "exclamation_count": _left("body", "[^!]") + "::DOUBLE", "question_count": _left("body", "[^?]") + "::DOUBLE", "dollar_sign_count": _left("body", "[^$]") + "::DOUBLE", "at_sign_count": _left("body", "[^@]") + "::DOUBLE",
    "readability_flesch": "CASE WHEN len(words) > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (len(words) / sentences) - 84.6::DOUBLE * (syllables / len(words)) ELSE 0 END",
    "readability_grade": "CASE WHEN len(words) > 0 THEN 0.39::DOUBLE * (len(words) / sentences) + 11.8::DOUBLE * (syllables / len(words)) - 15.59::DOUBLE ELSE 0 END",
    "urgency_keyword_hits": _hits(feat.URGENCY), "financial_keyword_hits": _hits(feat.FINANCIAL), "credential_keyword_hits": _hits(feat.CREDENTIAL),
    "subject_has_re": "starts_with(lower(subject), 're:')::INT::DOUBLE", "subject_has_fwd": "regexp_matches(lower(subject), '^fwd?:')::INT::DOUBLE",
    "subject_all_caps": "(length(subject) > 3 AND regexp_matches(subject, '\\p{Lu}') AND NOT regexp_matches(subject, '\\p{Ll}'))::INT::DOUBLE",
    "lexical_diversity": "CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / len(words) ELSE 0 END",
    "url_count": "len(urls)::DOUBLE", "has_http_only_url": "list_bool_or(list_transform(urls, lambda u: starts_with(u, 'http://')))::INT::DOUBLE",
    "https_ratio": "len(list_filter(urls, lambda u: starts_with(u, 'https://'))) / len(urls)",
    "ip_based_urls": "len(list_filter(urls, lambda u: regexp_matches(u, '^https?://[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')))::DOUBLE",
    "punycode_urls": "len(list_filter(urls, lambda u: contains(lower(u), 'xn--')))::DOUBLE",
    "has_credentials_in_url": "list_bool_or(list_transform(urls, lambda u: regexp_matches(u, 'https?://[^@]+:[^@]+@')))::INT::DOUBLE",
    "url_entropy": f"round(list_avg(list_transform(urls, lambda u: {_ENT})), 4)", "url_avg_length": "list_avg(list_transform(urls, lambda u: length(u)))",
    "url_subdomain_count": "list_avg(list_transform(urls, lambda u: greatest(0, len(string_split(split_part(split_part(regexp_replace(u, 'https?://', ''), '/', 1), ':', 1), '.')) - 2)))",
    "suspicious_tld_count": f"len(list_filter(urls, lambda u: regexp_matches(split_part(lower(u), '?', 1), '{_TLD}')))::DOUBLE",
    "url_has_query_params": "list_bool_or(list_transform(urls, lambda u: contains(u, '?')))::INT::DOUBLE",
    **{f"{c}_{v}": f"({c} = '{v}')::INT::DOUBLE" for c, vs in (("spf", ("pass", "fail", "softfail", "neutral")), ("dkim", ("pass", "fail")), ("dmarc", ("pass", "fail"))) for v in vs},
    "arc_pass": "0.0::DOUBLE", "auth_all_pass": "(spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass')::INT::DOUBLE", "auth_all_fail": "(spf = 'fail' AND dkim = 'fail' AND dmarc = 'fail')::INT::DOUBLE",
    "auth_inconsistency": "(spf = 'pass' AND dmarc = 'fail')::INT::DOUBLE",
    "reply_to_mismatch": "(own <> '' AND reply <> '' AND own <> reply)::INT::DOUBLE", "from_equals_reply_to": "(own <> '' AND (reply = '' OR own = reply))::INT::DOUBLE",
    "return_path_mismatch": "(own <> '' AND back <> '' AND own <> back)::INT::DOUBLE", "from_domain_present": "(own <> '')::INT::DOUBLE",
    "display_name_length": "length(display)::DOUBLE", "display_name_privileged": _has("lower(display)", feat.TITLES) + "::INT::DOUBLE",
    "display_name_domain_mismatch": f"(display <> '' AND own <> '' AND {_has('lower(display)', feat.IMPERSONATED)} AND NOT {_has('own', feat.IMPERSONATED)})::INT::DOUBLE",
    "subject_urgency": _has("lower(subject)", feat.SUBJECT_URGENCY) + "::INT::DOUBLE", "body_wire_transfer_mention": _has("lower(body)", ("wire transfer", "wire the")) + "::INT::DOUBLE",
    "body_gift_card_mention": "contains(lower(body), 'gift card')::INT::DOUBLE", "body_payroll_mention": _has("lower(body)", ("payroll", "direct deposit")) + "::INT::DOUBLE",
    "reply_to_different_domain": "(own <> '' AND reply <> '' AND own <> reply)::INT::DOUBLE",
    "attachment_count": "(doc_id % 3)::DOUBLE", "executable_attachments": "(doc_id % 11 = 0)::INT::DOUBLE", "html_destination_mismatch": "(doc_id % 13 = 0)::INT::DOUBLE",
    **{c: "0.0::DOUBLE" for c in ("header_risk_tally", "header_findings_count", "received_hop_count", "ip_count", "private_ips", "html_link_count", "evidence_tally")},
}
_FEATURES = f"""{BASE_SQL},
m0 AS (SELECT email_id, doc_id, trim(body) AS body, trim(subject) AS subject, trim(subject) || ' ' || trim(body) AS combined, spf, dkim, dmarc, {_DOM.format("sender")} AS own, {_DOM.format("reply_to")} AS reply, {_DOM.format("coalesce(return_path, '')")} AS back,
  trim(replace(regexp_extract(sender, '^([^<]*)<', 1), '"', '')) AS display, list_filter(string_split_regex(lower(trim(body)), '\\s+'), lambda w: w <> '') AS words,
  list_filter(u, lambda x, i: list_position(u, x) = i) AS urls FROM (SELECT *, list_prepend(url, regexp_extract_all(body, '{_URLRE}')) AS u FROM emails)),
m AS (SELECT *, greatest(len(regexp_extract_all(body, '[.!?]+')), 1) AS sentences, greatest(len(regexp_extract_all(lower(body), '[aeiouy]+')), len(words)) AS syllables FROM m0),
feats AS (SELECT email_id, doc_id, {", ".join(f"{e} AS {c}" for c, e in _PARTS.items())} FROM m)"""


@_query(f"{_FEATURES} SELECT email_id, {', '.join(f'round({c}, 6) AS {c}' for c in _PARTS)} FROM feats")
def h_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("email_id", *(F.round(c, 6).alias(c) for c in f.columns[2:]))


_HEUR = "greatest(0.0, least(0.9, spf_fail * 0.15::DOUBLE + dkim_fail * 0.15::DOUBLE + dmarc_fail * 0.15::DOUBLE + least(0.15::DOUBLE, url_count * 0.05::DOUBLE) + ip_based_urls * 0.15::DOUBLE + reply_to_mismatch * 0.10::DOUBLE + least(0.15::DOUBLE, urgency_keyword_hits * 0.03::DOUBLE + credential_keyword_hits * 0.05::DOUBLE)))"
_HEURS = f"{_FEATURES}, t AS (SELECT *, {_HEUR}::DOUBLE AS threat FROM feats), heur AS (SELECT *, round(1.0::DOUBLE - threat, 4) AS benign, round(threat * 0.2::DOUBLE, 4) AS spam, round(threat * 0.5::DOUBLE, 4) AS phishing, round(threat * 0.15::DOUBLE, 4) AS bec, round(threat * 0.15::DOUBLE, 4) AS impersonation FROM t)"


@_query(f"{_HEURS} SELECT email_id, benign, spam, phishing, bec, impersonation FROM heur")
def g11_heuristic(spark, sf_dir):
    return _features(spark, sf_dir).select("email_id", *(c.alias(k) for k, c in sc.heuristic().items()))


_LEVEL = "CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
_POINT = " + ".join(f"CASE WHEN {k} {'> 0' if k in ('ip_based_urls', 'executable_attachments') else '= 1'} THEN {v} ELSE 0 END" for k, v in list(sc.POINTS.items())[:13])


@_query(f"""{_HEURS}, n AS (SELECT *, benign + spam + phishing + bec + impersonation AS total FROM heur),
s AS (SELECT *, least(100.0, greatest(0.0, least(1.0, 1.0 - benign / total)) * 70.0 + least(50.0, {_POINT}))::DOUBLE AS score, greatest(benign, spam, phishing, bec, impersonation) AS top FROM n)
SELECT email_id, CASE top WHEN benign THEN 'benign' WHEN spam THEN 'spam' WHEN phishing THEN 'phishing' WHEN bec THEN 'bec' ELSE 'impersonation' END AS label, round(top / total, 6) AS confidence, round(score, 6) AS score, {_LEVEL.format("round(score, 9)")} AS level FROM s""")
def g8_risk_score(spark, sf_dir):
    f = _features(spark, sf_dir).withColumns(sc.heuristic())
    a = f.select("email_id", sc.assessment({k: F.col(k) for k in sc.CLASSES}).alias("a"))
    return a.select("email_id", "a.label", F.round("a.confidence", 6).alias("confidence"), F.round("a.score", 6).alias("score"), sc.level(F.round("a.score", 9)).alias("level"))


@_query()
def g8_reasons(spark, sf_dir):
    f = _features(spark, sf_dir).withColumns(sc.heuristic())
    return f.select("email_id", sc.assessment({k: F.col(k) for k in sc.CLASSES})["reasons"].alias("reasons"))


@_query(f"SELECT event_id, round(least(100.0, greatest(0.0, value)), 6) AS score, {_LEVEL.format('least(100.0, greatest(0.0, value))')} AS category, {_LEVEL.format('fused')} AS fused_category, round(fused, 6) AS fused FROM (SELECT event_id, value, least(100.0, greatest(0.0, (0.5::DOUBLE * ((event_id % 100) / 100) + 0.5::DOUBLE * least(1.0, greatest(0.0, value / 100.0::DOUBLE))) * 100)) AS fused FROM events)")
def g13_tally(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", sc.tally_score(F.col("value"), digits=6).alias("t"), sc.fused_score((F.col("event_id") % 100) / 100, F.col("value"), digits=6).alias("f"))
    return t.select("event_id", "t.score", "t.category", F.col("f.category").alias("fused_category"), F.col("f.score").alias("fused"))


@_query(f"{BASE_SQL} SELECT email_id, list_concat(CASE classification WHEN 'phishing' THEN ['T1566.002', 'T1071.001'] ELSE [] END, CASE WHEN doc_id % 11 = 0 THEN ['T1566.001'] ELSE [] END) AS techniques FROM emails")
def g14_techniques(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", sc.techniques(F.col("classification"), (F.col("doc_id") % 11 == 0).cast("int")).alias("techniques"))


#: An IPv6 address from a digest of the event's content: its first group is any number, of every fifth one of the documentation range.
_V6 = "CASE WHEN substr(d, 5, 1) < '3' THEN concat('2001:db8:', substr(d, 6, 4), '::', substr(d, 10, 2)) ELSE concat(substr(d, 1, 4), ':', substr(d, 6, 3), '::', substr(d, 10, 4)) END"


@_query(f"""SELECT event_id, ip, CASE WHEN substr(d, 5, 1) < '3' OR g BETWEEN {0xfc00} AND {0xfdff} OR g BETWEEN {0xfe80} AND {0xfebf} THEN 'private' WHEN g BETWEEN {0x1000} AND {0x3fff} OR g BETWEEN {0xfe00} AND {0xfeff} THEN 'public' ELSE 'reserved' END AS class
  FROM (SELECT *, ('0x' || substr(d, 1, 4))::INT AS g, {_V6} AS ip FROM (SELECT event_id, md5(concat(event_type, props, event_id)) AS d FROM events))""")
def c10_ipv6_class(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.md5(F.concat("event_type", "props", F.col("event_id").cast("string"))).alias("d"))
    found = d.select("event_id", F.expr(_V6).alias("ip"))
    return found.select("event_id", "ip", ind.ip_class(F.col("ip")).alias("class"))


_FOUND_IPS = f"SELECT email_id, unnest(list_concat(regexp_extract_all(body, '\\[([0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}})\\]', 1), regexp_extract_all(body, '{_V4RE}'))) AS ip, 'body' AS source, 3 AS p FROM emails"


@_query(f"{BASE_SQL}, f AS ({_FOUND_IPS} UNION ALL SELECT email_id, concat('198.51.100.', doc_id % 9), 'header', 2 FROM emails UNION ALL SELECT email_id, CASE doc_id % 2 WHEN 0 THEN '10.1.2.3' ELSE '198.51.100.3' END, 'smtp_path', 1 FROM emails) SELECT email_id, ip, arg_min(source, p) AS source FROM f GROUP BY email_id, ip")
def c9_ip_sources(spark, sf_dir):
    mails = emails(spark, sf_dir)
    body = mails.select("email_id", F.explode(ind.ips_in_text(F.col("body"))).alias("ip"), F.lit("body").alias("source"))
    header = mails.select("email_id", F.concat(F.lit("198.51.100."), (F.col("doc_id") % 9).cast("string")).alias("ip"), F.lit("header").alias("source"))
    path = mails.select("email_id", F.when(F.col("doc_id") % 2 == 0, "10.1.2.3").otherwise("198.51.100.3").alias("ip"), F.lit("smtp_path").alias("source"))
    return ind.first_source(body.unionByName(header).unionByName(path), "email_id", "ip", ("smtp_path", "header", "body"))


_SUFFIXED = "CASE page_id % 3 WHEN 0 THEN concat(h, '.co.uk') WHEN 1 THEN h ELSE split_part(h, '.', 1) END"


@_query(f"SELECT page_id, host, CASE page_id % 3 WHEN 0 THEN 'co.uk' WHEN 1 THEN l[-1] ELSE '' END AS suffix, CASE page_id % 3 WHEN 0 THEN concat(l[-3], '.co.uk') WHEN 1 THEN array_to_string(l[-2:], '.') ELSE '' END AS registered, CASE page_id % 3 WHEN 0 THEN array_to_string(l[:len(l) - 3], '.') WHEN 1 THEN array_to_string(l[:len(l) - 2], '.') ELSE '' END AS subdomain FROM (SELECT page_id, {_SUFFIXED} AS host, string_split({_SUFFIXED}, '.') AS l FROM (SELECT page_id, {_HOST.format('url')} AS h FROM pages))")
def c12_public_suffix(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", ind.host(F.col("url")).alias("h"))
    host = F.when(F.col("page_id") % 3 == 0, F.concat("h", F.lit(".co.uk"))).when(F.col("page_id") % 3 == 1, F.col("h")).otherwise(F.split_part("h", F.lit("."), F.lit(1)))
    return hosts.select("page_id", host.alias("host"), ind.split_suffix(host).alias("s")).select("page_id", "host", "s.*")


_BRAND_LIST = "[" + ", ".join(f"'{b}'" for b in ind.BRANDS) + "]"
#: A brand of the table's own choice, changed in one of several ways, or the page's own host name.
_MUTANT = "CASE page_id % 8 WHEN 0 THEN concat(b, '-login.com') WHEN 1 THEN concat(translate(b, 'oal', '041'), '.net') WHEN 2 THEN concat(substr(b, 1, 1), 'x', substr(b, 3), '.org') WHEN 3 THEN concat(b, 's.com') WHEN 4 THEN concat(b, '.com') WHEN 5 THEN concat('mail.', substr(b, 1, length(b) - 1), '.com') WHEN 6 THEN concat('my-', substr(b, 2), '_x.com') ELSE h END"


@_query(f"""WITH d AS (SELECT page_id, {_MUTANT} AS domain FROM (SELECT page_id, {_HOST.format('url')} AS h, {_BRAND_LIST}[page_id % {len(ind.BRANDS)} + 1] AS b FROM pages)),
n AS (SELECT page_id, domain, CASE WHEN len(l) >= 2 THEN l[-2] ELSE l[1] END AS name FROM (SELECT *, string_split(lower(domain), '.') AS l FROM d)),
t AS (SELECT page_id, domain, list_distinct(list_prepend(name, list_filter(string_split_regex(name, '[-_.]'), lambda x: length(x) >= 3))) AS tokens FROM n),
x AS (SELECT page_id, domain, len(tokens) > 1 AS several, unnest(tokens) AS token FROM t),
y AS (SELECT x.*, translate(token, '10354@8', 'loesaab') AS plain, b, CASE WHEN length(b) <= 5 THEN 1 ELSE 2 END AS most FROM x, unnest({_BRAND_LIST}) AS u(b)),
z AS (SELECT page_id, bool_or((plain = b AND token <> b) OR (token = b AND several) OR (token <> b AND abs(length(token) - length(b)) <= 2 AND levenshtein(token, b) <= most) OR (plain <> b AND abs(length(plain) - length(b)) <= 2 AND levenshtein(plain, b) <= most)) AS odd FROM y GROUP BY page_id)
SELECT page_id, domain, odd AND NOT (list_contains([{", ".join(f"'{x}'" for x in ind.BRAND_DOMAINS)}], domain) OR len(list_filter({_BRAND_LIST}, lambda k: ends_with(domain, concat('.', k, '.com')))) > 0) AS typosquat FROM d JOIN z USING (page_id)""")
def c16_typosquats(spark, sf_dir):
    brand = F.element_at(F.array(*map(F.lit, ind.BRANDS)), (F.col("page_id") % len(ind.BRANDS) + 1).cast("int"))
    d = table(spark, sf_dir, "pages").select("page_id", ind.host(F.col("url")).alias("h"), brand.alias("b")).select("page_id", F.expr(_MUTANT).alias("domain"))
    return d.select("page_id", "domain", ind.is_typosquat(F.col("domain")).alias("typosquat"))


#: A small snapshot of suffix rules, with a wildcard and an exception.
_RULES = ("com", "org", "net", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck")
_TAILED = "CASE page_id % 7 WHEN 0 THEN concat(h, '.co.uk') WHEN 1 THEN h WHEN 2 THEN concat('mail.', split_part(h, '.', 1), '.kawasaki.jp') WHEN 3 THEN concat(split_part(h, '.', 1), '.city.kawasaki.jp') WHEN 4 THEN concat(split_part(h, '.', 2), '.www.ck') WHEN 5 THEN concat(split_part(h, '.', 2), '.ck') ELSE concat('x.', split_part(h, '.', 1), '.Unknown.') END"


@_query(f"""WITH p AS (SELECT page_id, {_TAILED} AS host FROM (SELECT page_id, {_HOST.format('url')} AS h FROM pages)),
l AS (SELECT DISTINCT host, string_split(lower(rtrim(host, '.')), '.') AS l FROM p),
t AS (SELECT host, l, n, array_to_string(l[-n:], '.') AS tail FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS n)),
r AS (SELECT unnest([{", ".join(f"'{r}'" for r in _RULES)}]) AS rule),
m AS (SELECT host, CASE WHEN rule LIKE '!%' THEN 1000 + n - 1 WHEN rule LIKE '*.%' THEN n + 1 ELSE n END AS k FROM t JOIN r ON rule = tail OR (rule = '*.' || tail AND n < len(l)) OR rule = '!' || tail),
k AS (SELECT host, l, coalesce(max(k), 1) % 1000 AS k FROM l LEFT JOIN m USING (host) GROUP BY host, l)
SELECT page_id, host, array_to_string(l[-k:], '.') AS suffix, CASE WHEN len(l) > k THEN array_to_string(l[-(k + 1):], '.') ELSE '' END AS registered, CASE WHEN len(l) > k + 1 THEN array_to_string(l[:len(l) - k - 1], '.') ELSE '' END AS subdomain FROM p JOIN k USING (host)""")
def c12_suffix_table(spark, sf_dir):
    """The suffixes come from a table of rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", ind.host(F.col("url")).alias("h")).select("page_id", F.expr(_TAILED).alias("host"))
    rules = spark.createDataFrame([(r,) for r in _RULES], "rule string")
    return pages.join(split_hosts(pages, rules), "host").select("page_id", "host", "suffix", "registered", "subdomain")
