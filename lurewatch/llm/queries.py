"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, language_model, mixing, near_dedup, ngram_join, packing, quality, sharding, substring_dedup, toxicity, url_filter, whitening
from .common import table


#: Bytes of a shard of the query: small, so that small tables split, too.
SHARD_LIMIT = 64 << 10


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(url_filter.labelled_urls(spark)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.verdicts(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_LIMIT)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.verdicts(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels").withColumn("label", F.col("toxic"))))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classified(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_near_dedup, op4_packing, op5_sharding, op6_quality, op7_substring_dedup, op8_language_model, op9_exact_dedup, op10_toxicity, op11_ngram_join, op12_filter_audit, op13_whitening)}

SQL: dict[str, str] = {}
SQL["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _mixing_sql(max_epochs: int = 4, seed: int = 17) -> str:
    """The same budgets by window functions, and the prefixes by a running sum over each whole leaf."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items()) + " ELSE 1.0 END"
    k = "try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT)"
    out = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN {k} < 6 THEN 'web' WHEN {k} < 12 THEN 'books' WHEN {k} < 16 THEN 'code' ELSE 'other' END AS domain,
         lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
l0 AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS DOUBLE) AS cap,
         CAST((SELECT sum(n_tokens) FROM d) AS DOUBLE) AS given
  FROM d GROUP BY ALL)"""
    for i, level in enumerate(mixing.LEVELS):
        node = ", ".join(mixing.LEVELS[: i + 1])
        parent = ", ".join(mixing.LEVELS[:i]) or "1"
        same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in mixing.LEVELS[: i + 1])
        out += f""",
c{i} AS (SELECT {node}, sum(cap) AS room, any_value(given) AS given, {weight(level)} AS w FROM l{i} GROUP BY {node}),
f{i} AS (
  SELECT *, coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (PARTITION BY {parent} ORDER BY room / w, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM c{i}),
w{i} AS (SELECT *, max(CASE WHEN (given - before) / left_w <= room / w THEN (given - before) / left_w END) OVER (PARTITION BY {parent}) AS water FROM f{i}),
l{i + 1} AS (
  SELECT a.domain, a.lang, a.source, a.tokens, a.cap, least(b.room, coalesce(greatest(b.water, 0) * b.w, b.room)) AS given
  FROM l{i} a JOIN w{i} b ON {same})"""
    return out + f""",
p AS (
  SELECT domain, lang, source, CAST(floor(round(given, 6)) AS BIGINT) AS leaf_budget,
         CASE WHEN tokens > 0 THEN CAST(floor(round(given, 6)) AS BIGINT) // tokens ELSE 0 END AS epochs,
         CASE WHEN tokens > 0 THEN CAST(floor(round(given, 6)) AS BIGINT) % tokens ELSE 0 END AS rest
  FROM l3),
o AS (
  SELECT d.*, p.leaf_budget, p.epochs, p.rest,
         sum(d.n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{seed}:' || p.epochs || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, CAST(epochs AS BIGINT) AS epochs,
       CAST(greatest(0, least(n_tokens, rest - (upto - n_tokens))) AS BIGINT) AS prefix_tokens
FROM o"""


SQL["op1_mixing"] = _mixing_sql()
SQL["op5_sharding"] = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, ('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))), 1, {sharding.BITS // 4}))::BIGINT AS h FROM documents),
e AS (SELECT d.*, level, h >> ({sharding.BITS} - level) AS prefix FROM d, range(0, {sharding.BITS} + 1) AS r(level)),
f AS (SELECT *, sum(bytes) OVER (PARTITION BY level, prefix) AS total FROM e),
g AS (SELECT doc_id, bytes, h, coalesce(min(level) FILTER (total <= {SHARD_LIMIT}), {sharding.BITS})::INT AS depth FROM f GROUP BY doc_id, bytes, h),
s AS (SELECT *, substr(lpad(bin(h), {sharding.BITS}, '0'), 1, depth) AS shard FROM g)
SELECT doc_id, bytes, shard, depth, count(*) OVER w AS shard_docs, CAST(sum(bytes) OVER w AS BIGINT) AS shard_bytes, sum(bytes) OVER w > {SHARD_LIMIT} AS oversized FROM s WINDOW w AS (PARTITION BY shard)"""

SQL["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
  SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e
  FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (
  SELECT p.v || q.v || r.v || s.v || t.v AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.v <> q.v AND p.v <> r.v AND p.v <> s.v AND p.v <> t.v AND q.v <> r.v AND q.v <> s.v AND q.v <> t.v AND r.v <> s.v AND r.v <> t.v AND s.v <> t.v),
j AS (
  SELECT part, filter_order, step, n, good, toxic, n_fails, fails[filter_order[step]] AS own,
         len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda v: v <> '' AND fails[v])) > 0 AS gone
  FROM k, o, range(1, 6) AS r(step))
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND n_fails = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(n) FILTER (own AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // nullif(n_fails, 0)) FILTER (own), 0)::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step"""
