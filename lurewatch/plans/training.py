"""Queries of training and evaluation (I1-I14), batch prediction (G12), payload repair (D13) and case reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import training as tr
from ..operators.tables import work_path, written
from ..sources import readers
from . import columns
from .fixtures import BASE_SQL, emails, table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_RAW_LABEL = "CASE doc_id % 7 WHEN 0 THEN ' Ham' WHEN 1 THEN 'SPAM ' WHEN 2 THEN 'phishing' WHEN 3 THEN 'bec' WHEN 4 THEN 'impersonation' WHEN 5 THEN ' ' END"
_CLEAN_LABEL = "CASE doc_id % 7 WHEN 0 THEN 'benign' WHEN 1 THEN 'spam' WHEN 2 THEN 'phishing' WHEN 3 THEN 'bec' WHEN 4 THEN 'impersonation' END"


def _labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body"), F.expr(_RAW_LABEL).alias("label"))
    return d.unionByName(d.filter("doc_id % 3 = 0"))  # rows that repeat


@_query(f"SELECT DISTINCT doc_id, md5(text) AS body, {_CLEAN_LABEL} AS label FROM documents WHERE doc_id % 7 < 5")
def i1_cleaned(spark, sf_dir):
    return ev.cleaned(_labelled(spark, sf_dir))


@_query(f"SELECT DISTINCT doc_id, (doc_id % 7 <> 0)::INT AS threat, (doc_id % 7)::INT AS multiclass, (doc_id % 7 = 3)::INT AS bec, (doc_id % 7 = 4)::INT AS impersonation, greatest(0, 1 - (doc_id % 10) / 8.0::DOUBLE) AS p, 1 - (doc_id % 10) / 8.0::DOUBLE >= 0.5 AS flag FROM documents WHERE doc_id % 7 < 5 AND {_CLEAN_LABEL} IS NOT NULL")
def i3_i8_tasks(spark, sf_dir):
    rows = ev.cleaned(_labelled(spark, sf_dir))
    p = ev.threat_probability((F.col("doc_id") % 10) / 8.0)
    return rows.select("doc_id", *(c.alias(k) for k, c in ev.tasks(F.col("label")).items()), p["p"].alias("p"), p["flag"].alias("flag"))


@_query("SELECT event_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events)")
def i2_temporal_split(spark, sf_dir):
    return ev.temporal_split(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "split")


_CLASSES = ("phishing", "spam", "bec", "impersonation", "benign")
_SCORED = "SELECT event_id, [{}][event_id % 5 + 1] AS label, {} FROM events".format(
    ", ".join(f"'{c}'" for c in _CLASSES), ", ".join(f"((event_id * {7 + 4 * i} + user_id) % 100 + CASE WHEN event_id % 5 = {i} THEN 60 ELSE 0 END) / 160.0::DOUBLE AS p_{c}" for i, c in enumerate(_CLASSES))
)
_AUC = f"""WITH s AS ({_SCORED}), x AS ({" UNION ALL ".join(f"SELECT '{c}' AS class, label = '{c}' AS y, round(p_{c}, 6) AS p FROM s" for c in _CLASSES)}),
g AS (SELECT class, p, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM x GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY class ORDER BY p DESC) AS fp FROM g),
auc AS (SELECT class, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM r GROUP BY class)"""


def _scored(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = {c: ((F.col("event_id") * (7 + 4 * i) + F.col("user_id")) % 100 + F.when(F.col("event_id") % 5 == i, 60).otherwise(0)) / 160.0 for i, c in enumerate(_CLASSES)}
    label = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", label.alias("label"), *(v.alias(f"p_{c}") for c, v in p.items()))


@_query(f"{_AUC} SELECT class, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM auc")
def i13_one_vs_rest_auc(spark, sf_dir):
    out = ev.one_vs_rest_auc(_scored(spark, sf_dir), "label", _CLASSES)
    return out.select("class", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


_GATED = {"phishing": (0.93, 0.85, 0.88, 0.93, 0.90), "spam": (0.90, 0.85, 0.87, 0.91, 0), "bec": (0.95, 0.80, 0.87, 0.92, 0), "impersonation": (0.92, 0.80, 0.85, 0.90, 0)}


@_query(f"""{_AUC}, guess AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'spam' ELSE label END AS guess FROM s),
m AS (SELECT c.class, sum((label = c.class AND guess = c.class)::INT) / sum((guess = c.class)::INT) AS precision, sum((label = c.class AND guess = c.class)::INT) / sum((label = c.class)::INT) AS recall FROM guess, (VALUES {", ".join(f"('{c}')" for c in _CLASSES)}) AS c(class) GROUP BY c.class),
need AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in _GATED.items())}) AS n(class, a, b, c, d, e))
SELECT class, precision >= a AND recall >= b AND 2 * precision * recall / (precision + recall) >= c AND roc_auc >= d AND pr_auc >= e AS passed FROM need JOIN m USING (class) JOIN auc USING (class)""")
def i14_gates(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("guess", F.when(F.col("event_id") % 9 == 0, "spam").otherwise(F.col("label")))
    return ev.gates(ev.multiclass_metrics(scored).join(ev.one_vs_rest_auc(scored, "label", _CLASSES), "class"))


def _training_mails(spark, sf_dir) -> DataFrame:
    mails = emails(spark, sf_dir)
    return mails.select("body", "subject", "sender", "reply_to", "return_path", "spf", "dkim", "dmarc", F.array("url").alias("urls"), F.col("classification").alias("label"))


@_query()
def i4_i10_training(spark, sf_dir):
    return tr.run_training(_training_mails(spark, sf_dir), work_path(spark, "threat-model"))[1]


@_query()
def i9_bec_detector(spark, sf_dir):
    mails = emails(spark, sf_dir)
    rows = tr.training_rows(mails.select("body", "subject", "sender", "reply_to", "return_path", F.col("email_id").alias("label")))
    # a label of the documents that no feature is made of
    classes = mails.select(F.col("email_id").alias("label"), (F.col("classification") == "phishing").cast("int").alias("is_target"))
    rows = written(rows.drop("body", "key").join(classes, "label"), "bec-rows")
    return tr.fit_bec(rows).probabilities(rows).select(F.col("label").alias("email_id"), "is_target", F.round("p_bec", 4).alias("p_bec"), "is_bec")


_G8 = columns.SQL["g8_risk_score"]


@_query(f"SELECT email_id, CASE WHEN bad THEN 'header_risk_tally is not a number' END AS error, CASE WHEN NOT bad THEN label END AS label, CASE WHEN NOT bad THEN confidence END AS confidence, CASE WHEN NOT bad THEN score END AS score FROM (SELECT *, CAST(substr(email_id, 7) AS BIGINT) % 17 = 0 AS bad FROM ({_G8}))")
def g12_predictions(spark, sf_dir):
    mails = columns._mails(spark, sf_dir).withColumn("header_risk_tally", F.when(F.col("doc_id") % 17 == 0, "high").otherwise("0"))
    out = tr.predict(mails, "email_id")
    return out.select("email_id", "error", "label", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


_REASONS = (
    ("confidence >= 0.6 AND label <> 'benign'", "concat('high probability of ', label)"), ("spf_fail = 1", "'SPF failed'"), ("spf_fail <> 1 AND spf_softfail = 1", "'SPF soft-failed'"), ("dkim_fail = 1", "'DKIM failed'"), ("dmarc_fail = 1", "'DMARC failed'"),
    ("reply_to_mismatch = 1", "'Reply-To domain is not the sender''s'"), ("return_path_mismatch = 1", "'Return-Path domain is not the sender''s'"), ("ip_based_urls > 0", "concat('links to bare addresses (', ip_based_urls::INT, ')')"), ("has_credentials_in_url = 1", "'link with credentials'"),
    ("html_destination_mismatch = 1", "'link text and destination differ'"), ("executable_attachments > 0", "concat('executable attachments (', executable_attachments::INT, ')')"), ("display_name_privileged = 1", "'privileged display name'"),
    ("body_wire_transfer_mention = 1", "'wire transfer mentioned'"), ("body_gift_card_mention = 1", "'gift card mentioned'"), *((f"{k}_keyword_hits > 0", f"concat('{n} language (', {k}_keyword_hits::INT, ')')") for k, n in (("urgency", "urgent"), ("financial", "financial"), ("credential", "credential"))),
)
SQL["g8_reasons"] = f"""WITH a AS ({_G8}), f AS ({columns.SQL["h_features"]}), j AS (SELECT * FROM a JOIN f USING (email_id)),
r AS (SELECT email_id, score, list_filter([{", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in _REASONS)}], lambda x: x IS NOT NULL) AS found FROM j)
SELECT email_id, CASE WHEN len(found) > 0 THEN found WHEN score < 25 THEN ['no indicators'] ELSE ['raised by the model'] END AS reasons FROM r"""


_PAYLOAD_SQL = f"""{BASE_SQL}, p AS (SELECT *, doc_id % 3 AS shape FROM emails)
SELECT coalesce(CASE WHEN shape = 2 THEN concat('an-', doc_id) END, CASE WHEN shape = 0 THEN email_id END, concat('msg-', doc_id)) AS analysis_id, CASE shape WHEN 0 THEN email_id WHEN 1 THEN concat('msg-', doc_id) ELSE concat('an-', doc_id) END AS email_id, concat('msg-', doc_id) AS message_id,
  subject, CASE WHEN shape = 1 THEN spf WHEN shape = 2 THEN 'recorded' ELSE 'unknown' END AS spf, CASE WHEN shape = 0 THEN 'given' WHEN risk_score > 0.6 THEN 'phishing' ELSE 'suspicious' END AS classification, CASE WHEN shape = 0 THEN 0.25 ELSE risk_score END::DOUBLE AS risk_score FROM p"""


@_query(_PAYLOAD_SQL)
def d13_payload_repair(spark, sf_dir):
    mails = emails(spark, sf_dir)
    shape, message = F.col("doc_id") % 3, F.concat(F.lit("msg-"), F.col("doc_id").cast("string"))
    nested = F.struct(F.col("email_id"), message.alias("message_id"), F.col("subject"), F.col("sender"))
    flat = mails.select(
        F.when(shape == 2, F.concat(F.lit("an-"), F.col("doc_id").cast("string"))).alias("analysis_id"), F.when(shape == 0, nested).alias("email"), F.when(shape != 0, message).alias("message_id"), "subject", "sender", F.col("risk_score"),
        F.when(shape == 1, F.struct("spf", "dkim", "dmarc")).alias("authentication"), F.when(shape == 2, F.create_map(F.lit("Authentication-Results"), F.lit("recorded"))).alias("headers"),
        F.when(shape == 0, F.struct(F.lit("given").alias("classification"), F.lit(0.25).alias("risk_score"), F.lit(0.5).alias("confidence"))).alias("detection"),
    )
    r = readers.repaired(flat)
    return r.select("analysis_id", "email.email_id", "email.message_id", "email.subject", "authentication.spf", "detection.classification", F.col("detection.risk_score").alias("risk_score"))


@_query(f"{BASE_SQL} SELECT concat('case-', doc_id) AS case_id, concat(email_id, '.eml') AS filename, CASE WHEN doc_id % 2 = 0 THEN [concat('e', doc_id)] ELSE [] END AS primary_evidence, CASE WHEN doc_id % 2 = 0 THEN ['act'] ELSE [] END AS recommended_actions, true AS told FROM emails")
def a12_case_reports(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    data = F.when(F.col("doc_id") % 2 == 0, F.struct(F.array(F.concat(F.lit("e"), d)).alias("primary_evidence"), F.array(F.lit("act")).alias("recommended_actions")))
    cases = emails(spark, sf_dir).select(F.concat(F.lit("case-"), d).alias("case_id"), F.concat("email_id", F.lit(".eml")).alias("filename"), data.alias("data"))
    r = readers.case_reports(cases)
    return r.select("case_id", "filename", "primary_evidence", "recommended_actions", (F.length("disclaimer") > 0).alias("told"))
