"""Readers of labelled tables, mail folders, corpora, payloads and cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as norm
from ..operators.messages import decoded, mail_rows, ml_rows
from ..operators.tables import written

#: The ingest payload, read with an explicit schema.
PAYLOAD = """
schema_version STRING, analysis_id STRING,
email STRUCT<email_id: STRING, message_id: STRING, subject: STRING, sender: STRING, sender_domain: STRING, recipient: STRING, recipients: ARRAY<STRING>, timestamp: STRING>,
authentication STRUCT<spf: STRING, dkim: STRING, dmarc: STRING>,
iocs STRUCT<domains: ARRAY<STRUCT<value: STRING, source: STRING>>, ips: ARRAY<STRUCT<value: STRING, source: STRING, asn: STRING, country: STRING>>,
            urls: ARRAY<STRUCT<value: STRING, domain: STRING, url_hash: STRING>>, hashes: ARRAY<STRUCT<value: STRING, type: STRING, filename: STRING>>, ip_domain_mapping: MAP<STRING, STRING>>,
detection STRUCT<classification: STRING, risk_score: DOUBLE, confidence: DOUBLE>
"""
LABELS = ("benign", "spam", "phishing", "bec", "impersonation")


def labelled_csv(spark: SparkSession, path: str, label: str = "label", required: tuple[str, ...] = ()) -> DataFrame:
    """A3: distinct rows with a label, lower-cased and trimmed; ham is benign, ``text`` or ``body_text`` may stand for ``body``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for other in ("text", "body_text"):
        if "body" not in rows.columns and other in rows.columns:
            rows = rows.withColumnRenamed(other, "body")
    if missing := [c for c in (*required, label) if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = F.lower(F.trim(F.col(label)))
    return rows.dropDuplicates().withColumn(label, F.when(text == "ham", "benign").otherwise(text)).filter(F.coalesce(label, F.lit("")) != "")


def unknown_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """A3: labels that are none of the known classes, with their counts."""
    return rows.groupBy(label).count().filter(~F.col(label).isin(*LABELS))


def folder_label(path: Column) -> Column:
    """A4: the label that the nearest folder below the file names: spam or ham as a word of its own, as in ``spam_2`` or ``easy-ham``; else null."""
    folders = F.reverse(F.split(F.lower(F.regexp_replace(path, "/[^/]*$", "")), "/"))
    word = lambda f: F.regexp_extract(f, r"(?:^|[^a-z])(spam|ham)(?:[^a-z]|$)", 1)
    found = F.get(F.filter(F.transform(folders, word), lambda w: w != ""), 0)
    return F.when(found == "ham", "benign").otherwise(found)


def mail_folder(spark: SparkSession, path: str, label: str | None = None, *, pattern: str = "*") -> DataFrame:
    """A1/A2/A4: files as email_id, path, content, raw text, sha256, size and label; without one it is taken from the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("email_id"), "path", "content", F.decode("content", "ISO-8859-1").alias("raw"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (F.lit(label) if label else folder_label(F.col("path"))).alias("label"))


def labelled_mails(spark: SparkSession, path: str, label: str) -> tuple[DataFrame, DataFrame]:
    """A2: the readable messages of a folder as ML rows with ``label``, and a row (read, failed) with their counts."""
    rows = written(mail_rows(decoded(mail_folder(spark, path, label, pattern="*.eml"))), "labelled-mails")  # decoded once, for rows and counts
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("read"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return ml_rows(rows.filter("error IS NULL").withColumn("label", F.lit(label))), counts


def _corpus_csv(label: str | None = None):
    def read(spark: SparkSession, path: str) -> DataFrame:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        rows = rows.withColumnRenamed("text", "body_text") if "text" in rows.columns else rows
        return rows.withColumn("label", F.lit(label)) if label else rows

    return read


def _corpus_folder(label: str | None = None, kinds: tuple[str, ...] = ()):
    def read(spark: SparkSession, path: str) -> DataFrame:
        files = mail_folder(spark, path, label)
        kind = F.regexp_extract(F.lower("path"), r"/[^/]*?(\.[^./]+)?$", 1)
        return files.filter(kind.isin(*kinds)) if kinds else files

    return read


#: A4a-A4f: public corpora and how each is read; file kinds are suffixes, "" is none.
CORPORA = {
    "spamassassin": _corpus_folder(), "enron": _corpus_folder("ham", (".txt", ".eml", "")), "phishing": _corpus_csv(), "nazario": _corpus_folder("phishing", (".txt", ".eml", "")), "bec": _corpus_csv("bec"), "ceas": _corpus_folder(),
}


def corpus(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A4g: the corpus of that name."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name}; known: {', '.join(CORPORA)}")
    return CORPORA[name](spark, path)


def combined(*tables: DataFrame) -> DataFrame:
    """A5: all rows, with null for columns a table lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def payloads(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """Payload documents, one a line; with ``whole_files`` one (or an array of them) a file."""
    return spark.read.schema(PAYLOAD).option("multiLine", whole_files).json(path)


def repaired(rows: DataFrame, *keep: str) -> DataFrame:
    """Payloads in the standard form from nested or flat ones, with any of the columns of either, and the columns ``keep`` as they are.

    Ids that are missing come from each other, at last from a hash of the row; a
    missing detection comes from ``risk_score``; the SPF verdict of a flat payload
    may stand in its headers.
    """
    types = {f.name.lower(): f.dataType for f in rows.schema.fields if f.name not in keep}

    def field(name: str, inner: str | None = None) -> Column:
        kind = types.get(name)
        if kind is None or (inner and inner not in getattr(kind, "names", ())):
            return F.lit(None)
        return F.col(f"{name}.{inner}" if inner else name)

    def some(*options: Column) -> Column:
        return F.coalesce(*(F.nullif(o.cast("string"), F.lit("")) for o in options))

    own = F.md5(F.to_json(F.struct(*(c for c in rows.columns if c not in keep))))
    message = some(field("email", "message_id"), field("message_id"), F.concat(F.lit("msg-"), F.left(own, F.lit(10))))
    analysis = some(field("analysis_id"), field("email", "email_id"), message)
    nested = F.col("email").isNotNull() if "email" in types else F.lit(False)
    email_id = some(field("email", "email_id"), F.when(nested, field("email", "message_id")), analysis)
    none = F.array().cast("array<string>")
    recipients = F.coalesce(field("email", "recipients").cast("array<string>"), field("recipients").cast("array<string>"), none)
    email = F.struct(
        email_id.alias("email_id"), message.alias("message_id"), F.coalesce(some(field("email", "subject"), field("subject")), F.lit("")).alias("subject"), F.coalesce(some(field("email", "sender"), field("sender")), F.lit("")).alias("sender"),
        some(field("email", "sender_domain")).alias("sender_domain"), some(field("email", "recipient"), F.get(recipients, 0)).alias("recipient"), recipients.alias("recipients"), some(field("email", "timestamp"), field("timestamp")).alias("timestamp"),
    )
    header = F.col("headers")["Authentication-Results"] if "headers" in types else F.lit(None)
    auth = F.struct(*(F.coalesce(some(field("authentication", k), *([header] if k == "spf" else [])), F.lit("unknown")).alias(k) for k in ("spf", "dkim", "dmarc")))
    given = F.struct(field("detection", "classification").cast("string").alias("classification"), field("detection", "risk_score").cast("double").alias("risk_score"), field("detection", "confidence").cast("double").alias("confidence"))
    has = field("detection", "classification").isNotNull()
    detection = F.when(has, given).otherwise(norm.detection(F.coalesce(field("risk_score").cast("double"), field("detection", "risk_score").cast("double"))))
    rest = [F.col(c) for c in ("iocs", "threat_intel") if c in types]
    return rows.select(F.coalesce(some(field("schema_version")), F.lit("1.0")).alias("schema_version"), analysis.alias("analysis_id"), email.alias("email"), auth.alias("authentication"), *rest, detection.alias("detection"), *keep)


def save_cases(cases: DataFrame, path: str) -> None:
    """Append cases (case_id, created_at, ...), a folder for each day."""
    cases.withColumn("case_day", F.to_date("created_at")).write.mode("append").partitionBy("case_day").json(path)


def _cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def case(spark: SparkSession, path: str, schema: str, case_id: str) -> DataFrame:
    """A10."""
    return _cases(spark, path, schema).filter(F.col("case_id") == case_id)


def latest_cases(spark: SparkSession, path: str, schema: str, limit: int = 50) -> DataFrame:
    """The newest first, malformed ones skipped, 1 to 200."""
    return _cases(spark, path, schema).orderBy(F.desc("created_at"), "case_id").limit(max(1, min(limit, 200)))


#: Fields of a report and their types; those of the case itself, and those of its ``data``.
REPORT_OWN = {"case_id": "string", "filename": "string", "sha256": "string", "created_at": "string", "verdict": "string", "risk_score": "double", "risk_level": "string"}
REPORT_DATA = ("primary_evidence", "risk_breakdown", "recommended_actions", "limitations", "forensics", "threat_intel", "timeline")


def case_reports(cases: DataFrame) -> DataFrame:
    """The fixed fields of a case's report; what is missing is null, lists are empty."""
    kinds = cases.schema["data"].dataType if "data" in cases.columns else T.StructType()
    own = (F.col(c).cast(t).alias(c) if c in cases.columns else F.lit(None).cast(t).alias(c) for c, t in REPORT_OWN.items())

    def inner(name: str) -> Column:
        if name not in kinds.names:
            return F.lit(None).cast("array<string>").alias(name)
        value = F.col(f"data.{name}")
        return (F.coalesce(value, F.array().cast(kinds[name].dataType)) if isinstance(kinds[name].dataType, T.ArrayType) else value).alias(name)

    note = F.lit("Observations of protocols and digests; who sent a mail and from where is probable at best and proves nothing.")
    return cases.select(F.lit("Investigation report").alias("title"), *own, *map(inner, REPORT_DATA), note.alias("disclaimer"))


def to_document(rows: DataFrame) -> DataFrame:
    """Each row as JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_document(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse."""
    return documents.select(F.from_json("json", schema).alias("r")).select("r.*")
