"""Raw messages to tables (A1, B1-B12, B14, B15): one Arrow pass decodes MIME, all else are column expressions.

``decoded`` is the only place with Python workers: the charset of a part or of an
encoded word is a per-row codec that Spark has no expression for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind

# Patterns and word lists of message decomposition.
MAILBOX_PATTERN = r'^"?([^"<]+?)"?\s*<([^>]+)>'
HOP_PATTERNS = {"from_host": r"(?i)from\s+([\w.\-\[\]]+)", "by_host": r"(?i)by\s+([\w.\-]+)", "queue_id": r"(?i)\bid\s+([\w.\-]+)", "for_address": r"(?i)for\s+<([^>]+)>"}
PROTOCOL_PATTERN = r"(?i)with\s+([\w]+(?:TPS?|SMTP[SA]?|HTTP|LMTP)?)"
ODD_PROTOCOLS = ("HTTP", "HTTPS", "FTP")
EXECUTABLES = (".exe", ".bat", ".cmd", ".ps1", ".sh", ".vbs", ".js", ".jar", ".com", ".scr", ".pif", ".msi", ".dll")
ARCHIVES = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".iso", ".cab", ".ace")
DOCUMENTS = (".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp", ".rtf", ".pdf")
NAMED_X_HEADERS = ("x-originating-ip", "x-mailer", "x-spam-status", "x-spam-score", "x-spam-flag")
#: Zone names of mail dates; others are read as UTC offsets or not at all.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

DECODED_BYTES = 8 << 20
_HEADER = pa.struct([("name", pa.string()), ("raw", pa.string()), ("value", pa.string())])
_PART = pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("content", pa.binary())])
_PARTS = {"headers": pa.list_(_HEADER), "text_plain": pa.string(), "text_html": pa.string(), "attachments": pa.list_(_PART), "error": pa.string()}
_SCHEMA = "headers array<struct<name:string,raw:string,value:string>>, text_plain string, text_html string, attachments array<struct<filename:string,content_type:string,content:binary>>, error string"


def _text(data: bytes, charset: str | None) -> str:
    """Text of bytes by the named charset; without a known one by UTF-8, else by ISO-8859-1."""
    for name in (charset, "utf-8"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("iso-8859-1")


def _words(value: str) -> str:
    """A header value with its encoded words decoded."""
    from email.header import decode_header

    if "=?" not in value:
        return value
    return "".join(part if isinstance(part, str) else _text(part, charset) for part, charset in decode_header(value))


def _decode(content: bytes) -> dict:
    """Headers, the first plain and HTML texts, and all other parts as attachments."""
    import email
    import re

    message = email.message_from_bytes(content)
    if not message.keys() and b"\0" in content:
        message = email.message_from_bytes(content.replace(b"\0", b""))
    headers = []
    for name, value in message.raw_items():
        raw = re.sub(r"\r?\n[ \t]+", " ", _text(value.encode("ascii", "surrogateescape"), None)).strip()
        headers.append({"name": name, "raw": raw, "value": _words(raw)})
    texts, rest = {"text/plain": None, "text/html": None}, []
    for part in message.walk():
        kind = part.get_content_type()
        if kind.startswith("multipart/"):
            continue
        data = part.get_payload(decode=True)
        if data is None:
            continue
        if kind in texts and texts[kind] is None and part.get_content_disposition() != "attachment":
            texts[kind] = _text(data, part.get_content_charset())
        else:
            name = part.get_filename()
            rest.append({"filename": name and _words(name), "content_type": kind, "content": data})
    return {"headers": headers, "text_plain": texts["text/plain"], "text_html": texts["text/html"], "attachments": rest, "error": None}


def decoded(raw: DataFrame) -> DataFrame:
    """``raw(email_id, content BINARY, ...)`` -> email_id, sha256, size, headers, text_plain, text_html, attachments, error.

    A message that can't be read has an error and nothing else; no row is lost.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of messages of about ``DECODED_BYTES``, so that no more of them are held decoded at once."""
        for batch in batches:
            start, held = 0, 0
            for i, n in enumerate(pc.binary_length(batch.column("content").fill_null(b"")).to_pylist()):
                if held and held + n > DECODED_BYTES:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n
            yield batch.slice(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            rows = []
            for content in batch.column("content"):
                try:
                    rows.append(_decode(content.as_py() or b""))
                except Exception as e:  # whatever a hostile message provokes belongs in its row
                    rows.append({**dict.fromkeys(_PARTS), "headers": [], "attachments": [], "error": f"{type(e).__name__}: {e}"})
            own = [batch.column(c) for c in ("email_id", "sha256", "size")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[c] for r in rows], t) for c, t in _PARTS.items())], ["email_id", "sha256", "size", *_PARTS])

    given = raw.select(F.col("email_id").cast("string"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content")
    return given.mapInArrow(run, f"email_id string, sha256 string, size long, {_SCHEMA}")


def named(headers: Column, name: str, part: str = "value") -> Column:
    """All values of a header, in order."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h[part])


def first(headers: Column, *names: str) -> Column:
    """The first value that isn't empty of the first header that has one."""
    return F.coalesce(*(F.nullif(F.get(named(headers, n), 0), F.lit("")) for n in names))


def mailbox(c: Column) -> Column:
    """struct(name, address) of a header value; without angle brackets the first address in it."""
    text = F.trim(F.coalesce(c, F.lit("")))
    inside = F.regexp_extract(text, MAILBOX_PATTERN, 2)
    found = F.struct(F.trim(F.regexp_extract(text, MAILBOX_PATTERN, 1)).alias("name"), F.trim(inside).alias("address"))
    bare = F.struct(F.lit(None).cast("string").alias("name"), F.get(ind.addresses(text), 0).alias("address"))
    return F.when(inside != "", found).otherwise(bare)


def domain(address: Column) -> Column:
    """Lower-cased domain of an address, or of a host; null for null or empty."""
    rest = F.when(F.contains(address, F.lit("@")), F.regexp_extract(address, r"(?s)^[^@]*@(.*)$", 1)).otherwise(address)
    return F.nullif(F.rtrim(F.lower(F.trim(rest)), F.lit(">")), F.lit(""))


def mail_time(c: Column) -> Column:
    """Time of a mail date, null if it can't be read; a trailing comment and the weekday are dropped."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*\([^)]*\)\s*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s*", ""), r"\s+", " ")
    zone = F.upper(F.regexp_extract(text, r"([A-Za-z]+)$", 1))
    offset = F.coalesce(*(F.when(zone == k, v) for k, v in ZONES.items()))
    plain = F.when(zone == "", text).otherwise(F.concat(F.regexp_replace(text, r"[A-Za-z]+$", ""), offset))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")))


def mail_iso(c: Column) -> Column:
    """The same as UTC text, the trimmed text itself if it can't be read, null if it is empty."""
    return F.coalesce(F.date_format(mail_time(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.nullif(F.trim(c), F.lit("")))


def without_angles(c: Column) -> Column:
    """B4."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"<([^>]+)>", 1), F.lit("")), F.nullif(F.trim(c), F.lit("")))


def recorded_auth(headers: Column) -> dict[str, Column]:
    """Verdicts that the receiving server wrote down; SPF also from its own header."""
    text = F.lower(F.array_join(named(headers, "authentication-results"), " "))
    out = {k: F.nullif(F.regexp_extract(text, rf"\b{k}\s*=\s*([a-z]+)", 1), F.lit("")) for k in ("spf", "dkim", "dmarc", "arc")}
    own = F.nullif(F.regexp_extract(F.lower(F.trim(first(headers, "received-spf"))), r"^([a-z]+)", 1), F.lit(""))
    return {**out, "spf": F.coalesce(out["spf"], own)}


def custom_headers(headers: Column) -> Column:
    """Map of the X- headers that have no column of their own; the first value of a name counts."""
    own = F.filter(headers, lambda h: F.startswith(F.lower(h["name"]), F.lit("x-")) & ~F.lower(h["name"]).isin(*NAMED_X_HEADERS))
    names = F.array_distinct(F.transform(own, lambda h: h["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(own, lambda h: F.lower(h["name"]) == F.lower(n)), 0)["value"]))


def header_table(messages: DataFrame) -> DataFrame:
    """One row per message."""
    h = F.col("headers")
    sender, fallback = mailbox(first(h, "from", "sender")), mailbox(first(h, "sender", "return-path", "reply-to"))
    people = lambda name: ind.addresses(F.array_join(named(h, name), ", "))
    spam = first(h, "x-spam-status", "x-spam-flag")
    score = first(h, "x-spam-score")
    origin = F.trim(first(h, "x-originating-ip", "x-origin-ip"))
    base = messages.select(
        "email_id", sender["name"].alias("display_name"), F.coalesce(F.nullif(sender["address"], F.lit("")), fallback["address"]).alias("from_address"),
        people("to").alias("to"), people("cc").alias("cc"), people("bcc").alias("bcc"),
        mailbox(first(h, "reply-to"))["address"].alias("reply_to"), mailbox(first(h, "return-path"))["address"].alias("return_path"),
        F.nullif(F.trim(first(h, "subject")), F.lit("")).alias("subject"), mail_iso(first(h, "date")).alias("date"),
        without_angles(first(h, "message-id")).alias("message_id"), without_angles(first(h, "in-reply-to")).alias("in_reply_to"),
        F.regexp_extract_all(F.coalesce(first(h, "references"), F.lit("")), F.lit("<[^>]+>"), F.lit(0)).alias("references"),
        F.nullif(F.trim(origin, F.lit("[]")), F.lit("")).alias("originating_ip"),
        first(h, "x-mailer", "user-agent", "x-newsreader").alias("mailer"), first(h, "x-priority", "priority", "x-msmail-priority", "importance").alias("priority"),
        spam.alias("spam_status"), F.when(score.isNotNull(), F.trim(score).try_cast("double")).otherwise(F.regexp_extract(spam, r"(?i)score=([0-9.]+)", 1).try_cast("double")).alias("spam_score"),
        *(c.alias(f"recorded_{k}") for k, c in recorded_auth(h).items()),
        first(h, "mime-version").alias("mime_version"), first(h, "content-type").alias("content_type"), custom_headers(h).alias("custom_headers"),
    )
    own, reply, back = (domain(F.col(c)) for c in ("from_address", "reply_to", "return_path"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return base.withColumns({"reply_to_mismatch": flag(own != reply), "return_path_mismatch": flag(own != back), "display_name_spoofing": flag(F.contains("display_name", F.lit("@")))})


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/\\](\.[^./\\]+)$", 1))


def attachment_kinds(name: Column) -> dict[str, Column]:
    """By the file name's suffix."""
    return {"executable": _suffix(name).isin(*EXECUTABLES), "archive": _suffix(name).isin(*ARCHIVES), "office": _suffix(name).isin(*DOCUMENTS)}


def attachment_table(messages: DataFrame) -> DataFrame:
    """One row per attachment: email_id, n (from 1), filename, content_type, size, md5, sha1, sha256 and its kinds."""
    each = messages.select("email_id", F.posexplode("attachments").alias("n", "a"))
    data = F.col("a.content")
    digests = (F.md5(data).alias("md5"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"))
    kinds = (c.alias(k) for k, c in attachment_kinds(F.col("a.filename")).items())
    return each.select("email_id", (F.col("n") + 1).alias("n"), "a.filename", "a.content_type", F.octet_length(data).cast("long").alias("size"), *digests, *kinds)


def hop_table(messages: DataFrame) -> DataFrame:
    """One row per relay hop, the one closest to the sender first: email_id, hop, its fields, ts, flags.

    An address that is public is preferred; of several, the one named first.
    """
    each = messages.select("email_id", F.posexplode(F.reverse(named(F.col("headers"), "received", "raw"))).alias("hop", "raw"))
    raw, field = F.col("raw"), lambda pattern: F.nullif(F.regexp_extract("raw", pattern, 1), F.lit(""))
    ips = F.array_distinct(F.regexp_extract_all("raw", F.lit(ind.IPV4_PATTERN), F.lit(0)))
    classed = F.transform(ips, lambda i: F.struct(i.alias("ip"), ind.ip_class(i).alias("class")))
    out = each.select("email_id", (F.col("hop") + 1).alias("hop"), raw, *(field(p).alias(c) for c, p in HOP_PATTERNS.items()), F.upper(field(PROTOCOL_PATTERN)).alias("protocol"), classed.alias("ips"), mail_time(F.regexp_extract("raw", r"(?m);\s*(.+)$", 1)).alias("ts"))
    public = F.get(F.filter("ips", lambda i: i["class"] == "public"), 0)["ip"]
    inner = F.get(F.filter("ips", lambda i: i["class"] != "public"), 0)["ip"]
    flags = F.array_compact(F.array(F.when(public.isNull() & inner.isNotNull(), "private_ip"), F.when(F.col("protocol").isin(*ODD_PROTOCOLS), "protocol_mismatch"), F.when(F.col("ts").isNull(), "timestamp_missing")))
    return out.withColumns({"from_ip": F.coalesce(public, inner), "flags": flags}).drop("ips")


def relay_path(messages: DataFrame) -> DataFrame:
    """The hops with their delays; a delay of over 300 s adds the flag ``time_skew``."""
    from .relay import hop_delays

    timed = hop_delays(hop_table(messages)).withColumn("delay_s", F.round("delay_s", 1))
    return timed.withColumn("flags", F.when(F.col("time_skew"), F.array_append("flags", F.lit("time_skew"))).otherwise(F.col("flags"))).drop("time_skew", "timestamp_missing")


def mail_rows(messages: DataFrame) -> DataFrame:
    """The mail fields that ``ml_rows`` (A7) makes canonical, from decoded messages."""
    h = F.col("headers")
    body = F.coalesce("text_plain", "text_html", F.lit(""))
    auth = F.lower(F.coalesce(first(h, "authentication-results"), F.lit("")))
    urls = F.regexp_extract_all(body, F.lit(r"https?://[^\s<>\"')]+"), F.lit(0))
    files = F.filter("attachments", lambda a: F.coalesce(a["filename"], F.lit("")) != "")
    return messages.select(
        F.coalesce(first(h, "message-id"), F.col("email_id")).alias("email_id"), *(first(h, k).alias(c) for k, c in (("from", "sender"), ("reply-to", "reply_to"), ("return-path", "return_path"), ("subject", "subject"))), body.alias("body"),
        *(F.regexp_extract(auth, rf"{k}=(\w+)", 1).alias(k) for k in ("spf", "dkim", "dmarc")), urls.alias("urls"), F.size(urls).alias("url_count"),
        F.size(files).alias("attachment_count"), F.size(F.filter(files, lambda a: _suffix(a["filename"]).isin(".exe", ".bat", ".cmd", ".vbs", ".scr", ".js", ".ps1", ".hta"))).alias("executable_attachments"), "error",
    )


def ml_rows(mails: DataFrame) -> DataFrame:
    """Canonical rows for features and models from mails with any of the known columns, under their usual other names."""
    have = {c.lower() for c in mails.columns}

    def text(*names: str) -> Column:
        given = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have]
        return F.coalesce(*given, F.lit(""))

    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).cast(kind) if name in have else F.lit(0).cast(kind)

    def address_domain(c: Column) -> Column:
        return F.nullif(F.lower(F.regexp_extract(c, r"@([\w.\-]+)[^@]*$", 1)), F.lit(""))

    urls = F.lit("")
    if "urls" in have:
        urls = F.array_join(F.filter("urls", lambda u: F.coalesce(u, F.lit("")) != ""), "|") if mails.schema["urls"].dataType.typeName() == "array" else F.coalesce(F.col("urls").cast("string"), F.lit(""))
    body, sender, reply, back = text("body", "body_text"), text("sender", "from"), text("reply_to"), text("return_path")
    flag = (number("html_destination_mismatch", "double") != 0).cast("int")
    return mails.select(
        text("email_id").alias("email_id"), sender.alias("sender"), address_domain(sender).alias("from_domain"), reply.alias("reply_to"), address_domain(reply).alias("reply_to_domain"),
        back.alias("return_path"), address_domain(back).alias("return_path_domain"), text("subject").alias("subject"), body.alias("body"), body.alias("body_text"), F.length(body).alias("body_length"),
        *(text(c).alias(c) for c in ("spf", "dkim", "dmarc", "arc")), number("header_risk_tally", "double").alias("header_risk_tally"), urls.alias("urls"),
        *(number(c, "int").alias(c) for c in ("url_count", "html_link_count")), flag.alias("html_destination_mismatch"), *(number(c, "int").alias(c) for c in ("ip_count", "private_ips", "attachment_count", "executable_attachments")),
        number("evidence_tally", "double").alias("evidence_tally"), text("evidence_risk_category").alias("evidence_risk_category"), (F.col("label").cast("string") if "label" in have else F.lit(None).cast("string")).alias("label"),
    )
