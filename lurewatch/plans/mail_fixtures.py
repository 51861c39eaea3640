"""Raw messages, DNS snapshots and report tables derived from the given tables, alike in Spark and in DuckDB SQL.

Each expression below is over ``documents``; ``{...}`` marks what the two dialects spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import table

_SPARK = {
    "words": r"array_join(slice(filter(split(text, '[ \\n]+', 8), w -> w <> ''), 1, 6), ' ')", "div": "floor(doc_id / {})", "s": "string", "b64": "translate(base64(encode({}, 'utf-8')), concat(chr(13), chr(10)), '')",
    "rfc": "date_format(timestamp_seconds({}), 'd MMM yyyy HH:mm:ss')", "iso": "date_format(timestamp_seconds({}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "sha": "sha2({}, 256)",
}
_DUCK = {
    "words": r"array_to_string(regexp_extract_all(text, '[^ \n]+')[1:6], ' ')", "div": "doc_id // {}", "s": "varchar", "b64": "base64(encode({}))",
    "rfc": "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%-d %b %Y %H:%M:%S')", "iso": "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')", "sha": "sha256({})",
}

_T = "(1704067200 + doc_id * 420)"


def fields(spark: bool) -> dict[str, str]:
    """What each message says, as SQL."""
    d = _SPARK if spark else _DUCK
    text = lambda x: f"cast({x} as {d['s']})"
    domain = f"concat('d', {text(d['div'].format(8))}, '.example.net')"
    t0 = f"{_T} + 18000"  # the sender's clock shows -0500
    return {
        "doc_id": "doc_id", "email_id": f"concat('email-', {text('doc_id')})", "text": "text", "kind": "doc_id % 3", "domain": domain,
        "subject": f"concat('Re: ', {d['words']})",
        "display_name": "case doc_id % 4 when 0 then 'PayPal Support' when 1 then 'ceo@corp.example' when 2 then 'Desk' end",
        "from_address": f"concat('alerts', {text('doc_id % 50')}, '@', {domain})",
        "reply_to": f"case doc_id % 5 when 0 then 'help@reply.example.org' when 1 then concat('me@', {domain}) end",
        "return_path": f"case doc_id % 4 when 0 then 'bounce@other.example.com' when 1 then concat('b@', {domain}) end",
        "to1": f"concat('u', {text('doc_id % 100')}, '@corp.example')", "to2": f"concat('v', {text('doc_id % 7')}, '@corp.example')",
        "date": d["iso"].format(t0), "date_rfc": d["rfc"].format(_T),
        "priority": "case doc_id % 8 when 0 then '1 (Highest)' when 1 then '3' end",
        "spam_status": "case doc_id % 6 when 0 then 'Yes, score=12.4 required=5.0' when 1 then 'No, score=0.3' end", "spam_header": "case doc_id % 12 when 1 then '7.5' end",
        "spf": "case doc_id % 5 when 0 then 'fail' when 1 then 'softfail' when 2 then 'neutral' when 3 then 'pass' else 'none' end",
        "dkim": "case doc_id % 3 when 0 then 'fail' when 1 then 'pass' else 'none' end", "dmarc": "case doc_id % 4 when 0 then 'fail' when 1 then 'pass' when 2 then 'pass' else 'none' end",
        "filename": f"concat('invoice-', {text('doc_id % 20')}, case doc_id % 5 when 0 then '.exe' when 1 then '.ZIP' when 2 then '.pdf' when 3 then '.txt' else '' end)",
        "hop_ip": f"concat('45.33.', {text('doc_id % 250')}, '.', {text('doc_id % 200')})",
        "rfc1": d["rfc"].format(_T), "rfc2": d["rfc"].format(f"{t0} + 30"), "rfc3": d["rfc"].format(f"{t0} + 30 + case doc_id % 7 when 0 then 900 else 60 end"),
        "iso1": d["iso"].format(t0), "iso2": d["iso"].format(f"{t0} + 30"), "iso3": d["iso"].format(f"{t0} + 30 + case doc_id % 7 when 0 then 900 else 60 end"),
        "late": "case doc_id % 7 when 0 then 900.0 else 60.0 end", "sha": d["sha"].format("text"),
    }


def _line(name: str, value: str) -> str:
    return f"case when {value} is null then '' else concat('{name}: ', {value}, chr(10)) end"


def raw_message(spark: bool) -> str:
    """The message as SQL over the fields."""
    b64 = (_SPARK if spark else _DUCK)["b64"]
    number = f"cast(doc_id as {(_SPARK if spark else _DUCK)['s']})"
    sender = "concat(case when display_name is null then '' else concat('\"', display_name, '\" ') end, '<', from_address, '>')"
    hops = [
        f"concat('from relay2.example.org ([', hop_ip, ']) by mx.corp.example with ESMTPS id q3-', {number}, chr(10), '  for <', to1, '>; Tue, ', rfc3, ' +0000 (UTC)')",
        f"concat('from edge (10.1.2.3) by relay2.example.org with HTTP id q2-', {number}, '; ', rfc2, ' GMT')",
        f"concat('from [192.168.0.7] by edge with SMTP id q1-', {number}, case doc_id % 5 when 0 then '' else concat('; Mon, ', rfc1, ' -0500') end)",
    ]
    head = [
        _line("Return-Path", "concat('<', return_path, '>')" if spark else "'<' || return_path || '>'"), *(_line("Received", h) for h in hops),
        "case when kind = 2 then concat('Received-SPF: ', spf, ' (mx.corp.example)', chr(10)) else concat('Authentication-Results: mx.corp.example; spf=', spf, ' smtp.mailfrom=x; dkim = ', upper(dkim), ';', chr(10), chr(9), 'dmarc=', dmarc, chr(10)) end",
        _line("From", sender), "concat('To: ', to1, ', \"V, W\" <', to2, '>', chr(10))", _line("Reply-To", "reply_to"),
        f"concat('Subject: ', case when kind = 2 then concat('=?UTF-8?B?', {b64.format('subject')}, '?=') else subject end, chr(10))",
        "concat('Date: Mon, ', date_rfc, ' -0500', chr(10))", f"concat('Message-ID: <m', {number}, '@', domain, '>', chr(10), 'References: <a@x> <b@y>', chr(10))",
        _line("X-Priority", "priority"), _line("X-Spam-Status", "spam_status"), _line("X-Spam-Score", "spam_header"), "concat('X-Originating-IP: [', hop_ip, ']', chr(10), 'X-Campaign: c', chr(10), 'X-Campaign: d', chr(10), 'MIME-Version: 1.0', chr(10))",
    ]
    part = "'Content-Type: text/plain; charset=utf-8', chr(10), 'Content-Transfer-Encoding: 8bit', chr(10), chr(10), text"
    file = f"'--=_part', chr(10), 'Content-Type: application/octet-stream', chr(10), 'Content-Disposition: attachment; filename=\"', filename, '\"', chr(10), 'Content-Transfer-Encoding: base64', chr(10), chr(10), {b64.format('concat(filename, text)')}, chr(10)"
    html = "'--=_part', chr(10), 'Content-Type: text/html; charset=utf-8', chr(10), chr(10), '<p>', from_address, '</p>', chr(10)"
    mixed = f"concat('Content-Type: multipart/mixed; boundary=\"=_part\"', chr(10), chr(10), '--=_part', chr(10), {part}, chr(10), {html}, {file}, '--=_part--', chr(10))"
    return f"concat({', '.join(head)}, case when kind = 1 then {mixed} else concat({part}) end)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields, and ``content``: the message in bytes."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    out = docs.select(*(F.expr(e).alias(c) for c, e in fields(True).items()))
    return out.withColumn("content", F.encode(F.expr(raw_message(True)), "utf-8"))


MAIL_SQL = f"WITH mail AS (SELECT {', '.join(f'{e} AS {c}' for c, e in fields(False).items())} FROM documents WHERE text IS NOT NULL)"
