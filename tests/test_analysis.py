"""Raw messages to verdicts: one message for each band, with and without snapshots."""

import base64

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import analysis as an

AT = "2024-06-01T00:00:00Z"


def mail(head, body="", parts=()):
    lines = "\r\n".join(head)
    if not parts:
        return bytearray(f"{lines}\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{body}".encode())
    text = f"--b\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{body}\r\n"
    files = "".join(f'--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="{n}"\r\nContent-Transfer-Encoding: base64\r\n\r\n{base64.b64encode(c).decode()}\r\n' for n, c in parts)
    return bytearray(f'{lines}\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n{text}{files}--b--\r\n'.encode())


HOPS = ["Received: from out.sender.example ([45.33.1.9]) by mx.corp.example with ESMTPS id 2 for <joe@corp.example>; Tue, 2 Jan 2024 10:10:00 +0000", "Received: from [192.168.1.4] by out.sender.example with ESMTP id 1; Tue, 2 Jan 2024 10:00:00 +0000"]
MAILS = {
    "low": mail([*HOPS, "Authentication-Results: mx; spf=pass; dkim=pass; dmarc=pass", "From: Ann <ann@garden.example>", "Return-Path: <ann@garden.example>", "To: joe@corp.example", "Subject: Spring notes", "Date: Tue, 2 Jan 2024 10:00:00 +0000"], "The tulips are doing well this year. See you on Sunday."),
    "medium": mail([*HOPS, "Authentication-Results: mx; spf=softfail; dkim=fail; dmarc=none", "From: Chief <ceo@corp-office.example>", "Reply-To: ceo77@mailbox.example", "To: joe@corp.example", "Subject: Quick favour", "Date: Tue, 2 Jan 2024 10:00:00 +0000"], "Are you at your desk? I need a favour before the meeting."),
    "high": mail([*HOPS, "Authentication-Results: mx; spf=fail; dkim=fail; dmarc=fail", "From: Desk <desk@shop.example>", "Reply-To: x@other.example", "To: joe@corp.example", "Subject: Your parcel", "Date: Tue, 2 Jan 2024 10:00:00 +0000"], "Your parcel waits."),
    "critical": mail(
        [*HOPS, "Authentication-Results: mx; spf=fail; dkim=fail; dmarc=fail", "From: PayPal <alerts@paypa1.com>", "Reply-To: help@other.example", "Return-Path: <b@third.example>", "To: joe@corp.example", "X-Priority: 1", "X-Spam-Status: Yes, score=12.4", "Subject: Verify your account", "Date: Tue, 2 Jan 2024 10:00:00 +0000"],
        "Urgent: verify your password at http://paypa1.com/login or http://203.0.113.9/x", [("run.exe", b"payload")],
    ),
    "broken": bytearray(b""),
}


@pytest.fixture(scope="module")
def found(spark):
    raw = spark.createDataFrame(list(MAILS.items()), "email_id string, content binary")
    return {r.email_id: r for r in an.analyze(raw, an.snapshots(spark), AT).collect()}


def test_bands(found):
    bands = {"low": (0, 24, "LOW"), "medium": (25, 49, "MEDIUM"), "high": (50, 74, "HIGH"), "critical": (75, 100, "CRITICAL")}
    assert set(found) == set(MAILS)
    for k, (low, high, level) in bands.items():
        r = found[k]
        assert low <= r.risk_score <= high and r.risk_level == level and r.verdict.startswith(level), (k, r.risk_score, [f.factor for f in r.factors])
    assert found["broken"].risk_score <= 24 and found["broken"].urls == [] and found["broken"].hops == []


def test_a_whole_report(found):
    r = found["critical"]
    assert (r.spf, r.dkim, r.dmarc, r.spf_source) == ("fail", "fail", "fail", "recorded") and (r.origin.ip, len(r.hops), r.hops[0].from_ip, r.hops[1].delay_s) == ("45.33.1.9", 2, "192.168.1.4", 600.0)
    factors = {f.factor: f.points for f in r.factors}
    assert {"spf_fail", "dkim_fail", "dmarc_fail", "reply_to_mismatch", "return_path_mismatch", "spam_flagged", "high_priority", "content_urgency", "suspicious_url", "typosquat_domain", "executable_attachment"} <= set(factors) and factors["suspicious_url"] == 20
    assert {u.url for u in r.urls} == {"http://paypa1.com/login", "http://203.0.113.9/x"} and all(u.suspicious for u in r.urls)
    assert {d.domain: d.typosquat for d in r.domains}["paypa1.com"] and [(a.filename, a.size, a.executable) for a in r.attachments] == [("run.exe", 7, True)]
    assert {s.category for s in r.signals} >= {"auth", "header", "smtp", "ioc"} and len({s.signal_id for s in r.signals}) == len(r.signals)
    assert [e.event for e in r.timeline][-1] == "FORENSIC_ANALYSIS_COMPLETE" and sorted(e.at for e in r.timeline) == [e.at for e in r.timeline]
    assert (r.answer.sender_domain, r.answer.origin_ip, r.answer.attachment_count) == ("paypa1.com", "45.33.1.9", 1) and {n.type for n in r.graph.nodes} >= {"email", "domain", "hop", "ip", "url", "attachment", "hash", "threat"}
    assert found["low"].factors == [] and found["low"].briefing.vector.deception == "none" and found["medium"].spf == "softfail"


def test_snapshots_decide(spark):
    """Evaluated SPF and DMARC beat recorded verdicts; networks, reputations and assessments add their points."""
    frame = lambda rows, name: spark.createDataFrame(rows, an.SCHEMAS[name])
    sha = spark.createDataFrame([(bytearray(b"payload"),)], "x binary").select(F.sha2("x", 256)).first()[0]
    known = an.snapshots(
        spark,
        spf=frame([("garden.example", "v=spf1 ip4:10.0.0.0/8 -all"), ("shop.example", "v=spf1 ip4:192.168.0.0/16 -all")], "spf"), dmarc=frame([("garden.example", "v=DMARC1; p=reject"), ("shop.example", "v=DMARC1; p=none")], "dmarc"),
        prefixes=frame([("45.33.0.0/16", "AS9", "NordVPN Ltd", "DE")], "prefixes"), reputation=frame([("45.33.1.9", 80, 3, True)], "reputation"), hashes=frame([(sha, "available", 4)], "hashes"),
        links=frame([("scanner", "http://203.0.113.9/x", "available", True, 90), ("sandbox", "http://paypa1.com/login", "timeout", True, 90)], "links"),
        assessments=frame([("low", "available", "Phishing", 95.0), ("medium", "available", "suspicious", 0.9), ("high", "error", "phishing", 1.0), ("critical", "available", "benign", 1.0)], "assessments"),
    )
    raw = spark.createDataFrame(list(MAILS.items()), "email_id string, content binary")
    got = {r.email_id: r for r in an.analyze(raw, known, AT).collect()}
    factors = {k: {f.factor: f.points for f in r.factors} for k, r in got.items()}
    assert (got["low"].spf, got["low"].spf_source, got["low"].dmarc, got["low"].dmarc_policy) == ("fail", "evaluated", "fail", "reject")
    assert (got["high"].spf, got["high"].dmarc, got["medium"].spf_source) == ("pass", "pass", "recorded")
    assert factors["low"] | {"spf_fail": 15, "dmarc_fail": 15, "tor_exit": 15, "vpn": 8, "abuse_malicious": 15, "assessment_sure": 15} == factors["low"]
    assert factors["medium"]["assessment_other"] == 10 and not {"assessment_sure", "assessment_other"} & (set(factors["high"]) | set(factors["critical"]))
    assert factors["critical"]["file_verdict"] == 20 and factors["critical"]["link_verdict"] == 20 and "sandbox_verdict" not in factors["critical"]
    assert (got["low"].origin.asn, got["low"].origin.vpn, got["low"].origin.tor, got["low"].abuse.score) == ("AS9", True, True, 80)
    assert got["low"].telemetry == round(5 / 6, 2) and got["critical"].telemetry == 1.0


def test_no_messages(spark):
    assert an.analyze(spark.createDataFrame([], "email_id string, content binary"), an.snapshots(spark), AT).isEmpty()
