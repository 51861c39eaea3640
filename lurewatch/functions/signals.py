"""Risk signals, explainable score, timeline, briefing and forensic graph of analysed mails.

All are column expressions over a report table, one row per mail:

``email_id, spf, dkim, dmarc, spf_domain, sender_ip, dkim_selector, dkim_key_bits, dmarc_policy, dmarc_domain, message_id, subject, date, analyzed_at,
from_address, display_name, to ARRAY, reply_to, return_path, reply_to_mismatch, return_path_mismatch, display_name_spoofing, spam_status, spam_score, priority, originating_ip``,
``hops ARRAY<STRUCT<hop, from_host, from_ip, by_host, protocol, delay_s, ts, flags>>``, ``urls ARRAY<STRUCT<url, domain, defanged, source, suspicious>>``,
``domains ARRAY<STRUCT<domain, homoglyph, typosquat>>``, ``ips ARRAY<STRING>``, ``attachments ARRAY<STRUCT<filename, content_type, size, sha256, executable, archive, office>>``,
``origin STRUCT<ip, asn, org, isp, country, city, cloud, vpn, tor>``, ``model STRUCT<label, confidence>``,
``abuse STRUCT<status, score>``, optionally ``assessment STRUCT<status, label, confidence>``, ``link_hits, link_seen, file_hits, file_seen, sandbox_hits INT`` (confirmed and answered look-ups).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import level

# Points of the explainable score, bounds, and the verdict for each case.
POINTS = {
    "spf_fail": 15, "spf_softfail": 8, "dkim_fail": 15, "dmarc_fail": 15, "reply_to_mismatch": 10, "return_path_mismatch": 8, "display_name_spoofing": 12, "spam_flagged": 12, "high_priority": 5,
    "suspicious_url": 10, "homoglyph_domain": 12, "typosquat_domain": 12, "executable_attachment": 20, "model_threat": 20, "model_spam": 15, "content_urgency": 8, "credential_prompt": 10,
    "tor_exit": 15, "vpn": 8, "abuse_malicious": 15, "abuse_suspicious": 8, "link_verdict": 20, "file_verdict": 20, "sandbox_verdict": 15,
    "assessment_sure": 15, "assessment_other": 10,
}
ASSESSED, ASSESSED_SURE, SURE_LEAST = ("phishing", "bec", "malware", "social_engineering", "suspicious"), ("phishing", "malware"), 0.8
MOST_URL_POINTS, MODEL_LEAST, SPAM_SCORE_LEAST, SOURCES = 20, 0.6, 5.0, 6
VERDICTS = {
    "critical_malicious": "CRITICAL RISK - CONFIRMED MALICIOUS INDICATORS", "critical_other": "CRITICAL RISK - MULTIPLE AUTH & INFRASTRUCTURE ANOMALIES",
    "high_lookalike": "HIGH RISK - BRAND TYPOSQUATTING & DECEPTION DETECTED", "high_both": "HIGH RISK - PHISHING INDICATORS WITH AUTH FAILURE",
    "high_malicious": "HIGH RISK - SUSPICIOUS INFRASTRUCTURE & INDICATORS", "high_auth": "HIGH RISK - AUTHENTICATION FAILURE & SPOOFING DETECTED", "high_other": "HIGH RISK - MULTIPLE THREAT INDICATORS",
    "medium_spam": "MEDIUM RISK - SPAM / UNWANTED EMAIL DETECTED", "medium_other": "MEDIUM RISK - SUSPICIOUS INDICATORS REQUIRE REVIEW",
    "low_none": "LOW RISK - NO THREAT INDICATORS DETECTED", "low_some": "LOW RISK - MINOR ANOMALIES DETECTED",
}
#: How many entries of a kind enter the graph.
GRAPH_MOST = {"to": 3, "urls": 8, "domains": 6, "attachments": 4, "signals": 3}
_C = F.col


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts))


def _signal(when: Column, severity, text: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(_is(when), F.struct(severity.alias("level"), text.alias("text")))


def _listed(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def spam_flagged(status: Column, score: Column) -> Column:
    return _is(status.isNotNull() & (F.contains(F.lower(status), F.lit("yes")) | _is(score >= SPAM_SCORE_LEAST)))


def high_priority(priority: Column) -> Column:
    return _is(F.trim(priority).startswith("1"))


def risk_signals() -> Column:
    """Array of struct(signal_id, category, level, text); ids count within the mail and category."""
    spf, dkim, dmarc = _C("spf"), _C("dkim"), _C("dmarc")
    auth = _listed(
        _signal(spf.isin("fail", "softfail"), F.when(spf == "fail", "high").otherwise("medium"), _say("SPF ", spf, ": address not allowed by ", _C("spf_domain"))),
        _signal(spf == "none", "low", F.lit("no SPF record")),
        _signal(dkim == "fail", "high", F.lit("DKIM signature does not verify")),
        _signal(dkim == "none", "low", F.lit("no DKIM signature")),
        _signal(dmarc == "fail", "high", _say("DMARC failed, policy ", _C("dmarc_policy"))),
        _signal(dmarc == "none", "low", F.lit("no DMARC record")),
        _signal((_C("dkim_key_bits") > 0) & (_C("dkim_key_bits") < 1024), "medium", _say("weak DKIM key of ", _C("dkim_key_bits"), " bits")),
    )
    header = _listed(
        _signal(_C("reply_to_mismatch"), "medium", _say("Reply-To ", _C("reply_to"), " is of another domain")),
        _signal(_C("return_path_mismatch"), "medium", _say("Return-Path ", _C("return_path"), " is of another domain")),
        _signal(_C("display_name_spoofing"), "high", _say("display name holds an address: ", _C("display_name"))),
        _signal(spam_flagged(_C("spam_status"), _C("spam_score")), "high", _say("flagged as spam upstream: ", F.coalesce(_C("spam_score").cast("string"), _C("spam_status")))),
        _signal(high_priority(_C("priority")), "medium", F.lit("highest priority (urgency)")),
    )

    def of_hop(h: Column) -> Column:
        has = lambda flag: F.array_contains(h["flags"], flag)
        return _listed(
            _signal(has("time_skew"), "medium", _say("time skew at hop ", h["hop"], ": ", h["delay_s"], " s")),
            _signal(has("private_ip"), "low", _say("inner address at hop ", h["hop"], ": ", h["from_ip"])),
            _signal(has("protocol_mismatch"), "medium", _say("protocol ", h["protocol"], " at hop ", h["hop"])),
        )

    def of_domain(d: Column) -> Column:
        return _listed(_signal(d["homoglyph"], "high", _say("lookalike letters in ", d["domain"])), _signal(d["typosquat"], "high", _say("resembles a brand: ", d["domain"])))

    def of_file(a: Column) -> Column:
        odd = _is(a["archive"]) | _is(a["office"])
        return _listed(F.coalesce(_signal(a["executable"], "critical", _say("executable attachment ", a["filename"])), _signal(odd, "medium", _say("risky attachment ", a["filename"]))))

    links = F.array_compact(F.transform("urls", lambda u: _signal(u["suspicious"], "high", _say("suspicious link ", u["defanged"]))))
    ioc = F.concat(links, F.flatten(F.transform("domains", of_domain)), F.flatten(F.transform("attachments", of_file)))
    origin = _listed(
        _signal(_C("origin.cloud"), "info", _say("sent from a hosting provider: ", _C("origin.org"))),
        _signal(_C("origin.vpn"), "medium", _say("sent through an anonymizer: ", _C("origin.org"))),
        _signal(_C("origin.tor"), "high", _say("sent from a Tor exit: ", _C("origin.ip"))),
    )

    def numbered(category: str, found: Column) -> Column:
        ident = lambda i: F.concat(F.lit(f"{category.upper()}-"), F.lpad((i + 1).cast("string"), 3, "0"))
        return F.transform(found, lambda s, i: F.struct(ident(i).alias("signal_id"), F.lit(category).alias("category"), s["level"].alias("level"), s["text"].alias("text")))

    return F.concat(numbered("auth", auth), numbered("header", header), numbered("smtp", F.flatten(F.transform("hops", of_hop))), numbered("ioc", ioc), numbered("origin", origin))


def _factor(when: Column, name: str, category: str, points=None) -> Column:
    points = F.lit(POINTS[name]) if points is None else points
    return F.when(_is(when) & (points > 0), F.struct(F.lit(name).alias("factor"), F.lit(category).alias("category"), points.cast("int").alias("points")))


def _assessed(column: str) -> tuple[Column, Column]:
    """Whether a supporting assessment, struct(status, label, confidence), calls the mail a threat, and whether it is sure; confidences over 1 are per cent."""
    label, conf = F.lower(_C(column)["label"]), _C(column)["confidence"]
    conf = F.when(conf > 1, conf / 100).otherwise(conf)
    threat = _is((_C(column)["status"] == "available") & label.isin(*ASSESSED))
    return threat, threat & _is(label.isin(*ASSESSED_SURE) & (conf >= SURE_LEAST))


def score_factors(credential_hits: Column | None = None, assessment: str | None = None) -> Column:
    """Array of struct(factor, category, points) in order; ``credential_hits`` (H1) and the column of a supporting ``assessment`` are off unless given."""
    threat, certain = _assessed(assessment) if assessment else (F.lit(False), F.lit(False))
    conf, label = _C("model.confidence"), _C("model.label")
    sure = _is(conf >= MODEL_LEAST)
    share = lambda name: F.least(F.lit(float(POINTS[name])), F.bround(conf * POINTS[name]))
    n_urls = F.size(F.filter("urls", lambda u: _is(u["suspicious"])))
    urgent = high_priority(_C("priority"))  # the priority signal speaks of urgency and counts as content, too
    told = F.lower(_C("abuse.status")).isin("available", "confirmed_malicious", "suspicious")
    worst = told & ((_C("abuse.score") >= 75) | (_C("abuse.status") == "confirmed_malicious"))
    odd = told & ~_is(worst) & ((_C("abuse.score") >= 25) | (_C("abuse.status") == "suspicious"))
    return _listed(
        _factor(_C("spf") == "fail", "spf_fail", "auth"), _factor(_C("spf") == "softfail", "spf_softfail", "auth"), _factor(_C("dkim") == "fail", "dkim_fail", "auth"), _factor(_C("dmarc") == "fail", "dmarc_fail", "auth"),
        *(_factor(_C(c), c, "header") for c in ("reply_to_mismatch", "return_path_mismatch", "display_name_spoofing")),
        _factor(spam_flagged(_C("spam_status"), _C("spam_score")), "spam_flagged", "header"), _factor(urgent, "high_priority", "header"),
        _factor(n_urls > 0, "suspicious_url", "ioc", F.least(F.lit(MOST_URL_POINTS), n_urls * POINTS["suspicious_url"])),
        _factor(F.exists("domains", lambda d: _is(d["homoglyph"])), "homoglyph_domain", "ioc"), _factor(F.exists("domains", lambda d: _is(d["typosquat"])), "typosquat_domain", "ioc"),
        _factor(F.exists("attachments", lambda a: _is(a["executable"])), "executable_attachment", "ioc"),
        _factor(sure & label.isin("phishing", "impersonation", "bec"), "model_threat", "content_ml", share("model_threat")), _factor(sure & (label == "spam"), "model_spam", "content_ml", share("model_spam")),
        _factor(urgent, "content_urgency", "content_ml"), _factor(F.lit(0) < (F.lit(0) if credential_hits is None else credential_hits), "credential_prompt", "content_ml"),
        _factor(_C("origin.tor"), "tor_exit", "origin"), _factor(_C("origin.vpn"), "vpn", "origin"),
        _factor(worst, "abuse_malicious", "origin"), _factor(odd, "abuse_suspicious", "origin"),
        _factor(_C("link_hits") > 0, "link_verdict", "threat_intel"), _factor(_C("file_hits") > 0, "file_verdict", "threat_intel"),
        _factor((_C("sandbox_hits") > 0) & ~_is(_C("link_hits") > 0), "sandbox_verdict", "threat_intel"),
        _factor(certain, "assessment_sure", "threat_intel"), _factor(threat & ~certain, "assessment_other", "threat_intel"),
    )


def telemetry_confidence(assessment: str | None = None) -> Column:
    """Answered sources, a supporting assessment of a threat among them, by six, between 0.2 and 1, rounded to 2 digits."""
    told = F.lower(_C("abuse.status")).isin("available", "confirmed_malicious", "suspicious")
    answers = (_C("spf").isin("pass", "fail", "softfail"), _C("dkim").isin("pass", "fail"), _C("dmarc").isin("pass", "fail"), told, (_C("link_hits") > 0) | (_C("link_seen") > 0), (_C("file_hits") > 0) | (_C("file_seen") > 0), *([_assessed(assessment)[0]] if assessment else []))
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.2), sum((_is(a).cast("int") for a in answers), F.lit(0)) / SOURCES)), 2)


def verdict(risk: Column, factors: Column) -> Column:
    """The verdict of a risk level and the factors."""
    any_of = lambda test: F.exists(factors, test)
    auth = any_of(lambda f: f["factor"].isin("spf_fail", "dkim_fail", "dmarc_fail"))
    bad = any_of(lambda f: f["category"].isin("threat_intel", "ioc"))
    alike = any_of(lambda f: f["factor"].isin("typosquat_domain", "homoglyph_domain"))
    spam = any_of(lambda f: f["factor"].isin("spam_flagged", "model_spam"))
    v = VERDICTS
    high = F.when(alike & (auth | bad), v["high_lookalike"]).when(auth & bad, v["high_both"]).when(bad, v["high_malicious"]).when(auth, v["high_auth"]).otherwise(v["high_other"])
    low = F.when(F.size(factors) == 0, v["low_none"]).otherwise(v["low_some"])
    return (
        F.when(risk == "CRITICAL", F.when(bad, v["critical_malicious"]).otherwise(v["critical_other"]))
        .when(risk == "HIGH", high).when(risk == "MEDIUM", F.when(spam, v["medium_spam"]).otherwise(v["medium_other"])).otherwise(low)
    )


def actions(risk: Column, factors: Column) -> Column:
    """What to do, by level; an authentication failure adds a step at the high levels."""
    auth = F.exists(factors, lambda f: f["factor"].isin("spf_fail", "dkim_fail", "dmarc_fail"))
    urgent = F.array(*map(F.lit, ("leave links and attachments alone", "quarantine and report", "verify the sender by another channel", "block the domains and addresses found")))
    urgent = F.when(auth, F.array_append(urgent, F.lit("review the sender's SPF, DKIM and DMARC records"))).otherwise(urgent)
    some = F.array(*map(F.lit, ("read with care before following links or answering", "verify unexpected requests", "report odd behaviour")))
    return F.when(risk.isin("CRITICAL", "HIGH"), urgent).when(risk == "MEDIUM", some).otherwise(F.array(F.lit("no action needed"), F.lit("usual care with links and attachments")))


def explained(factors: Column, assessment: str | None = None) -> dict[str, Column]:
    """G3-G6 from a column of ``score_factors``: risk_score, risk_level, telemetry, verdict, actions."""
    total = F.least(F.lit(100), F.aggregate(factors, F.lit(0), lambda a, f: a + f["points"]))
    return {"risk_score": total, "risk_level": level(total), "telemetry": telemetry_confidence(assessment), "verdict": verdict(level(total), factors), "actions": actions(level(total), factors)}


def timeline() -> Column:
    """Array of struct(at, seq, category, event, severity, text), by time text and then by the order below; what has no time of its own is at ``analyzed_at``."""
    now = _C("analyzed_at")

    def event(category: str, name, severity, text: Column, at: Column = now, when: Column | None = None) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        e = F.struct(F.coalesce(F.nullif(at, F.lit("")), now).alias("at"), F.lit(category).alias("category"), as_column(name).alias("event"), as_column(severity).alias("severity"), text.alias("text"))
        return e if when is None else F.when(_is(when), e)

    def hop(h: Column) -> Column:
        flag = lambda f: F.array_contains(h["flags"], f)
        place = F.coalesce(h["by_host"], h["from_host"], F.concat(F.lit("relay "), h["hop"].cast("string")))
        severity = F.when(flag("private_ip"), "low").when(flag("time_skew"), "medium").otherwise("info")
        late = F.when(h["delay_s"].isNotNull(), F.concat(F.lit(", after "), h["delay_s"].cast("string"), F.lit(" s"))).otherwise("")
        return event("smtp", F.concat(F.lit("SMTP_HOP_"), h["hop"].cast("string")), severity, F.concat(_say("relayed by ", place), late), h["ts"])

    auth = [
        event("auth", f"{k.upper()}_CHECK", F.when(_C(k) == "fail", "high").when((F.lit(k) == "spf") & (_C(k) == "softfail"), "medium").otherwise("info"), _say(f"{k.upper()} result: ", _C(k)))
        for k in ("spf", "dkim", "dmarc")
    ]
    header = [
        event("header", name, severity, text, when=_C(c))
        for c, name, severity, text in (
            ("reply_to_mismatch", "REPLY_TO_MISMATCH", "medium", _say("reply to ", _C("reply_to"))), ("return_path_mismatch", "RETURN_PATH_MISMATCH", "medium", _say("return to ", _C("return_path"))),
            ("display_name_spoofing", "DISPLAY_NAME_SPOOFING", "high", _say("named ", _C("display_name"))),
        )
    ]
    links = F.array_compact(F.transform("urls", lambda u: event("ioc", "SUSPICIOUS_URL_FOUND", "high", _say("suspicious link ", u["defanged"]), when=u["suspicious"])))
    files = F.transform("attachments", lambda a: event("ioc", "ATTACHMENT_FOUND", F.when(_is(a["executable"]), "critical").otherwise("medium"), _say("attachment ", a["filename"])))
    origin = event("origin", "ORIGIN_IP_IDENTIFIED", F.when(_is(_C("origin.tor")), "critical").when(_is(_C("origin.vpn")), "high").otherwise("info"), _say("sent from ", _C("origin.ip"), " (", F.coalesce(_C("origin.country"), F.lit("unknown")), ")"), when=_C("origin.ip").isNotNull())
    first = event("email", "EMAIL_COMPOSED", "info", _say("written by ", F.coalesce(_C("from_address"), F.lit("unknown sender"))), _C("date"))
    last = event("system", "FORENSIC_ANALYSIS_COMPLETE", "info", F.lit("analysis complete"))
    events = F.concat(F.array(first), F.transform("hops", hop), F.array(*auth), _listed(*header), links, files, _listed(origin), F.array(last))
    ordered = F.transform(events, lambda e, i: F.struct(e["at"].alias("at"), (i + 1).alias("seq"), e["category"].alias("category"), e["event"].alias("event"), e["severity"].alias("severity"), e["text"].alias("text")))
    return F.array_sort(ordered)


# Names and tactics of the techniques.
TECHNIQUE_NAMES = {
    "T1566.002": ("Phishing: Spearphishing Link", "Initial Access"), "T1071.001": ("Application Layer Protocol: Web Protocols", "Command and Control"), "T1534": ("Internal Spearphishing", "Lateral Movement"),
    "T1566": ("Phishing", "Initial Access"), "T1036.007": ("Masquerading: Double File Extension / Name", "Defense Evasion"), "T1566.001": ("Phishing: Spearphishing Attachment", "Initial Access"),
}


def technique_details(ids: Column) -> Column:
    """Array of struct(id, name, tactic) of technique ids."""
    names, tactics = (F.create_map(*(F.lit(x) for k, v in TECHNIQUE_NAMES.items() for x in (k, v[j]))) for j in (0, 1))
    return F.transform(ids, lambda t: F.struct(t.alias("id"), names[t].alias("name"), tactics[t].alias("tactic")))


def attack_vector(label: Column, n_urls: Column) -> Column:
    """struct(deception, authentication, payload) of a classified report."""
    benign = label == "benign"
    deception = F.when(benign, "none").when(label == "bec", "executive impersonation").when(label == "phishing", "credential harvesting").when(label == "impersonation", "brand impersonation").otherwise("social engineering")
    failed = (_C("spf") == "fail") | (_C("dmarc") == "fail")
    auth = F.when(benign, "compliant").when(failed, "failed").when(_is(_C("reply_to_mismatch")), "manipulated headers").otherwise("bypassed or failed")
    executable = F.exists("attachments", lambda a: _is(a["executable"]))
    payload = F.when(benign, "clean").when(executable, "executable").when(n_urls > 0, "link").otherwise("none")
    return F.struct(deception.alias("deception"), auth.alias("authentication"), payload.alias("payload"))


def soc_actions(risk: Column, label: Column) -> Column:
    """Array of struct(priority, action), most urgent first of each rule."""
    one = lambda when, priority, text: F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(text).alias("action")))
    urgent = risk.isin("CRITICAL", "HIGH")
    found = _listed(
        one(urgent, "P1", "quarantine the mail in all mailboxes"), one(urgent, "P1", "block its domains and addresses at the gateway"), one(label.isin("phishing", "impersonation"), "P2", "reset passwords and end sessions"), one(label == "bec", "P1", "have finance verify by voice")
    )
    return F.when((F.size(found) == 0) & ~urgent, _listed(one(F.lit(True), "P3", "monitor and log"))).otherwise(found)


def incident_summary(label: Column, score: Column, risk: Column, reasons: Column) -> Column:
    """One sentence, with the first three reasons."""
    who = _say("mail '", _C("subject"), "' from ", _C("from_address"))
    clean = F.concat(who, _say(": nothing found, score ", score, " of 100"))
    why = F.when(F.size(reasons) > 0, F.concat(F.lit("; "), F.array_join(F.slice(reasons, 1, 3), "; "))).otherwise("")
    return F.when(label == "benign", clean).otherwise(F.concat(_say(risk, " ", label, ", score ", score, " of 100: "), who, why))


def sender_domain() -> Column:
    """Domain of the first of From, Return-Path and Reply-To that has one."""
    after = lambda c: F.when(F.contains(c, F.lit("@")), F.substring_index(c, "@", -1))
    return F.coalesce(*(after(_C(c)) for c in ("from_address", "return_path", "reply_to")), F.lit("unknown"))


def response() -> dict[str, Column]:
    """The flat fields of an answer about a report."""
    filled = lambda c: F.nullif(c, F.lit(""))
    ip = F.coalesce(filled(_C("origin.ip")), filled(_C("originating_ip")), filled(F.get("hops", 0)["from_ip"]), F.get("ips", 0), F.lit("unknown"))
    return {
        "sender_domain": sender_domain(), "origin_ip": ip, "spf_status": _C("spf"), "dkim_status": _C("dkim"), "dmarc_status": _C("dmarc"), "extracted_urls": F.transform("urls", lambda u: u["url"]),
        "attachment_count": F.size("attachments"), "smtp_hops": F.size("hops"), "reply_to_mismatch": _is(_C("reply_to_mismatch")), "return_path_mismatch": _is(_C("return_path_mismatch")),
        "display_name_spoofing": _is(_C("display_name_spoofing")), "country": F.coalesce(_C("origin.country"), F.lit("Unknown")), "asn": F.coalesce(_C("origin.asn"), _C("origin.isp"), F.lit("Unknown ASN")),
    }


def graph(signals: Column) -> tuple[Column, Column]:
    """Arrays of nodes struct(id, type) and of links struct(source, target, rel) of one mail.

    Nodes are distinct by id; links join different nodes.  ``GRAPH_MOST`` bounds the entries of a kind.
    """
    top = lambda c, kind: F.slice(c, 1, GRAPH_MOST[kind])
    node = lambda ident, kind: F.struct(ident.alias("id"), F.lit(kind).alias("type"))
    link = lambda a, b, rel: F.struct(a.alias("source"), b.alias("target"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"))
    some = lambda when, x: F.when(_is(when), x)
    subject = F.coalesce(F.nullif(F.left("subject", F.lit(28)), F.lit("")), _C("email_id"))
    mail, own = F.concat(F.lit("Email: "), subject), F.when(F.contains("from_address", F.lit("@")), F.lower(F.substring_index("from_address", "@", -1))).otherwise("unknown")
    sender, domain = F.concat(F.lit("From: "), "from_address"), F.concat(F.lit("Domain: "), own)
    has_sender = F.coalesce(_C("from_address"), F.lit("")) != ""
    people = F.transform(top(_C("to"), "to"), lambda t: F.concat(F.lit("To: "), t))
    hop_id = lambda h: F.concat(F.lit("Hop "), h["hop"].cast("string"), F.lit(": "), F.coalesce(h["by_host"], h["from_host"], h["from_ip"], F.concat(F.lit("Relay-"), h["hop"].cast("string"))))
    hops, n_hops = _C("hops"), F.size("hops")
    hop_ids = F.transform(hops, hop_id)
    wait = lambda h: F.concat(F.lit("RELAYS_TO (+"), F.coalesce(h["delay_s"].cast("string"), F.lit("0")), F.lit("s)"))
    path = F.transform(hops, lambda h, i: link(F.when(i == 0, domain).otherwise(hop_id(F.get(hops, i - 1))), hop_id(h), F.when(i == 0, "INITIAL_INJECTION").otherwise(wait(h))))
    with_ip = F.filter(hops, lambda h: h["from_ip"].isNotNull())
    ip_id = lambda h: F.concat(F.lit("IP: "), h["from_ip"])
    arrive = F.when(n_hops > 0, link(F.element_at(hop_ids, -1), mail, "INGRESS_GATEWAY")).otherwise(link(domain, mail, "DIRECT_DISPATCH"))
    origin, asn = F.concat(F.lit("Origin IP: "), "origin.ip"), F.coalesce(_C("origin.asn"), _C("origin.isp"))
    has_origin = _C("origin.ip").isNotNull()
    asn_id = F.concat(F.lit("ASN: "), F.when(F.contains(asn, F.lit(" ")), F.substring_index(asn, " ", 1)).otherwise(F.left(asn, F.lit(12))))
    place = F.concat(F.lit("Geo: "), F.coalesce(_C("origin.country"), F.lit("Unknown")), F.coalesce(F.concat(F.lit(", "), F.nullif(_C("origin.city"), F.lit(""))), F.lit("")))
    checks = {k: F.concat(F.lit(f"{k.upper()} ["), F.upper(k), F.lit("]")) for k in ("spf", "dkim", "dmarc")}
    rels = {"spf": "SPF_CHECK", "dkim": "DKIM_SIGNATURE", "dmarc": "DMARC_POLICY"}
    short = lambda u: F.coalesce(u["domain"], F.concat(F.left(u["url"], F.lit(24)), F.lit("...")))
    urls = F.transform(top(_C("urls"), "urls"), lambda u, i: F.struct(F.concat(F.lit("URL-"), (i + 1).cast("string"), F.lit(": "), short(u)).alias("id"), F.lower(u["domain"]).alias("domain")))
    targets = F.filter(urls, lambda u: _is(u["domain"] != own))
    found = F.filter(F.transform(top(_C("domains"), "domains"), lambda d: F.lower(d["domain"])), lambda d: d != own)
    files = F.transform(top(_C("attachments"), "attachments"), lambda a: F.struct(F.concat(F.lit("File: "), F.coalesce(a["filename"], F.lit("unnamed_payload.bin"))).alias("id"), F.concat(F.lit("Hash: "), F.left(a["sha256"], F.lit(12)), F.lit("...")).alias("hash")))
    alerts = F.transform(top(signals, "signals"), lambda s: F.concat(F.lit("Alert: "), s["signal_id"]))
    domain_id = lambda d: F.concat(F.lit("Domain: "), d)
    nodes = F.concat(
        F.array(node(mail, "email")), _listed(some(has_sender, node(sender, "identity")), node(domain, "domain")), F.transform(people, lambda p: node(p, "identity")),
        F.transform(hop_ids, lambda h: node(h, "hop")), F.transform(with_ip, lambda h: node(ip_id(h), "ip")), _listed(some(has_origin, node(origin, "ip")), some(has_origin & asn.isNotNull(), node(asn_id, "asn")), some(has_origin, node(place, "geo"))),
        F.array(*(node(c, "auth") for c in checks.values())), F.transform(urls, lambda u: node(u["id"], "url")), F.transform(targets, lambda u: node(domain_id(u["domain"]), "domain")), F.transform(found, lambda d: node(domain_id(d), "domain")),
        F.transform(files, lambda f: node(f["id"], "attachment")), F.transform(F.filter(files, lambda f: f["hash"].isNotNull()), lambda f: node(f["hash"], "hash")), F.transform(alerts, lambda a: node(a, "threat")),
    )
    links = F.concat(
        _listed(some(has_sender, link(mail, sender, "TRANSMITTED_BY")), some(has_sender & F.contains("from_address", F.lit("@")), link(sender, domain, "HOSTED_ON_DOMAIN")), some(~has_sender, link(mail, domain, "HOSTED_ON_DOMAIN"))),
        F.transform(people, lambda p: link(mail, p, "DELIVERED_TO")), path, F.transform(with_ip, lambda h: link(hop_id(h), ip_id(h), "RESOLVES_IP")), F.array(arrive),
        _listed(some(has_origin, link(domain, origin, "RESOLVES_ORIGIN")), some(has_origin & asn.isNotNull(), link(origin, asn_id, "ROUTED_THROUGH_ASN")), some(has_origin, link(origin, place, "LOCATED_IN"))),
        F.array(*(link(domain, c, rels[k]) for k, c in checks.items())), F.transform(urls, lambda u: link(mail, u["id"], "EMBEDS_HYPERLINK")), F.transform(targets, lambda u: link(u["id"], domain_id(u["domain"]), "HOSTED_ON_DOMAIN")),
        F.transform(found, lambda d: link(mail, domain_id(d), "REFERENCES_DOMAIN")), F.transform(files, lambda f: link(mail, f["id"], "CARRIES_ATTACHMENT")),
        F.transform(F.filter(files, lambda f: f["hash"].isNotNull()), lambda f: link(f["id"], f["hash"], "PAYLOAD_HASH")), F.transform(alerts, lambda a: link(mail, a, "FLAGGED_ANOMALY")),
    )
    return F.array_distinct(nodes), F.array_distinct(F.filter(links, lambda k: k["source"] != k["target"]))


