"""Risk scores, levels and reasons (G4, G8-G11, G13, G14) as column functions over feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("benign", "spam", "phishing", "bec", "impersonation")
# Points of the signals, and what the model and they may add at most.
POINTS = {
    "spf_fail": 10, "spf_softfail": 5, "dkim_fail": 10, "dmarc_fail": 10, "reply_to_mismatch": 8, "return_path_mismatch": 5, "ip_based_urls": 8,
    "has_credentials_in_url": 10, "executable_attachments": 12, "html_destination_mismatch": 7, "display_name_privileged": 5, "body_wire_transfer_mention": 8,
    "body_gift_card_mention": 6, "url_reputation": 15, "domain_reputation": 12, "ip_reputation": 10,
}
MODEL_MOST, SIGNALS_MOST = 70.0, 50.0
#: Techniques by label.
TECHNIQUES = {"phishing": ("T1566.002", "T1071.001"), "bec": ("T1534", "T1566"), "impersonation": ("T1566.002", "T1036.007"), "spam": ("T1566",)}


def level(score: Column) -> Column:
    """LOW, MEDIUM from 25, HIGH from 50, CRITICAL from 75."""
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def normalized(p: dict[str, Column]) -> dict[str, Column]:
    """Probabilities that sum to 1; without any, all is benign."""
    p = {k: F.coalesce(c, F.lit(0.0)) for k, c in p.items()}
    total = sum(p.values(), F.lit(0.0))
    return {k: F.when(total > 0, c / total).otherwise(1.0 if k == "benign" else 0.0) for k, c in p.items()}


def best_label(p: dict[str, Column]) -> Column:
    """The first class with the largest probability."""
    most, out = F.greatest(*p.values()), F.lit(None).cast("string")
    for k in reversed(list(p)):
        out = F.when(p[k] == most, k).otherwise(out)
    return out


def heuristic(f=F.col) -> dict[str, Column]:
    """Class probabilities from signals alone, rounded to 4 digits."""
    least = lambda c, most: F.least(F.lit(most), c)
    threat = (
        f("spf_fail") * 0.15 + f("dkim_fail") * 0.15 + f("dmarc_fail") * 0.15 + least(f("url_count") * 0.05, 0.15) + f("ip_based_urls") * 0.15
        + f("reply_to_mismatch") * 0.10 + least(f("urgency_keyword_hits") * 0.03 + f("credential_keyword_hits") * 0.05, 0.15)
    )
    threat = F.greatest(F.lit(0.0), F.least(F.lit(0.9), threat))
    shares = {"phishing": 0.5, "spam": 0.2, "bec": 0.15, "impersonation": 0.15}
    return {k: F.round(1.0 - threat if k == "benign" else threat * shares[k], 4) for k in CLASSES}


def signals(f=F.col, intel: dict[str, Column] | None = None) -> list[tuple[Column, float, Column]]:
    """(condition, points, reason) in the order of the reasons."""
    one = lambda c: f(c) == 1.0
    count = lambda text, c: F.concat(F.lit(text), F.lit(" ("), f(c).cast("int").cast("string"), F.lit(")"))
    rules = [
        (one("spf_fail"), "spf_fail", F.lit("SPF failed")),
        (~one("spf_fail") & one("spf_softfail"), "spf_softfail", F.lit("SPF soft-failed")),
        (one("dkim_fail"), "dkim_fail", F.lit("DKIM failed")),
        (one("dmarc_fail"), "dmarc_fail", F.lit("DMARC failed")),
        (one("reply_to_mismatch"), "reply_to_mismatch", F.lit("Reply-To domain is not the sender's")),
        (one("return_path_mismatch"), "return_path_mismatch", F.lit("Return-Path domain is not the sender's")),
        (f("ip_based_urls") > 0, "ip_based_urls", count("links to bare addresses", "ip_based_urls")),
        (one("has_credentials_in_url"), "has_credentials_in_url", F.lit("link with credentials")),
        (one("html_destination_mismatch"), "html_destination_mismatch", F.lit("link text and destination differ")),
        (f("executable_attachments") > 0, "executable_attachments", count("executable attachments", "executable_attachments")),
        (one("display_name_privileged"), "display_name_privileged", F.lit("privileged display name")),
        (one("body_wire_transfer_mention"), "body_wire_transfer_mention", F.lit("wire transfer mentioned")),
        (one("body_gift_card_mention"), "body_gift_card_mention", F.lit("gift card mentioned")),
    ]
    for name, verdict in (intel or {}).items():
        rules.append((F.lower(F.coalesce(verdict, F.lit(""))) == "malicious", name, F.lit(f"{name.split('_')[0]} known as malicious")))
    return [(c, float(POINTS[k]), r) for c, k, r in rules]


def assessment(p: dict[str, Column], f=F.col, intel: dict[str, Column] | None = None) -> Column:
    """struct(label, confidence, score, level, reasons) from class probabilities and features."""
    p = normalized(p)
    label, confidence = best_label(p), F.greatest(*p.values())
    model = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - p["benign"])) * MODEL_MOST
    rules = signals(f, intel)
    extra = sum((F.when(c, points).otherwise(0.0) for c, points, _ in rules), F.lit(0.0))
    score = F.least(F.lit(100.0), model + F.least(F.lit(SIGNALS_MOST), extra))
    count = lambda text, c: F.when(f(c) > 0, F.concat(F.lit(text), F.lit(" ("), f(c).cast("int").cast("string"), F.lit(")")))
    first = F.when((confidence >= 0.6) & (label != "benign"), F.concat(F.lit("high probability of "), label))
    words = (count("urgent language", "urgency_keyword_hits"), count("financial language", "financial_keyword_hits"), count("credential language", "credential_keyword_hits"))
    found = F.array_distinct(F.array_compact(F.array(first, *(F.when(c, r) for c, _, r in rules), *words)))
    none = F.array(F.when(score < 25, "no indicators").otherwise("raised by the model"))
    return F.struct(label.alias("label"), confidence.alias("confidence"), score.alias("score"), level(score).alias("level"), F.when(F.size(found) > 0, found).otherwise(none).alias("reasons"))


def tally_score(tally: Column, most: float = 100.0, digits: int = 2) -> Column:
    """struct(score, category) of an evidence tally."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(most), tally))
    return F.struct(F.round(score, digits).alias("score"), level(score).alias("category"))


def fused_score(probability: Column, tally: Column, most: float = 100.0, model: float = 0.5, evidence: float = 0.5, digits: int = 2) -> Column:
    """struct(score, category) of model and evidence together."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (model * unit(probability) + evidence * unit(tally / max(most, 1.0))) * 100))
    return F.struct(F.round(score, digits).alias("score"), level(score).alias("category"))


def techniques(label: Column, executable: Column) -> Column:
    """Technique ids of a label, with the attachment technique for executables."""
    none, out = F.array().cast("array<string>"), F.array().cast("array<string>")
    for name, ids in TECHNIQUES.items():
        out = F.when(label == name, F.array(*map(F.lit, ids))).otherwise(out)
    return F.array_union(out, F.when(executable > 0, F.array(F.lit("T1566.001"))).otherwise(none))
