"""The 68 features of an email (H1-H9) as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword lists of the features.
URGENCY = ("urgent", "immediately", "asap", "action required", "verify now", "time sensitive", "time-sensitive", "important", "attention required", "expires", "expiring", "final notice", "last chance", "limited time", "act now", "respond immediately", "suspended", "your account")
FINANCIAL = ("invoice", "payment", "transfer", "wire", "bank account", "salary", "refund", "reimburs", "direct deposit", "gift card", "bitcoin", "cryptocurrency", "western union", "moneygram", "fund", "remittance")
CREDENTIAL = ("password", "login", "credential", "verify", "confirm", "authenticate", "sign in", "sign-in", "username", "account", "reset", "update your info", "secure your", "validate")
TITLES = ("ceo", "cfo", "cto", "coo", "president", "vice president", "vp", "director", "manager", "executive", "chief", "head of", "finance", "hr", "legal", "admin", "administrator")
TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".pw", ".click", ".download", ".zip", ".mov")
SUBJECT_URGENCY = ("urgent", "action required", "immediately", "asap", "expires")
IMPERSONATED = ("microsoft", "google", "amazon", "paypal", "apple")

#: Columns a mail row may have besides texts and urls; what is missing counts as null.
TEXTS = ("body", "subject", "sender", "reply_to", "return_path", "spf", "dkim", "dmarc", "arc")
NUMBERS = ("header_risk_tally", "header_findings_count", "received_hop_count", "attachment_count", "executable_attachments", "html_destination_mismatch", "ip_count", "private_ips", "html_link_count", "evidence_tally")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _hits(text: Column, words) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).cast("double")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _count(text: Column, one: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))


def _count_of(text: Column, kind: str) -> Column:
    """How many characters are of a kind that is rare in text."""
    return F.length(text) - F.length(F.regexp_replace(text, rf"\p{{{kind}}}+", ""))


def domain_of(address: Column) -> Column:
    """H9: lower-cased domain of an address, empty without one."""
    return F.lower(F.regexp_extract(address, r"@([a-zA-Z0-9.\-]+)[^@]*$", 1))


def display_name(address: Column) -> Column:
    """H9: the name before an address in angle brackets, without quotes."""
    return F.trim(F.regexp_replace(F.regexp_extract(address, r"^([^<]*)<", 1), '"', ""))


def _text_features(body: Column, subject: Column, low: Column, combined: Column, words: Column, n_syllables: Column) -> dict[str, Column]:
    """``low``: the body in lower case, ``combined``: with the subject before it, ``words``: of ``low``; all of them columns that are computed once."""
    n = F.greatest(F.length(body), F.lit(1))
    n_words = F.size(words)
    sentences = F.greatest(F.regexp_count(body, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.greatest(n_syllables, n_words)
    per_sentence, per_word = n_words / sentences, syllables / n_words
    length = F.length(body).cast("double")
    return {
        "text_length": length, "body_length": length, "body_char_count": length,
        "subject_length": F.length(subject).cast("double"),
        "combined_length": F.length(F.concat(subject, F.lit(" "), body)).cast("double"),
        "word_count": n_words.cast("double"), "subject_word_count": F.size(_words(subject)).cast("double"),
        "uppercase_ratio": _count_of(body, "Lu") / n, "digit_ratio": _count_of(body, "Nd") / n, "space_ratio": _count(body, " ") / n,
        "exclamation_count": _count(body, "!").cast("double"), "question_count": _count(body, "?").cast("double"),
        "dollar_sign_count": _count(body, "$").cast("double"), "at_sign_count": _count(body, "@").cast("double"),
        # our own definition: syllables are vowel groups, at least one a word
        "readability_flesch": F.when(n_words > 0, 206.835 - 1.015 * per_sentence - 84.6 * per_word).otherwise(0.0),
        "readability_grade": F.when(n_words > 0, 0.39 * per_sentence + 11.8 * per_word - 15.59).otherwise(0.0),
        "urgency_keyword_hits": _hits(combined, URGENCY), "financial_keyword_hits": _hits(combined, FINANCIAL), "credential_keyword_hits": _hits(combined, CREDENTIAL),
        "subject_has_re": _flag(F.lower(subject).startswith("re:")), "subject_has_fwd": _flag(F.lower(subject).rlike("^fwd?:")),
        "subject_all_caps": _flag((F.length(subject) > 3) & subject.rlike(r"\p{Lu}") & ~subject.rlike(r"\p{Ll}")),
        "lexical_diversity": F.when(n_words > 0, F.size(F.array_distinct(words)) / n_words).otherwise(0.0),
    }


def _entropy(url: Column) -> Column:
    n = F.length(url)
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    return -F.aggregate(counts, F.lit(0.0), lambda acc, p: F.when(p > 0, acc + p * F.log2(p)).otherwise(acc))


def _url_features(urls: Column) -> dict[str, Column]:
    n = F.size(urls)
    count = lambda test: F.size(F.filter(urls, test)).cast("double")
    mean = lambda values: F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    host = lambda u: F.split_part(F.split_part(F.regexp_replace(u, "https?://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return {
        "url_count": n.cast("double"),
        "has_http_only_url": _flag(F.exists(urls, lambda u: u.startswith("http://"))),
        "https_ratio": F.when(n > 0, count(lambda u: u.startswith("https://")) / n).otherwise(0.0),
        "ip_based_urls": count(lambda u: u.rlike(r"^https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")),
        "punycode_urls": count(lambda u: F.contains(F.lower(u), F.lit("xn--"))),
        "has_credentials_in_url": _flag(F.exists(urls, lambda u: u.rlike("https?://[^@]+:[^@]+@"))),
        "url_entropy": F.round(mean(F.transform(urls, _entropy)), 4),
        "url_avg_length": mean(F.transform(urls, lambda u: F.length(u).cast("double"))),
        "url_subdomain_count": mean(F.transform(urls, lambda u: F.greatest(F.lit(0), F.size(F.split(host(u), r"\.")) - 2).cast("double"))),
        "suspicious_tld_count": count(lambda u: F.split_part(F.lower(u), F.lit("?"), F.lit(1)).rlike("(" + "|".join(t.replace(".", r"\.") for t in TLDS) + ")$")),
        "url_has_query_params": _flag(F.exists(urls, lambda u: F.contains(u, F.lit("?")))),
    }


def _auth_features(spf: Column, dkim: Column, dmarc: Column, arc: Column) -> dict[str, Column]:
    out = {f"{name}_{v}": _flag(c == v) for name, c, values in (("spf", spf, ("pass", "fail", "softfail", "neutral")), ("dkim", dkim, ("pass", "fail")), ("dmarc", dmarc, ("pass", "fail")), ("arc", arc, ("pass",))) for v in values}
    for v in ("pass", "fail"):
        out[f"auth_all_{v}"] = _flag((spf == v) & (dkim == v) & (dmarc == v))
    return {**out, "auth_inconsistency": _flag((spf == "pass") & (dmarc == "fail"))}


def _sender_features(sender: Column, reply_to: Column, return_path: Column, low: Column, subject: Column) -> dict[str, Column]:
    own, reply, back, name = domain_of(sender), domain_of(reply_to), domain_of(return_path), display_name(sender)
    other = (own != "") & (reply != "") & (own != reply)
    title = F.lower(name)
    return {
        "reply_to_mismatch": _flag(other),
        "from_equals_reply_to": _flag((own != "") & ((reply == "") | (own == reply))),
        "return_path_mismatch": _flag((own != "") & (back != "") & (own != back)),
        "from_domain_present": _flag(own != ""),
        "display_name_length": F.length(name).cast("double"),
        "display_name_privileged": _flag(_any(title, TITLES)),
        "display_name_domain_mismatch": _flag((name != "") & (own != "") & _any(title, IMPERSONATED) & ~_any(own, IMPERSONATED)),
        "subject_urgency": _flag(_any(F.lower(subject), SUBJECT_URGENCY)),
        "body_wire_transfer_mention": _flag(_any(low, ("wire transfer", "wire the"))),
        "body_gift_card_mention": _flag(_any(low, ("gift card",))),
        "body_payroll_mention": _flag(_any(low, ("payroll", "direct deposit"))),
        "reply_to_different_domain": _flag(other),
    }


def extract(mails: DataFrame, *keep: str) -> DataFrame:
    """H8: the columns ``keep`` and all features of each row of a mail table with any of ``TEXTS``, ``NUMBERS`` and ``urls ARRAY<STRING>``, without Python per row.

    Three projections: what several features read, the features, and (H7) 0 for
    what isn't a finite number.  Columns that are read more than once keep the
    optimizer from merging them, so texts are lowered, split and counted once.
    """
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in mails.columns else F.lit("") for c in TEXTS}
    number = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in mails.columns else F.lit(0.0) for c in NUMBERS}
    none = F.array().cast("array<string>")
    urls = F.filter(F.transform(F.coalesce(F.col("urls"), none), lambda u: F.trim(u)), lambda u: u != "") if "urls" in mails.columns else none
    held = {c: f"given_{i}" for i, c in enumerate(keep)}
    cleaned = mails.select(*(F.col(c).alias(n) for c, n in held.items()), *(c.alias(k) for k, c in text.items()), *(c.alias(k) for k, c in number.items()), urls.alias("urls"))
    cleaned = cleaned.withColumns({"low": F.lower("body"), "combined": F.lower(F.concat("subject", F.lit(" "), "body"))})
    cleaned = cleaned.withColumns({"words": _words(F.col("low")), "n_syllables": F.regexp_count("low", F.lit("[aeiouy]+"))})
    t = F.col
    features = {
        **_text_features(t("body"), t("subject"), t("low"), t("combined"), t("words"), t("n_syllables")),
        **_url_features(t("urls")),
        **_auth_features(*(F.lower(t(c)) for c in ("spf", "dkim", "dmarc", "arc"))),
        **_sender_features(t("sender"), t("reply_to"), t("return_path"), t("low"), t("subject")),
        **{c: t(c) for c in NUMBERS},
    }
    counted = cleaned.select(*held.values(), *(c.alias(k) for k, c in features.items()))
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return counted.select(*(F.col(n).alias(c) for c, n in held.items()), *(finite(F.col(k)).alias(k) for k in features))
