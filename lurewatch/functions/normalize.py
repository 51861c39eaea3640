"""Normalisation and contract repair (D1-D13, C19, C20) as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def domain(c: Column) -> Column:
    """Trimmed, lower-cased, without scheme, path and port."""
    bare = F.regexp_replace(F.lower(F.trim(_blank(c))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable, since an expression that is read often is evaluated as often."""
    return F.get(F.transform(F.array(value), use), 0)


def _v6_parts(c: Column) -> Column:
    """The eight groups of an IPv6 address without an embedded IPv4 part, as written; null if it isn't one."""
    groups = lambda s: F.array_remove(F.split(s, ":"), "")

    def filled(p: Column) -> Column:
        missing = F.lit(8) - F.size(p["head"]) - F.size(p["tail"])
        return F.when(p["n"] == 2, F.concat(p["head"], F.array_repeat(F.lit("0"), missing), p["tail"])).otherwise(p["head"])

    def of(text: Column) -> Column:
        parts = let(F.split(text, "::"), lambda s: F.struct(groups(F.get(s, 0)).alias("head"), groups(F.coalesce(F.get(s, 1), F.lit(""))).alias("tail"), F.size(s).alias("n")))
        good = lambda whole: F.forall(whole, lambda g: F.length(g).between(1, 4)) & (F.size(whole) == 8)
        whole = let(parts, lambda p: F.when(p["n"] <= 2, let(filled(p), lambda w: F.when(good(w), w))))
        return F.when(text.rlike("^[0-9a-f:]+$") & F.contains(text, F.lit(":")), whole)

    return let(F.lower(c), of)


def v6_groups(c: Column) -> Column:
    """An IPv6 address as eight groups of four digits with colons, null if it isn't one."""
    return let(_v6_parts(F.trim(_blank(c))), lambda whole: F.when(whole.isNotNull(), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ":")))


def _v6(c: Column) -> Column:
    """Canonical text of an IPv6 address without an embedded IPv4 part, else null."""
    runs = [":" + "0:" * n for n in range(8, 1, -1)]

    def cut(joined: Column) -> Column:
        out = joined
        for run in reversed(runs):  # the longest run of zeros wins, the first of equal ones
            out = F.when(F.contains(joined, F.lit(run)), F.concat(F.substring_index(joined, run, 1), F.lit("::"), F.substring(joined, F.locate(run, joined) + len(run), F.lit(99)))).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    def text(whole: Column) -> Column:
        short = F.transform(whole, lambda g: F.when(F.ltrim(g, F.lit("0")) == "", "0").otherwise(F.ltrim(g, F.lit("0"))))
        return F.when(whole.isNotNull(), let(F.concat(F.lit(":"), F.array_join(short, ":"), F.lit(":")), cut))

    return let(_v6_parts(c), text)


def ip(c: Column) -> Column:
    """Canonical IPv4 or IPv6 text, null if not valid."""
    text = F.trim(_blank(c))
    return F.when(text.rlike(_V4), text).otherwise(_v6(text))


def url(c: Column) -> Column:
    """D3: default scheme http, scheme and host lower-cased, path at least ``/``, query kept, fragment dropped."""
    text = F.trim(_blank(c))
    full = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("http://"), text))
    part = lambda k: F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.when(part(4) == "?", "").otherwise(part(4))
    return F.when(text == "", "").otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, query))


def url_hash(c: Column) -> Column:
    """D4."""
    return F.sha2(c, 256)


def hash_value(c: Column) -> Column:
    """Lower-cased hex, null otherwise."""
    text = F.lower(F.trim(_blank(c)))
    return F.when(text.rlike("^[a-f0-9]+$"), text)


def timestamp(c: Column) -> Column:
    """UTC timestamp of ISO text, null if it can't be read (keep the text beside it)."""
    return F.try_to_timestamp(F.trim(_blank(c)))


def iso(c: Column) -> Column:
    """ISO text in UTC, the given text if it can't be read."""
    return F.coalesce(F.date_format(timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


def address_domain(c: Column) -> Column:
    """The lower-cased domain after the last @ of an address, with or without brackets; empty without @."""
    return F.lower(F.regexp_extract(_blank(c), r"@([A-Za-z0-9.-]+)[^@]*$", 1))


def recipients(c: Column, recipient: Column) -> Column:
    """The recipients with the single one appended if missing."""
    none = F.array().cast("array<string>")
    one = F.when(_blank(recipient) != "", F.array(recipient)).otherwise(none)
    return F.array_union(F.coalesce(c, none), one)


def auth_status(c: Column) -> Column:
    """Lower-cased and trimmed; empty counts as unknown."""
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))


def ioc_values(items: Column) -> Column:
    """Values of an array of JSON items that are strings or objects with ``value``; empty ones go."""
    value = lambda x: F.coalesce(F.get_json_object(x, "$.value"), F.when(~F.trim(x).startswith("{"), F.regexp_replace(x, '^"|"$', "")))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), value), lambda v: F.coalesce(v, F.lit("")) != "")


def url_record(c: Column) -> Column:
    """struct(value, domain, url_hash) of a URL."""
    clean = url(c)
    host = F.regexp_replace(domain(clean), r"^www\.", "")
    return F.struct(clean.alias("value"), host.alias("domain"), url_hash(clean).alias("url_hash"))


def hash_type(c: Column) -> Column:
    """By the length of the hex text."""
    n = F.length(c)
    return F.when(n == 32, "md5").when(n == 40, "sha1").when(n == 64, "sha256").when(n == 128, "sha512").otherwise("unknown")


def score(c: Column) -> Column:
    """Clamped to [0, 1]; null is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def detection(risk: Column) -> Column:
    """struct(classification, risk_score, confidence) of a payload that has only a risk."""
    high = F.coalesce(risk, F.lit(0.0)) > 0.6
    return F.struct(F.when(high, "phishing").otherwise("suspicious").alias("classification"), score(risk).alias("risk_score"), F.when(high, 0.85).otherwise(0.5).alias("confidence"))


def url_domain(c: Column) -> Column:
    """Host of a URL without port and ``www.``."""
    return F.regexp_replace(domain(c), r"^www\.", "")


def is_ip(c: Column) -> Column:
    """C20."""
    return ip(c).isNotNull()
