"""Indicator extraction and classification (C1-C20) as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import let as _let
from .normalize import v6_groups

# Patterns and word lists of the indicator rules.
URL_PATTERN = r"(?i)https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
IPV4_PATTERN = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
ADDRESS_PATTERN = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}"
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "link", "info", "online", "site", "pw")
SUSPICIOUS_WORDS = "login|verify|secure|account|update|confirm|banking|paypal|signin|password|credential|suspend|unlock|alert|invoice|wire"
TRUSTED_DOMAINS = ("linkedin.com", "google.com", "microsoft.com", "apple.com", "github.com", "amazon.com", "twitter.com", "x.com", "youtube.com", "facebook.com", "instagram.com", "office.com", "live.com", "outlook.com")
BRANDS = ("google", "microsoft", "amazon", "paypal", "apple", "facebook", "netflix", "instagram", "twitter", "linkedin", "dropbox", "github", "chase", "wellsfargo", "bankofamerica", "citibank", "dhl", "fedex")
BRAND_DOMAINS = (
    "google.com", "microsoft.com", "amazon.com", "paypal.com", "apple.com", "facebook.com", "netflix.com", "instagram.com", "twitter.com", "linkedin.com", "dropbox.com",
    "github.com", "live.com", "office.com", "outlook.com", "chase.com", "wellsfargo.com", "bankofamerica.com", "citi.com", "dhl.com", "fedex.com",
)
HOMOGLYPHS = "аеорсхуіԁոᴵⅼ０１νοκ"
LEET_FROM, LEET_TO = "10354@8", "loesaab"
#: Two-label public suffixes; any other suffix is the last label.  A small table of our own.
PUBLIC_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za", "com.mx", "com.tr")
#: Special IPv4 ranges as (class, network, prefix length); the first that fits counts.
SPECIAL_V4 = (
    ("loopback", "127.0.0.0", 8), ("private", "0.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "169.254.0.0", 16), ("private", "172.16.0.0", 12), ("private", "192.0.0.0", 29),
    ("private", "192.0.0.170", 31), ("private", "192.0.2.0", 24), ("private", "192.168.0.0", 16), ("private", "198.18.0.0", 15), ("private", "198.51.100.0", 24),
    ("private", "203.0.113.0", 24), ("private", "240.0.0.0", 4), ("reserved", "224.0.0.0", 4),
)


#: Special IPv6 ranges, as patterns over the eight full groups; the first that fits counts.
SPECIAL_V6 = (
    ("loopback", "^(0000:){7}0001$"), ("private", "^(0000:){8}$|^(0000:){7}0000$"), ("private", "^f[cd]"), ("private", "^fe[89ab]"), ("private", "^2001:0db8:"), ("private", "^(0000:){5}ffff:"),
    ("private", "^0100:(0000:){3}"), ("private", "^2001:000[0-9a-f]:|^2001:0010:"), ("reserved", "^ff"), ("reserved", "^(0[1-9a-f]|[4-9a-e]|f[0-9ab])"), ("reserved", "^00"),
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(group))


def urls_in_text(c: Column) -> Column:
    """Distinct URLs in order."""
    return F.array_distinct(_all(c, URL_PATTERN))


def refang(c: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(F.trim(c), "^(?i)hxxp", "http"), F.lit("[.]"), F.lit(".")), F.lit("&amp;"), F.lit("&"))


def urls_in_html(c: Column) -> Column:
    """http(s) URLs of href, src and action attributes and of the raw text, without strict prefixes of others."""
    attributes = _all(c, r"(?i)\b(?:href|src|action)\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = F.transform(F.concat(attributes, urls_in_text(c)), refang)
    return without_prefixes(F.array_distinct(F.filter(found, lambda u: u.rlike("^https?://"))))


def without_prefixes(urls: Column) -> Column:
    """The URLs that no longer URL of the array begins with."""
    return F.filter(urls, lambda u: ~F.exists(urls, lambda o: (o != u) & F.startswith(o, u)))


def first_source(found: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Of rows (key, value, source) one per key and value, with the source earliest in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    return found.groupBy(key, value).agg(F.min_by("source", rank).alias("source"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def split_suffix(host: Column) -> Column:
    """struct(suffix, registered, subdomain) of a host, by the suffix table; addresses have none."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    suffix = F.when(host.rlike(r"^[0-9.]+$") | (F.size(labels) < 2), "").when(two.isin(*PUBLIC_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    n = F.size(F.split(suffix, r"\.")) + 1
    registered = F.when((suffix == "") | (F.size(labels) < n), "").otherwise(F.array_join(F.slice(labels, -n, n), "."))
    rest = F.when(registered == "", "").otherwise(F.regexp_replace(F.left(host, F.length(host) - F.length(registered)), r"\.$", ""))
    return F.struct(suffix.alias("suffix"), registered.alias("registered"), rest.alias("subdomain"))


def defang_ip(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("[.]"))


def defang_url(c: Column) -> Column:
    """Hxxp scheme and bracketed dots in the host part."""
    part = lambda k: F.regexp_extract(c, r"(?s)^(https?)(://)([^/?#]*)(.*)$", k)
    return F.when(c.rlike("^https?://"), F.concat(F.replace(part(1), F.lit("http"), F.lit("hxxp")), part(2), defang_ip(part(3)), part(4))).otherwise(c)


def ips_in_text(c: Column) -> Column:
    """Sorted distinct IPv4 addresses, bracketed or bare."""
    return F.array_sort(F.array_union(_all(c, r"\[([0-9]{1,3}(?:\.[0-9]{1,3}){3})\]", 1), _all(c, IPV4_PATTERN)))


def v4_number(c: Column) -> Column:
    """An IPv4 address as a number, null if it isn't one."""
    parts = F.split(c, r"\.")
    ok = c.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long"))
    return F.when(ok, number)


def _v4(text: str) -> int:
    return sum(int(p) << s for p, s in zip(text.split("."), (24, 16, 8, 0), strict=True))


def address_bits(c: Column) -> Column:
    """The family and bits of an address as text, ``4:`` and 32 or ``6:`` and 128 digits; null for what is neither."""
    six = F.array_join(F.transform(F.split(v6_groups(c), ":"), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.coalesce(F.concat(F.lit("4:"), F.lpad(F.conv(v4_number(F.trim(c)).cast("string"), 10, 2), 32, "0")), F.concat(F.lit("6:"), six))


def network_bits(network: Column) -> Column:
    """The family and the leading bits that a network ``address/n`` fixes, all of them without n; null for what can't be read."""

    def of(whole: Column) -> Column:
        n = F.coalesce(F.nullif(F.split_part(network, F.lit("/"), F.lit(2)), F.lit("")).try_cast("int"), F.when(~F.contains(network, F.lit("/")), F.length(whole) - 2))
        return _let(n, lambda n: F.when(n.between(0, F.length(whole) - 2), F.left(whole, n + 2)))

    return _let(address_bits(F.split_part(network, F.lit("/"), F.lit(1))), of)


def ip_class(c: Column) -> Column:
    """Loopback, private, reserved or public, for IPv4 and IPv6; what is neither is reserved."""

    def four(n: Column) -> Column:
        out = F.lit("public")
        for kind, net, bits in reversed(SPECIAL_V4):
            out = F.when(n.between(_v4(net), _v4(net) + (1 << (32 - bits)) - 1), kind).otherwise(out)
        return F.when(n.isNotNull(), out)

    def six(groups: Column) -> Column:
        out = F.lit("public")
        for kind, pattern in reversed(SPECIAL_V6):
            out = F.when(groups.rlike(pattern), kind).otherwise(out)
        return F.when(groups.isNotNull(), out)

    return F.coalesce(_let(v4_number(c), four), F.when(F.contains(c, F.lit(":")), _let(v6_groups(c), six)), F.lit("reserved"))


def addresses(c: Column) -> Column:
    """B2: addresses in order."""
    return _all(c, ADDRESS_PATTERN)


def domains_in_text(c: Column) -> Column:
    """C11: distinct lower-cased domains of URLs and addresses in a text."""
    of_urls = F.transform(urls_in_text(c), host)
    of_addresses = F.transform(addresses(c), lambda a: F.lower(F.substring_index(a, "@", -1)))
    return F.array_distinct(F.filter(F.concat(of_urls, of_addresses), lambda d: d != ""))


def has_homoglyph(domain: Column, *, compat: bool = False) -> Column:
    """A confusable letter; ``compat`` also counts the plain v."""
    return F.lower(_text(domain)).rlike(f"[{HOMOGLYPHS}{'v' if compat else ''}]")


def leet(c: Column) -> Column:
    """C14."""
    return F.translate(c, LEET_FROM, LEET_TO)


def is_typosquat(domain: Column, registered: Column | None = None) -> Column:
    """A token of the domain's name resembles a brand, and the domain isn't a brand's own."""
    brands = F.array(*map(F.lit, BRANDS))
    target = F.lower(_text(registered)) if registered is not None else F.lit("")

    def name_tokens(target: Column) -> Column:
        labels = F.split(target, r"\.")
        name = F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(labels[0])
        return F.array_distinct(F.concat(F.array(name), F.filter(F.split(name, "[-_.]"), lambda t: F.length(t) >= 3)))

    def resembles(token: Column, plain: Column, several: Column) -> Column:
        def one(brand: Column) -> Column:
            most = F.when(F.length(brand) <= 5, 1).otherwise(2)
            near = lambda t: (t != brand) & (F.abs(F.length(t) - F.length(brand)) <= 2) & (F.levenshtein(t, brand) <= most)
            return ((plain == brand) & (token != brand)) | ((token == brand) & several) | near(token) | near(plain)

        return F.exists(brands, one)

    def judge(x: Column) -> Column:
        text, target = x["text"], x["target"]
        own = text.isin(*BRAND_DOMAINS) | target.isin(*BRAND_DOMAINS) | F.exists(brands, lambda b: F.endswith(text, F.concat(F.lit("."), b, F.lit(".com"))))
        odd = _let(name_tokens(target), lambda ts: F.exists(ts, lambda t: _let(leet(t), lambda plain: resembles(t, plain, F.size(ts) > 1))))
        return (text != "") & ~own & odd

    text = F.lower(F.trim(_text(domain)))
    return _let(F.struct(text.alias("text"), F.when(target != "", target).otherwise(text).alias("target")), judge)


def _suspicious(url: Column, name: Column, parts: Column) -> Column:
    registered, suffix = parts["registered"], parts["suffix"]
    trusted = registered.isin(*TRUSTED_DOMAINS)
    odd = is_typosquat(name, registered) | has_homoglyph(name) | url.rlike(r"^https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+") | suffix.isin(*SUSPICIOUS_TLDS)
    return odd | (~trusted & (F.lower(url).rlike(SUSPICIOUS_WORDS) | (F.length(url) > 200)))


def _name(url: Column, parts: Column) -> Column:
    return F.when(parts["registered"] != "", parts["registered"]).otherwise(host(url))


def is_suspicious_url(url: Column) -> Column:
    """C6."""
    return _let(split_suffix(host(url)), lambda parts: _suspicious(url, _name(url, parts), parts))


def url_record(url: Column, source: Column) -> Column:
    """struct(url, scheme, domain, defanged, source, suspicious)."""

    def record(clean: Column) -> Column:
        def of(parts: Column) -> Column:
            scheme = F.lower(F.regexp_extract(clean, "^([A-Za-z]+)://", 1))
            name = _name(clean, parts)
            return F.struct(clean.alias("url"), scheme.alias("scheme"), name.alias("domain"), defang_url(clean).alias("defanged"), source.alias("source"), _suspicious(clean, name, parts).alias("suspicious"))

        return _let(split_suffix(host(clean)), of)

    return _let(refang(url), record)


def fallback(text: Column) -> Column:
    """struct(urls, ips, hashes, domains) found in free text."""
    urls = F.array_distinct(F.transform(_all(text, r"https?://[^\s<>\"']+"), lambda u: F.rtrim(u, F.lit(".,;:)]}"))))
    hashes = F.array_distinct(F.transform(F.concat(_all(text, r"\b[a-fA-F0-9]{64}\b"), _all(text, r"\b[a-fA-F0-9]{32}\b")), F.lower))
    domains = F.array_distinct(F.filter(F.transform(urls, lambda u: F.regexp_replace(host(u), r"^www\.", "")), lambda d: d != ""))
    return F.struct(urls.alias("urls"), F.array_distinct(_all(text, IPV4_PATTERN)).alias("ips"), hashes.alias("hashes"), domains.alias("domains"))


def fingerprints(text: Column) -> Column:
    """C17: struct of the digests of a body; null if it is empty."""
    return F.when(_text(text) != "", F.struct(F.md5(text).alias("md5"), F.sha1(text).alias("sha1"), F.sha2(text, 256).alias("sha256")))
