"""Exact cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import indicators as ind
from lurewatch.functions import normalize as norm
from lurewatch.functions import scoring as sc


def ask(spark, f, *values):
    schema = "i int, v string"
    rows = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_domains(spark):
    assert ask(spark, norm.domain, "  HTTPS://Mail.Example.COM:8443/a/b ", "Example.org", None) == ["mail.example.com", "example.org", ""]


def test_ips(spark):
    found = ask(spark, norm.ip, " 192.0.2.1 ", "256.1.1.1", "2001:0DB8:0:0:0:0:0:1", "::1", "1:0:0:2:0:0:0:3", "no", None, "1:2")
    assert found == ["192.0.2.1", None, "2001:db8::1", "::1", "1:0:0:2::3", None, None, None]


def test_urls(spark):
    found = ask(spark, norm.url, "Example.COM", "HTTPS://A.B/Path?Q=1#f", "http://x.org")
    assert found == ["http://example.com/", "https://a.b/Path?Q=1", "http://x.org/"]


def test_hashes_and_times(spark):
    assert ask(spark, norm.hash_value, " ABCDEF01 ", "xyz") == ["abcdef01", None]
    assert ask(spark, lambda c: norm.hash_type(norm.hash_value(c)), "a" * 32, "b" * 40, "c" * 64, "d" * 128, "e") == ["md5", "sha1", "sha256", "sha512", "unknown"]
    assert ask(spark, norm.iso, "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "soon") == ["2024-01-02T03:04:05Z", "2024-01-02T01:04:05Z", "soon"]


def test_scores_are_clamped(spark):
    assert ask(spark, norm.score, "1.5", "-0.2", None) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("domain, odd", [("paypa1-secure.com", True), ("g00gle.com", True), ("micros0ft.com", True), ("paypal-security-update.com", True), ("arnazon.com", True), ("apps.microsoft.com", False), ("paypal.com", False), ("garden.org", False), ("github.com", False)])
def test_typosquats(spark, domain, odd):
    assert ask(spark, ind.is_typosquat, domain) == [odd]


def test_levels(spark):
    found = ask(spark, lambda c: sc.level(c.cast("double")), *map(str, (0, 24, 25, 49, 50, 74, 75, 100)))
    assert found == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_html_links(spark):
    html = '<a href="hxxp://a[.]b/x?p=1&amp;q=2">t</a> <img src="https://c.d/e"> http://a.b/x plain'
    assert ask(spark, ind.urls_in_html, html) == [["http://a.b/x?p=1&q=2", "https://c.d/e"]]
    assert ask(spark, ind.defang_url, "https://a.b/c.d") == ["hxxps://a[.]b/c.d"]


def test_ip_classes(spark):
    assert ask(spark, ind.ip_class, "8.8.8.8", "10.1.1.1", "127.0.0.1", "224.0.0.1", "203.0.113.9", "x") == ["public", "private", "loopback", "reserved", "private", "reserved"]


def test_an_address_is_taken_apart_once(spark):
    """Each evaluation of the groups of an address costs as often as its text is read, and nested ones multiply."""
    given = lambda c: str(c).count("given")
    assert given(norm.v6_groups(F.col("given"))) == 1
    assert given(ind.address_bits(F.col("given"))) <= 4
    assert given(ind.network_bits(F.col("given"))) <= 6
