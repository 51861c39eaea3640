"""Raw messages, authentication, enrichment, signals, training: cases with known values."""

import base64

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import indicators as ind
from lurewatch.functions import signals as sg
from lurewatch.operators import analysis as an
from lurewatch.operators import authentication as au
from lurewatch.operators import campaigns as camp
from lurewatch.operators import enrichment as en
from lurewatch.operators.suffixes import split_hosts
from lurewatch.operators import messages as m
from lurewatch.operators import training as tr
from lurewatch.plans import reports as plans

PHISH = b"""Return-Path: <bounce@evil.example>\r
Received: from relay.example.org ([45.33.1.9])\r
\tby mx.corp.example with ESMTPS id abc.1 for <joe@corp.example>; Tue, 2 Jan 2024 10:10:00 +0000 (UTC)\r
Received: from [192.168.1.4] by relay.example.org with HTTP id q9; 2 Jan 2024 10:00 GMT\r
Authentication-Results: mx.corp.example; spf=FAIL; dkim = pass;\r
 dmarc=fail\r
From: =?utf-8?B?UGF5UGFsIFPDqWN1cml0w6k=?= <alerts@paypa1.example>\r
To: Joe <joe@corp.example>, ann@corp.example\r
Reply-To: help@other.example\r
Subject: =?iso-8859-1?Q?V=E9rifiez?= now\r
Date: Tue, 2 Jan 2024 05:00:00 -0500\r
Message-ID: <m1@paypa1.example>\r
References: <a@x> <b@y>\r
X-Priority: 1 (Highest)\r
X-Spam-Status: Yes, score=12.4 required=5\r
X-Thing: one\r
X-Thing: two\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary=zz\r
\r
--zz\r
Content-Type: text/plain; charset=iso-8859-1\r
Content-Transfer-Encoding: quoted-printable\r
\r
Caf=E9 http://paypa1.example/login\r
--zz\r
Content-Type: text/html\r
\r
<a href=x>y</a>\r
--zz\r
Content-Type: application/octet-stream; name="run.EXE"\r
Content-Disposition: attachment; filename="run.EXE"\r
Content-Transfer-Encoding: base64\r
\r
""" + base64.b64encode(b"payload") + b"\r\n--zz--\r\n"  # fmt: skip


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [("a", bytearray(PHISH)), ("b", bytearray(b"")), ("c", None), ("d", bytearray(b"Subject: x\n\nbody")), ("e", bytearray(b"\xff\xfe\x00garbage"))]
    return m.decoded(spark.createDataFrame(rows, "email_id string, content binary")).cache()


def test_headers(decoded):
    rows = {r.email_id: r for r in m.header_table(decoded).collect()}
    a = rows["a"]
    assert (a.display_name, a.from_address, a.to, a.reply_to, a.return_path) == ("PayPal Sécurité", "alerts@paypa1.example", ["joe@corp.example", "ann@corp.example"], "help@other.example", "bounce@evil.example")
    assert (a.subject, a.date, a.message_id, a.references) == ("Vérifiez now", "2024-01-02T10:00:00Z", "m1@paypa1.example", ["<a@x>", "<b@y>"])
    assert (a.recorded_spf, a.recorded_dkim, a.recorded_dmarc, a.recorded_arc) == ("fail", "pass", "fail", None)
    assert a.spam_score == 12.4 and a.priority.startswith("1") and a.custom_headers["X-Thing"] == "one"
    assert (a.reply_to_mismatch, a.return_path_mismatch, a.display_name_spoofing) == (True, True, False)
    assert set(rows) == set("abcde") and rows["d"].subject == "x" and rows["b"].from_address is None


def test_bodies_and_attachments(decoded):
    rows = {r.email_id: r for r in decoded.collect()}
    assert rows["a"].text_plain == "Café http://paypa1.example/login" and rows["a"].text_html == "<a href=x>y</a>"
    (f,) = m.attachment_table(decoded).collect()
    assert (f.filename, f.size, f.executable, f.archive) == ("run.EXE", 7, True, False) and f.sha256 == "239f59ed55e737c77147cf55ad0c1b030b6d7ee748a7426952f9b852d5a935e5"
    assert rows["d"].text_plain == "body" and rows["c"].size is None


def test_relay_path(decoded):
    one, two = sorted(m.relay_path(decoded).collect(), key=lambda r: r.hop)
    assert (one.hop, one.from_host, one.from_ip, one.protocol, one.flags) == (1, "[192.168.1.4]", "192.168.1.4", "HTTP", ["private_ip", "protocol_mismatch"])
    assert (two.from_ip, two.by_host, two.queue_id, two.for_address, two.delay_s, two.flags) == ("45.33.1.9", "mx.corp.example", "abc.1", "joe@corp.example", 600.0, ["time_skew"])


def test_ml_rows(decoded):
    r = {x.email_id: x for x in m.ml_rows(m.mail_rows(decoded)).collect()}["<m1@paypa1.example>"]
    assert (r.from_domain, r.reply_to_domain, r.spf, r.urls, r.url_count, r.attachment_count, r.executable_attachments) == ("paypa1.example", "other.example", "fail", "http://paypa1.example/login", 1, 1, 1)


def test_networks_hold_addresses(spark):
    cases = [("10.1.2.3", "10.0.0.0/8", True), ("10.1.2.3", "11.0.0.0/8", False), ("1.2.3.4", "1.2.3.4", True), ("1.2.3.4", "0.0.0.0/0", True), ("1.2.3.4", "x/8", False), ("2001:db8::1", "2001:db8::/32", True), ("2001:db9::1", "2001:db8::/32", False), ("1.2.3.4", "2001:db8::/32", False), ("2001:db8::1", "10.0.0.0/8", False)]
    got = spark.createDataFrame(cases, "ip string, net string, want boolean").withColumn("got", au.in_network(F.col("ip"), F.col("net"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_spf_follows_includes_and_counts_lookups(spark):
    records = [("a.x", "v=spf1 include:b.x -all"), ("b.x", "v=spf1 ip4:9.9.9.9 -all"), ("c.x", "v=spf1 redirect=b.x"), ("loop.x", "v=spf1 include:loop.x -all"), ("many.x", "v=spf1 " + " ".join(f"a:h{i}.x" for i in range(11)) + " ip4:9.9.9.9 -all"), ("t.x", "other"), ("q.x", "v=spf1 ?ip4:9.9.9.0/24")]
    checks = [(d, ip) for d in ("a.x", "b.x", "c.x", "loop.x", "many.x", "t.x", "q.x") for ip in ("9.9.9.9", "8.8.8.8")]
    none = spark.createDataFrame([], "host string, ip string")
    got = au.spf_results(spark.createDataFrame(checks, "domain string, ip string"), spark.createDataFrame(records, "domain string, record string"), none, spark.createDataFrame([], "domain string, host string"))
    got = {(r.domain, r.ip): r.result for r in got.collect()}
    assert [got[d, "9.9.9.9"] for d in ("a.x", "b.x", "c.x", "q.x", "t.x", "many.x")] == ["pass", "pass", "pass", "neutral", "none", "permerror"]
    assert [got[d, "8.8.8.8"] for d in ("a.x", "b.x", "c.x", "q.x")] == ["fail", "fail", "fail", "neutral"] and got["loop.x", "8.8.8.8"] == "permerror"


def test_longest_prefix_wins(spark):
    nets = [("8.0.0.0/6", "AS1", "a", "x"), ("8.8.0.0/16", "AS2", "b", "x"), ("8.8.8.0/24", "AS3", "c", "x"), ("8.8.8.8", "AS4", "d", "x"), ("bad", "AS5", "e", "x")]
    ips = spark.createDataFrame([(x,) for x in ("8.8.8.8", "8.8.8.9", "8.8.9.9", "9.1.1.1", "12.0.0.1", "::1")], "ip string")
    got = {r.ip: r.asn for r in en.networks(ips, spark.createDataFrame(nets, "network string, asn string, org string, country string")).collect()}
    assert got == {"8.8.8.8": "AS4", "8.8.8.9": "AS3", "8.8.9.9": "AS2", "9.1.1.1": "AS1"}


def test_networks_of_both_families_equal_brute_force(spark):
    """Random prefixes and addresses, default routes, equal and unreadable networks, an address of every prefix's edge."""
    import ipaddress
    import random

    rng = random.Random(8)
    nets, ips = ["0.0.0.0/0", "::/0", "10.0.0.0/33", "::1/129", "bad/8", "", "2001:db8::/x", "10.1.0.0/"], ["nothing", "", "1.2.3", "::ffff:1.2.3.4"]
    for _ in range(150):
        four = rng.random() < 0.5
        size, kind = (32, ipaddress.IPv4Network) if four else (128, ipaddress.IPv6Network)
        base = rng.choice([0x0A << 24, 0x55AA << 16]) if four else rng.choice([0x20010DB8 << 96, 0xFD << 120])
        bits = rng.randrange(1, size + 1)
        net = kind(((base | rng.getrandbits(size - 8)) >> (size - bits) << (size - bits), bits))
        nets.append(str(net))
        ips += [str(x) for x in (net[0], net[-1], net[0] - 1 if int(net[0]) else net[0], type(net[0])(int(net[0]) | rng.getrandbits(size - bits)))]
    ips.append("2001:0DB8:0:0:0::1")
    table = [(n, f"AS{k:03d}", "o", "c") for k, n in enumerate(nets)] + [(nets[-1], "AS000", "o", "c")]

    def best(ip):
        try:
            x = ipaddress.ip_address(ip)
        except ValueError:
            return None
        found = []
        for n, asn, *_ in table:
            try:
                if "/" in n and x in ipaddress.ip_network(n, strict=False):
                    found.append((ipaddress.ip_network(n, strict=False).prefixlen, asn))
            except (ValueError, TypeError):
                continue
        return max(found)[1]

    want = {ip: best(ip) for ip in ips if "ffff:1.2" not in ip and best(ip)}
    frame = spark.createDataFrame([(x,) for x in ips] + [(None,)], "ip string")
    got = {r.ip: r.asn for r in en.networks(frame, spark.createDataFrame(table, "network string, asn string, org string, country string")).collect()}
    assert got == want and len({v for v in want.values()}) > 60
    assert en.networks(frame, spark.createDataFrame([], "network string, asn string, org string, country string")).isEmpty()
    pairs = [(ip, n) for ip in ips[:60] if "ffff:1.2" not in ip for n in nets[:40]]
    inside = spark.createDataFrame(pairs, "ip string, net string").select("ip", "net", au.in_network(F.col("ip"), F.col("net")).alias("x")).collect()

    def holds(ip, n):
        try:
            return "/" in n and not n.endswith("/") and ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False)
        except (ValueError, TypeError):
            return False

    assert [r.x for r in inside] == [holds(r.ip, r.net) for r in inside]


def test_suffix_rules(spark):
    rules = ["com", "Co.uk", "uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "a.b.c", ""]
    cases = {
        "www.ck": ("ck", "www.ck", ""), "x.www.ck": ("ck", "www.ck", "x"), "foo.ck": ("foo.ck", "", ""), "a.foo.ck": ("foo.ck", "a.foo.ck", ""), "b.a.foo.ck": ("foo.ck", "a.foo.ck", "b"), "ck": ("", "", ""),
        "city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp", ""), "kawasaki.jp": ("jp", "kawasaki.jp", ""), "x.kawasaki.jp": ("x.kawasaki.jp", "", ""), "y.x.kawasaki.jp": ("x.kawasaki.jp", "y.x.kawasaki.jp", ""),
        "A.Example.Com": ("com", "example.com", "a"), "shop.co.uk": ("co.uk", "shop.co.uk", ""), "co.uk": ("co.uk", "", ""), "x.uk.": ("uk", "x.uk", ""), "local.unknown": ("unknown", "local.unknown", ""), "b.c": ("c", "b.c", ""), "q.a.b.c": ("a.b.c", "q.a.b.c", ""),
        "1.2.3.4": ("", "", ""), "::1": ("", "", ""), "localhost": ("", "", ""), "": ("", "", ""), "a..com": ("", "", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in cases] * 2 + [(None,)], "host string")
    found = split_hosts(hosts, spark.createDataFrame([(r,) for r in rules], "rule string")).collect()
    assert len(found) == len(cases) and {r.host: (r.suffix, r.registered, r.subdomain) for r in found} == cases
    many = spark.range(5000).select(F.concat(F.col("id").cast("string"), F.lit(".com")).alias("host"))  # one tail that all share
    assert split_hosts(many, spark.createDataFrame([("com",)], "rule string")).filter("suffix = 'com' AND registered = host").count() == 5000


def test_ip_classes(spark):
    cases = {"2001:4860:4860::8888": "public", "::1": "loopback", "fd00::1": "private", "fe80::9": "private", "ff02::1": "reserved", "8.8.8.8": "public", "10.0.0.1": "private", "224.0.0.1": "reserved", "x": "reserved", None: "reserved"}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "ip string, want string").withColumn("got", ind.ip_class(F.col("ip"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_levels_and_bands(spark, data):
    rows = plans._explained(spark, data).select("risk_score", "risk_level", "verdict", F.size("found").alias("n")).collect()
    assert all(r.risk_level == ("CRITICAL" if r.risk_score >= 75 else "HIGH" if r.risk_score >= 50 else "MEDIUM" if r.risk_score >= 25 else "LOW") and r.verdict.startswith(r.risk_level) for r in rows)
    assert {r.risk_level for r in rows} == {"LOW", "MEDIUM", "HIGH", "CRITICAL"} and max(r.risk_score for r in rows) <= 100


def test_signal_ids_count_within_mail_and_category(spark, data):
    for r in plans.reports(spark, data).select(sg.risk_signals().alias("s")).limit(40).collect():
        seen = {}
        for s in r.s:
            seen[s.category] = seen.get(s.category, 0) + 1
            assert s.signal_id == f"{s.category.upper()}-{seen[s.category]:03d}"


def test_hot_indicator_is_split(spark, monkeypatch):
    """One address shared by 3,000 mails: the chunks find what one big bucket would, and only pairs over the bound come out."""
    monkeypatch.setattr(camp, "CHUNK", 200)
    mails = spark.range(3000).select(
        F.concat(F.lit("m"), F.lpad("id", 5, "0")).alias("email_id"), F.concat(F.lit("w"), (F.col("id") % 1500).cast("string"), F.lit(" x"), (F.col("id") % 1500).cast("string")).alias("subject"), F.lit("").alias("sender_domain"), F.timestamp_seconds(F.col("id") * 360_000).alias("ts"),
        F.lit("pass").alias("spf"), F.when(F.col("id") % 2 == 0, "pass").otherwise("fail").alias("dmarc"), F.concat(F.lit("c"), (F.col("id") % 1500).cast("string")).alias("classification"), F.array(F.lit("9.9.9.9")).alias("ips"), *(F.array().cast("array<string>").alias(c) for c in ("domains", "urls", "hashes")),
    )
    got = camp.similar_pairs(mails).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in got) == [(f"m{i:05d}", f"m{i + 1500:05d}") for i in range(1500)]


def test_model_saves_and_learns(spark, tmp_path):
    rows = spark.createDataFrame([(f"{w} {w} hello {i % 7}", label, float(label == "phishing") + i % 3) for i in range(60) for w, label in (("prize password", "phishing"), ("meeting agenda", "ham"))], "body string, label string, x double")
    model = tr.fit(rows, numbers=["x"])
    assert model.classes == ["benign", "phishing"]
    scored = model.probabilities(rows)
    assert scored.filter((F.col("guess") == "benign") != (F.col("label") == "ham")).isEmpty() and scored.filter(F.abs(F.col("p_benign") + F.col("p_phishing") - 1) > 1e-9).isEmpty()
    model.save(f"file://{tmp_path}/model")
    again = tr.ThreatModel.load(spark, f"file://{tmp_path}/model").probabilities(rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, scored.collect()))
    assert tr.fit_bec(rows.withColumn("is_target", F.lit(1))).probabilities(rows).filter("p_bec <> 0").isEmpty()
    with pytest.raises(ValueError):
        tr.fit(rows.filter("label = 'ham'"), numbers=["x"])


def test_bad_rows_are_isolated(spark):
    rows = spark.createDataFrame([("a", "hello", "3"), ("b", "urgent password", "many"), ("c", None, None)], "email_id string, body string, ip_count string")
    got = {r.email_id: r for r in tr.predict(rows, "email_id").collect()}
    assert got["b"].error == "ip_count is not a number" and got["b"].label is None and got["a"].error is None and got["a"].label == "benign" and got["c"].score is not None


def test_bec_detector_on_mails_it_has_not_seen(spark):
    """Trained on half of the mails, whose label is no feature: money asked for in an executive's name, in words that vary, with one label in twenty wrong."""
    import random

    rng = random.Random(5)
    ask = ("please wire the transfer today", "process this wire transfer before noon", "buy gift cards for the clients", "urgent payment, send the gift cards codes")
    talk = ("minutes of the meeting attached", "lunch on friday", "the report is ready", "please review the draft", "wire the new lamp", "payment reminder for the club")
    rows = []
    for k in range(400):
        bad = rng.random() < 0.4
        name = rng.choice(("Chief Executive Officer", "CEO John", "President", "Ann", "Bob")) if bad else rng.choice(("Ann", "Bob", "Desk", "President"))
        sender = f"{name} <{name.split()[0].lower()}@corp.example>"
        reply = rng.choice(("x@freemail.example", "boss@gmail.com")) if bad and rng.random() < 0.8 else ""
        body = f"{rng.choice(ask if bad else talk)} no {k}"
        rows.append((k, body, rng.choice(("urgent request", "quick task", "hello")) if bad else rng.choice(("hello", "notes", "quick task")), sender, reply, "", str(k), int(bad) if rng.random() < 0.95 else 1 - int(bad), int(bad)))
    mails = spark.createDataFrame(rows, "k int, body string, subject string, sender string, reply_to string, return_path string, label string, noisy int, truth int")
    table = tr.training_rows(mails.select("body", "subject", "sender", "reply_to", "return_path", "label")).join(mails.select("label", "k", "noisy", "truth"), "label")
    model = tr.fit_bec(table.filter("k % 2 = 0").withColumn("is_target", F.col("noisy")))
    judged = model.probabilities(table.filter("k % 2 = 1")).select("truth", "p_bec").collect()
    assert len(judged) == 200 and sum((r.p_bec >= 0.5) == bool(r.truth) for r in judged) >= 180


def test_networks_of_large_ids(spark, tmp_path):
    """Ids of more than 16 bits make IPv6 addresses of several groups, all inside their network."""
    ids = [0, 9, 65_535, 65_536, 5_999_999, 2**31, 2**50 + 7]
    spark.createDataFrame([(k, k % 300) for k in ids], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.six for r in plans.e4_networks(spark, str(tmp_path)).collect()] == [True] * len(ids)


def test_graph_is_exploded_from_a_table(spark, data):
    """Else the filter for empty arrays spells out the whole report, digests of texts included, once more for each use."""
    for f in (plans.g17_graph_nodes, plans.g17_graph_links):
        plan = f(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2" not in plan and "doc_id" not in plan


def test_sources_of_indicators_are_read_once(spark):
    assert str(an._first_wins(("header", F.col("given")), ("body", F.col("other")))).count("given") == 1


def test_vocabulary_counts_terms_and_texts(spark, monkeypatch):
    monkeypatch.setattr(tr, "TERMS", 3)
    texts = [["the", "b", "b", "a"], ["the", "a", "c"], ["the", "d"], ["the"]]
    assert tr.vocabulary(spark.createDataFrame([(t,) for t in texts], "terms array<string>"), 4) == ["a", "b", "c"]


def test_stages_of_the_classifier_read_term_counts(spark, monkeypatch):
    """Texts are taken apart for the vocabulary and once more for a table of counts, not for each stage that is fitted."""
    seen = []
    monkeypatch.setattr(tr, "written", lambda df, name, keep=tr.written: seen.append((name, df.columns)) or keep(df, name))
    rows = spark.createDataFrame([("wire the money", "spam", 1.0), ("see you soon", "ham", 0.0)] * 4, "body string, label string, x double")
    assert tr.fit(rows, "label", ["x"]).classes == ["benign", "spam"]
    assert seen == [("term-counts", ["counts", "class_index", "weight", "x"])]
