"""Campaigns, graph, pivots, components and evaluation on small tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import campaigns as c
from lurewatch.operators import evaluation as ev
from lurewatch.operators import graph as g
from lurewatch.operators import pivots
from lurewatch.operators import tables
from lurewatch.operators.components import components
from lurewatch.plans import fixtures


def _rows(spark, data):
    mails = fixtures.emails(spark, data)
    return c.indicator_rows(mails, fixtures.iocs(mails), fixtures.resolves(mails))


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x or any(find(y) == x for y in parent if y != x)}


def every_pair(rows):
    """All pairs and their scores, by the product of the emails with themselves."""
    ready = tables.written(c.prepared(rows), "prepared")
    both = ready.select(F.col("email_id").alias("a")).join(ready.select(F.col("email_id").alias("b")), F.col("a") < F.col("b"))
    both = both.join(ready.alias("x"), F.col("a") == F.col("x.email_id")).join(ready.alias("y"), F.col("b") == F.col("y.email_id"))
    return {(r.a, r.b): r.score for r in both.select("a", "b", F.round(c.similarity("x", "y")["score"], 3).alias("score")).collect()}


@pytest.mark.parametrize("chunk", [1024, 7])
def test_blocked_join_finds_all_pairs(spark, data, monkeypatch, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    k = F.col("doc_id")
    subject = F.when(k % 5 == 0, F.concat(F.lit("invoice due "), (k % 3).cast("string"))).when(k % 5 == 1, "").when(k % 5 == 2, F.lit("Invoice")).otherwise(F.col("subject"))
    ts = F.when(k % 11 == 0, None).when(k % 2 == 0, F.timestamp_seconds(F.unix_timestamp("ts") * 9)).otherwise(F.col("ts"))
    rows = tables.written(_rows(spark, data).filter("doc_id < 90").withColumns({"subject": subject, "ts": ts}), "rows")
    scores = every_pair(rows)
    for threshold in (0.45, 0.35, 0.3, 0.2, 0.16):
        assert {(r.a, r.b) for r in c.similar_pairs(rows, threshold).collect()} == {p for p, x in scores.items() if x >= threshold}, threshold
    with pytest.raises(ValueError):
        c.similar_pairs(rows, 0.15)


def test_campaign_ids_name_their_emails(spark):
    """The id depends on the set of emails alone; no row lists them."""
    edges = lambda *pairs: spark.createDataFrame(pairs, "a string, b string")
    found = {}
    for name, pairs in {"chain": (("a", "b"), ("b", "c")), "star": (("a", "c"), ("c", "b")), "less": (("a", "b"),), "other": (("a", "b"), ("b", "d"))}.items():
        patch = pytest.MonkeyPatch()
        patch.setattr(c, "similar_pairs", lambda rows, threshold, pairs=pairs: edges(*pairs))
        members = c.members(None)
        patch.undo()
        assert members.columns == ["email_id", "component", "campaign_id"] and {r.component for r in members.collect()} == {"a"}
        (found[name],) = {r.campaign_id for r in members.collect()}
    assert found["chain"] == found["star"] and len(set(found.values())) == 3


def test_subject_likeness_equals_all_pairs(spark):
    rng = random.Random(9)
    subjects = [" ".join(rng.choice(("urgent", "invoice", *(f"w{k}" for k in range(30)))) for _ in range(rng.randrange(0, 6))) for _ in range(160)]
    rows = spark.createDataFrame([(f"e{k}", s, f"c{k % 3}") for k, s in enumerate(subjects)], "email_id string, subject string, campaign_id string")

    def mean(campaign):
        sets = [set(s.split()) for k, s in enumerate(subjects) if f"c{k % 3}" == campaign and s.split()]
        pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
        return len(sets), sum(pairs) / len(pairs)

    for hot in (256, 8, 1):
        got = {r.campaign_id: (r.n_subjects, r.likeness) for r in c.subject_likeness(rows.drop("campaign_id"), rows.select("email_id", "campaign_id"), hot).collect()}
        assert set(got) == {"c0", "c1", "c2"} and all(got[k][0] == mean(k)[0] and abs(got[k][1] - mean(k)[1]) < 1e-9 for k in got)


def test_subject_likeness_of_many_subjects_that_share_words(spark):
    """20,000 different subjects with one word in common, half of them with another one."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("email_id"), F.concat(F.lit("urgent "), F.when(F.col("id") % 2 == 0, "invoice ").otherwise(""), F.lit("no"), F.col("id").cast("string")).alias("subject"))
    (got,) = c.subject_likeness(rows, rows.select("email_id", F.lit("c").alias("campaign_id"))).collect()
    h = n // 2
    want = (h * (h - 1) / 2 * 2 / 4 + h * (h - 1) / 2 * 1 / 3 + h * h * 1 / 4) / (n * (n - 1) / 2)
    assert got.n_subjects == n and abs(got.likeness - want) < 1e-9


def test_three_alike_and_one_apart(spark):
    day = dt.datetime(2024, 5, 1, 10)
    rows = [(f"e{k}", "Urgent: verify your account", "bad.example", day + dt.timedelta(minutes=10 * k), "fail", "fail", "fail", "phishing", 0.9) for k in range(3)]
    rows.append(("e9", "Weekly garden news", "news.example", day, "pass", "pass", "pass", "benign", 0.1))
    mails = spark.createDataFrame(rows, "email_id string, subject string, sender_domain string, ts timestamp, spf string, dkim string, dmarc string, classification string, risk_score double")
    iocs = spark.createDataFrame([(f"e{k}", "hash", "ff") for k in range(3)] + [("e9", "hash", "00")], "email_id string, kind string, value string")
    resolves = spark.createDataFrame([("bad.example", "198.51.100.7")], "domain string, ip string")
    ready = c.indicator_rows(mails, iocs, resolves)
    scores = {(r.a, r.b): r.score for r in c.similar_pairs(ready, 0.16).collect()}
    assert all(scores[p] >= 0.70 for p in (("e0", "e1"), ("e0", "e2"), ("e1", "e2"))) and scores.get(("e0", "e9"), 0) < 0.25
    members = c.members(ready)
    assert {r.email_id for r in members.collect()} == {"e0", "e1", "e2"}
    (rated,) = c.confidence(ready, members).collect()
    assert rated.infrastructure > 0.5 and rated.temporal > 0.7 and rated.level in ("high", "very_high")


def test_ingesting_again_changes_nothing(spark, data):
    mails = fixtures.emails(spark, data)
    edges = g.edges(mails, fixtures.iocs(mails), fixtures.resolves(mails))
    writes = g.node_writes(mails, edges)
    once = g.upsert_nodes(None, writes)
    twice = g.upsert_nodes(once, writes)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    assert g.ingest_counts(writes, once).agg(F.sum("created")).first()[0] == 0
    assert g.repeated_keys(once).isEmpty()


def test_latest_value_wins_but_null_does_not(spark):
    batch = spark.createDataFrame([("IP", "a", 1, 0.3, "x"), ("IP", "a", 2, None, "y"), ("IP", "a", 3, 0.5, None)], "label string, key string, seq long, risk_score double, name string")
    (row,) = g.upsert_nodes(None, batch).collect()
    assert (row.risk_score, row.name, row.created_seq, row.updated_seq) == (0.5, "y", 1, 3)
    with pytest.raises(ValueError):
        g.lookup(batch, "Nobody", "a")


def test_perfect_scores(spark):
    rows = spark.createDataFrame([(k, k % 2, 0.9 if k % 2 else 0.1) for k in range(40)], "k int, y int, score double")
    m = ev.binary_metrics(rows).first()
    assert (m.precision, m.recall, m.f1, m.accuracy, m.roc_auc, m.pr_auc) == (1, 1, 1, 1, 1, 1)
    assert ev.best_threshold(rows, 0.9).first().threshold == 0.9
    parts = ev.stratified_split(rows, "k", "y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in parts} == {(y, s): n for y in (0, 1) for s, n in (("train", 14), ("validation", 3), ("test", 3))}


def test_intermediate_tables_can_be_cleared(spark):
    first = tables.written(spark.range(5).toDF("x"), "to-clear")
    assert first.count() == 5
    path = first.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    other = tables.shared_dir
    tables.shared_dir = lambda spark: path.split("/lurewatch/")[0] + "/unused"
    try:
        tables.clear(spark)  # a folder that isn't there
        assert os.path.exists(path)
        kept = tables.written(spark.range(3).toDF("x"), "own").inputFiles()[0].removeprefix("file://").removeprefix("file:")
        tables.clear(spark)
        assert os.path.exists(path) and not os.path.exists(kept)
    finally:
        tables.shared_dir = other


def test_machine_local_folders_are_refused_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/tmp/warehouse", "spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def hub_graph(spark, n):
    """One domain of n emails, resolved to two addresses of one network; some emails of their own domain."""
    email = F.concat(F.lit("e"), F.col("id").cast("string"))
    edge = lambda src, a, rel, dst, b: (F.lit(src).alias("src_label"), a.alias("src_key"), F.lit(rel).alias("rel"), F.lit(dst).alias("dst_label"), b.alias("dst_key"))
    ids = spark.range(n)
    out = ids.select(*edge("Email", email, "SENT_FROM", "Domain", F.lit("hub.example")))
    out = out.unionByName(ids.filter("id % 100 = 0").select(*edge("Email", email, "CONTAINS_DOMAIN", "Domain", F.concat(F.lit("d"), F.col("id").cast("string")))))
    some = [("Domain", "hub.example", "RESOLVES_TO", "IP", "i1"), ("Domain", "hub.example", "RESOLVES_TO", "IP", "i2"), ("Domain", "d0", "RESOLVES_TO", "IP", "i1"), ("IP", "i1", "BELONGS_TO_ASN", "ASN", "1"), ("IP", "i2", "BELONGS_TO_ASN", "ASN", "1"), ("Campaign", "c", "USES_IP", "IP", "i1"), ("Email", "e1", "CONTAINS_HASH", "Hash", "h"), ("Email", "e2", "CONTAINS_HASH", "Hash", "h"), ("Campaign", "c", "USES_HASH", "Hash", "h")]
    return tables.written(out.unionByName(spark.createDataFrame(some, out.schema)), "hub-edges")


def test_pivots_of_a_mail_provider(spark):
    """A domain of 200,000 emails: right numbers, all members listed, and no row that grows with them."""
    n = 200_000
    edges = hub_graph(spark, n)
    ips = {r.ip: r for r in pivots.ip_pivot(edges).collect()}
    assert (ips["i1"].n_domains, ips["i1"].n_emails, ips["i1"].n_campaigns, ips["i1"].n_asns, ips["i1"].strength) == (2, n, 1, 1, 1.0) and (ips["i2"].n_domains, ips["i2"].n_emails) == (1, n)
    domains = {r.domain: r for r in pivots.domain_pivot(edges).collect()}
    assert domains["hub.example"].n_emails == n and domains["hub.example"].n_ips == 2 and domains["d100"].n_emails == 1 and domains["d100"].strength == 0.2
    (asn,) = pivots.asn_pivot(edges).collect()
    assert (asn.n_ips, asn.n_domains, asn.n_emails) == (2, 2, n)
    (held,) = pivots.hash_pivot(edges).collect()
    assert (held.n_emails, held.n_campaigns, round(held.strength, 6)) == (2, 1, 1.0)
    members = pivots.ip_members(edges)
    assert members.filter("ip = 'i2' AND kind = 'email'").count() == n and members.select(F.max(F.length(F.to_json(F.struct(*members.columns))))).first()[0] < 200
    assert [(r.ip, r.n_emails) for r in pivots.clusters(edges, 1).collect()] == [("i1", n)]


def test_neighbourhoods_are_bounded(spark):
    """Against a search by hand: nodes with few neighbours first, at most so many, and the edges between them."""
    rng = random.Random(12)
    rows = {("Email", f"e{rng.randrange(30)}", "SENT_FROM", "Domain", f"d{rng.randrange(12)}") for _ in range(60)} | {("Domain", f"d{k}", "RESOLVES_TO", "IP", f"i{k % 3}") for k in range(12)} | {("Email", f"e{k}", "CONTAINS_DOMAIN", "Domain", "d0") for k in range(30)}
    edges = spark.createDataFrame(sorted(rows), "src_label string, src_key string, rel string, dst_label string, dst_key string")
    near = {}
    for a, b, _, c_, d in rows:
        near.setdefault((a, b), set()).add((c_, d))
        near.setdefault((c_, d), set()).add((a, b))

    def search(centre, depth, limit):
        seen = {centre: 0}
        for step in range(1, depth + 1):
            found = {x for n, k in seen.items() if k == step - 1 for x in near.get(n, ())} - set(seen)
            for x in sorted(found, key=lambda x: (len(near[x]), x))[: limit - len(seen)]:
                seen[x] = step
        return seen

    for depth, limit in ((2, 50), (2, 6), (4, 12), (1, 1), (9, 500)):
        centres = [("Email", f"e{k}") for k in range(0, 30, 5)] + [("IP", "i0"), ("Email", "nobody")]
        nodes, inside = pivots.neighbourhood(edges, spark.createDataFrame(centres, "label string, key string"), depth, limit)
        want = {f"{a}:{b}": search((a, b), min(depth, 4), min(limit, 100)) for a, b in centres}
        got = {}
        for r in nodes.collect():
            got.setdefault(r.centre, {})[r.label, r.key] = r.distance
        assert got == want
        links = {(r.centre, r.src_label, r.src_key, r.rel, r.dst_label, r.dst_key) for r in inside.collect()}
        assert links == {(k, *e) for k, seen in want.items() for e in rows if (e[0], e[1]) in seen and (e[3], e[4]) in seen and min(seen[e[0], e[1]], seen[e[3], e[4]]) <= min(depth, 4) - 1}


def test_neighbourhoods_around_a_hub(spark):
    """Many centres that all reach one hub: each takes its share, and no join copies the hub's list for each of them."""
    edges = hub_graph(spark, 20_000)
    centres = spark.range(0, 20_000, 20).select(F.lit("Email").alias("label"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("key"))
    nodes, inside = pivots.neighbourhood(edges, centres)
    assert nodes.groupBy("centre").count().agg(F.max("count"), F.min("count"), F.count("*")).first()[:] == (50, 50, 1000)
    assert inside.count() >= 1000 * 49


def test_pivots_list_their_members(spark):
    """Every member stands in the pivot's row itself, as many as are counted."""
    edges = hub_graph(spark, 3000)
    mails = sorted(f"e{k}" for k in range(3000))
    ips = {r.ip: r for r in pivots.ip_lists(edges).collect()}
    assert (ips["i1"].domains, ips["i1"].emails, ips["i1"].campaigns, ips["i1"].asns) == (["d0", "hub.example"], mails, ["c"], ["1"]) and ips["i2"].campaigns == []
    domains = {r.domain: r for r in pivots.domain_lists(edges).collect()}
    assert domains["hub.example"].emails == mails and domains["d100"].emails == ["e100"] and domains["d100"].urls == []
    (asn,), (held,), (first,) = pivots.asn_lists(edges).collect(), pivots.hash_lists(edges).collect(), pivots.cluster_lists(edges, 1).collect()
    assert (asn.ips, asn.domains, asn.emails) == (["i1", "i2"], ["d0", "hub.example"], mails)
    assert (held.emails, held.campaigns) == (["e1", "e2"], ["c"]) and (first.ip, first.n_emails, first.campaigns) == ("i1", 3000, ["c"])


@pytest.mark.parametrize("chunk", [1024, 7])
def test_whole_neighbourhoods(spark, monkeypatch, chunk):
    """No node is left out, however many there are, and no edge of a node that isn't of the last level."""
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    edges = hub_graph(spark, 300)
    rows = {tuple(r) for r in edges.collect()}
    near = {}
    for a, b, _, c_, d in rows:
        near.setdefault((a, b), set()).add((c_, d))
        near.setdefault((c_, d), set()).add((a, b))
    for depth in (1, 2, 3):
        want, links = {}, set()
        for k in range(0, 300, 60):
            seen = {("Email", f"e{k}"): 0}
            for step in range(1, depth + 1):
                seen.update({x: step for n, at in list(seen.items()) if at == step - 1 for x in near[n] if x not in seen})
            want |= {(f"Email:e{k}", *n): at for n, at in seen.items()}
            links |= {(f"Email:e{k}", *e) for e in rows if min(seen.get(e[:2], 9), seen.get(e[3:], 9)) < depth}
        nodes, inside = pivots.whole_neighbourhood(edges, spark.createDataFrame([("Email", f"e{k}") for k in range(0, 300, 60)], "label string, key string"), depth)
        assert {(r.centre, r.label, r.key): r.distance for r in nodes.collect()} == want and (depth < 2 or len(want) > 5 * 300)
        found = [tuple(r) for r in inside.collect()]
        assert set(found) == links and len(found) == len(links)


@pytest.mark.parametrize("listed", [0, 3, 32])
def test_whole_neighbourhoods_of_any_graph(spark, monkeypatch, listed):
    """Loops, several links between two nodes, repeated edges, hubs and a centre of its own, with and without the short lists."""
    monkeypatch.setattr(pivots, "LISTED", listed)
    monkeypatch.setattr(pivots, "CHUNK", 4)
    rng = random.Random(7)
    name = lambda k: ("A" if k % 2 else "B", f"n{k}")
    rows = [(*name(rng.randrange(24)), rng.choice(("R", "S")), *name(rng.choice((0, rng.randrange(24))))) for _ in range(40)] + [("A", "n1", "R", "A", "n1"), ("A", "n1", "S", "A", "n1")]
    edges = spark.createDataFrame(rows * 2, "src_label string, src_key string, rel string, dst_label string, dst_key string")
    centres = [*map(name, range(0, 24, 5)), ("A", "n1"), ("A", "alone")]
    near = {}
    for a, b, _, c_, d in rows:
        near.setdefault((a, b), set()).add((c_, d))
        near.setdefault((c_, d), set()).add((a, b))
    for depth in (1, 2) if listed else (2,):
        want, links = {}, set()
        for centre in centres:
            seen = {centre: 0}
            for step in range(1, depth + 1):
                seen.update({x: step for n, at in list(seen.items()) if at == step - 1 for x in near.get(n, ()) if x not in seen})
            want |= {(":".join(centre), *n): at for n, at in seen.items()}
            links |= {(":".join(centre), *e) for e in rows if min(seen.get(e[:2], 9), seen.get(e[3:], 9)) < depth}
        nodes, inside = pivots.whole_neighbourhood(edges, spark.createDataFrame(centres, "label string, key string"), depth)
        got, found = nodes.collect(), [tuple(r) for r in inside.collect()]
        assert {(r.centre, r.label, r.key): r.distance for r in got} == want and len(got) == len(want)
        assert set(found) == links and len(found) == len(links)


def test_whole_neighbourhoods_are_not_written(spark, monkeypatch):
    """150 centres that share a hub of 300: their 45,000 nodes are returned, and neither they nor a part that grows like them are written before."""
    kept = []
    monkeypatch.setattr(pivots, "written", lambda df, name: kept.append(tables.written(df, name)) or kept[-1])
    edges = hub_graph(spark, 300)
    centres = edges.filter("rel = 'SENT_FROM' AND cast(substr(src_key, 2) AS INT) % 2 = 0").select(F.col("src_label").alias("label"), F.col("src_key").alias("key"))
    nodes, inside = pivots.whole_neighbourhood(edges, centres)
    assert nodes.count() > 150 * 300 < inside.count()
    assert max(t.count() for t in kept) < 1000


@pytest.mark.parametrize(("hot", "threshold"), [(3, 0.45), (3, 0.42), (3, 0.62)])
def test_hot_indicators_lose_no_pair(spark, data, monkeypatch, hot, threshold):
    """Indicators that stand for narrower keys: the same pairs as by the product, and the same campaigns from the links."""
    monkeypatch.setattr(c, "HOT", hot)
    k = F.col("doc_id")
    subject = F.when(k % 5 == 0, F.concat(F.lit("invoice due "), (k % 3).cast("string"))).when(k % 5 == 1, "").when(k % 5 == 2, F.lit("Invoice")).otherwise(F.col("subject"))
    ts = F.when(k % 11 == 0, None).when(k % 2 == 0, F.timestamp_seconds(F.unix_timestamp("ts") * 9)).otherwise(F.col("ts"))
    domains = F.array_union("domains", F.when(k % 4 == 0, F.array(F.lit("gmail.com"))).otherwise(F.array(F.lit("shared.example"))))
    rows = tables.written(_rows(spark, data).filter("doc_id < 90").withColumns({"subject": subject, "ts": F.when(F.lit(threshold == 0.42), F.col("ts")).otherwise(ts), "domains": domains}), "rows")
    want = {p for p, x in every_pair(rows).items() if x >= threshold}
    assert {(r.a, r.b) for r in c.similar_pairs(rows, threshold).collect()} == want and want
    linked = tables.written(c.links(rows, threshold), "links")
    assert {(r.a, r.b) for r in linked.collect()} <= want
    assert sorted(map(tuple, c.members(rows, threshold, linked=linked).collect())) == sorted(map(tuple, c.members(rows, threshold).collect()))


def test_copies_of_a_subject_at_a_hot_host_are_not_paired(spark):
    """2,000 emails of one host and subject, weeks apart: one campaign, from links of their number and not of its square."""
    n = 2000
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1_000_000)
    rows = spark.range(n).select(F.concat(F.lit("e"), "id").alias("email_id"), F.lit("Weekly offer for you").alias("subject"), F.lit("").alias("sender_domain"), ts.alias("ts"), F.array(F.lit("hub.example")).alias("domains"), *(F.array().cast("array<string>").alias(x) for x in ("urls", "hashes", "ips")), F.lit("unknown").alias("spf"), F.lit("unknown").alias("dmarc"), F.lit("phishing").alias("classification"))
    linked = tables.written(c.links(rows), "links")
    assert linked.count() == n - 1 and c.members(rows, linked=linked).groupBy("campaign_id").count().collect()[0]["count"] == n


def test_pairs_are_judged_where_they_meet(spark, data):
    """No pair is shuffled, each comes once, and its parts and score are those of the product."""
    rows = tables.written(_rows(spark, data).filter("doc_id < 90"), "rows")
    scores = every_pair(rows)
    for threshold in (0.45, 0.3):
        found = c.similar_pairs(rows, threshold)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "HashJoin" in plan
        assert "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan
        got = [((r.a, r.b), round(r.score, 3)) for r in found.collect()]
        assert dict(got) == {p: x for p, x in scores.items() if x >= threshold} and len(dict(got)) == len(got)
