"""The keyed graph store, its streaming ingest, and session windows on a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import graph as g
from lurewatch.operators import relay
from lurewatch.sources import readers
from lurewatch.streaming import ingest
from lurewatch.streaming.store import GraphStore


def payload(n, risk, subject="s", at="2024-01-01T00:00:00Z"):
    return {
        "email": {"email_id": f"e{n}", "subject": subject, "sender": f"x@D{n}.example", "timestamp": at}, "detection": {"classification": "spam", "risk_score": risk, "confidence": 0.5},
        "iocs": {"domains": [{"value": "HTTP://A.example/x"}], "ips": [{"value": "198.51.100.7", "asn": "64500"}], "urls": [{"value": "B.example/p"}], "hashes": [{"value": "ABCD"}], "ip_domain_mapping": {"198.51.100.7": "a.example"}},
    }


def state(store):
    return {(r.label, r.key): (r.risk_score, r.name) for r in store.nodes().collect()}, {tuple(r)[:5] for r in store.edges().collect()}


@pytest.fixture
def drop(spark, tmp_path):
    """A function that drops payloads into an inbox as one file and ingests it; and the store."""
    (tmp_path / "inbox").mkdir()
    store = GraphStore(spark, str(tmp_path / "store"), buckets=8)
    count = [0]

    def run(*docs):
        count[0] += 1
        (tmp_path / "inbox" / f"{count[0]:03d}.json").write_text("\n".join(map(json.dumps, docs)))
        ingest.start_ingest(ingest.payload_stream(spark, str(tmp_path / "inbox")), store, str(tmp_path / "state")).awaitTermination()
        return store.manifest["counts"]

    return run, store


def test_three_writes_of_one_key_in_a_batch(drop):
    run, store = drop
    counts = run(payload(1, 0.1, "s1"), payload(1, 0.2, "s2"), payload(1, 0.3, "s3"))
    nodes, edges = state(store)
    assert nodes["Email", "e1"] == (0.3, "s3") and nodes["Domain", "d1.example"][0] == 0.3
    url = next(k for label, k in nodes if label == "URL")
    assert nodes["URL", url] == (0.3, "http://b.example/p") and nodes["ASN", "64500"] == (None, None) and nodes["IP", "198.51.100.7"][0] == 0.3
    assert edges == {
        ("Email", "e1", "SENT_FROM", "Domain", "d1.example"), ("Email", "e1", "CONTAINS_DOMAIN", "Domain", "a.example"), ("Email", "e1", "CONTAINS_URL", "URL", url), ("URL", url, "HOSTED_ON_DOMAIN", "Domain", "b.example"),
        ("IP", "198.51.100.7", "BELONGS_TO_ASN", "ASN", "64500"), ("Domain", "a.example", "RESOLVES_TO", "IP", "198.51.100.7"), ("Email", "e1", "CONTAINS_HASH", "Hash", "abcd"),
    }
    assert counts == {"nodes_created": len(nodes), "nodes_matched": 0, "edges_created": 7, "edges_matched": 0}


def test_payload_time_comes_before_place(drop):
    run, store = drop
    run(payload(1, 0.9, "late", "2024-01-03T00:00:00Z"), payload(1, 0.1, "early", "2024-01-02T00:00:00Z"))
    assert state(store)[0]["Email", "e1"] == (0.9, "late")
    run(payload(1, 0.2, "", "2024-01-01T00:00:00Z"))  # a later batch wins, whatever its payloads' times
    assert state(store)[0]["Email", "e1"][0] == 0.2


def test_repeated_batches_change_nothing(spark, drop):
    run, store = drop
    run(payload(1, 0.9), payload(2, 1.5))
    before, version = state(store), store.manifest["version"]
    rows = spark.read.schema(readers.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(payload(1, 0.0))])).withColumn("place", F.lit(0))
    assert ingest.ingest_batch(store, rows, 0) == {} and store.manifest["version"] == version  # the ledger has batch 0
    counts = run(payload(1, 0.9), payload(2, 1.5))
    assert state(store) == before and counts["nodes_created"] == counts["edges_created"] == 0 and counts["edges_matched"] == len(before[1]) == 11
    assert before[0]["Email", "e2"][0] == 1.0
    run(payload(1, 0.2))  # a changed one wins, in the nodes that it shares with others, too
    nodes, edges = state(store)
    assert nodes["Email", "e1"][0] == nodes["Hash", "abcd"][0] == 0.2 and nodes["Email", "e2"][0] == 1.0 and edges == before[1]


def test_a_batch_that_fails_midway_leaves_the_old_state(spark, drop, monkeypatch):
    run, store = drop
    run(payload(1, 0.9))
    before = state(store)
    monkeypatch.setattr(store, "_commit", lambda manifest: 1 / 0)
    rows = spark.read.schema(readers.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(payload(1, 0.1)), json.dumps(payload(3, 0.1))])).withColumn("place", F.lit(0))
    with pytest.raises(ZeroDivisionError):
        ingest.ingest_batch(store, rows, 7)
    monkeypatch.undo()
    again = GraphStore(spark, store.path)
    assert state(again) == before == state(store) and again.buckets == 8
    assert ingest.ingest_batch(again, rows, 7)["nodes_created"] == 2 and state(again)[0]["Email", "e1"][0] == 0.1


def test_only_touched_buckets_are_rewritten_and_one_is_read(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), buckets=16)
    rows = lambda *keys: spark.createDataFrame([("Email", k, 0.5, None, 1) for k in keys], "label string, key string, risk_score double, name string, order int")
    none = spark.createDataFrame([], "src_label string, src_key string, rel string, dst_label string, dst_key string")
    store.merge(rows(*(f"e{k}" for k in range(100))), none, 0)
    first = dict(store.manifest["nodes"])
    for k in range(1, 6):
        store.merge(rows("e7"), none, k)
    changed = [b for b, v in store.manifest["nodes"].items() if v != first[b]]
    assert len(first) == 16 and len(changed) == 1 and store.nodes().count() == 100
    assert len({f.rsplit("/", 1)[0] for f in store.nodes().inputFiles()}) == 16 and len(store.node("Email", "e7").inputFiles()) == 1
    found = store.node("Email", "e7").first()
    assert (found.created_seq, found.updated_seq) == (1, 6)
    assert store.vacuum() == 5 + 6 and store.vacuum() == 0 and store.nodes().count() == 100 and GraphStore(spark, store.path).nodes().count() == 100
    with pytest.raises(ValueError):
        store.node("Person", "x")


def test_edges_need_both_ends(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), buckets=4)
    node = lambda *keys: spark.createDataFrame([(label, k, None, None, 1) for label, k in keys], "label string, key string, risk_score double, name string, order int")
    edge = lambda *ends: spark.createDataFrame([("Email", a, "SENT_FROM", "Domain", b) for a, b in ends], "src_label string, src_key string, rel string, dst_label string, dst_key string")
    assert store.merge(node(("Email", "a")), edge(("a", "x")), 0) == {"nodes_created": 1, "nodes_matched": 0, "edges_created": 0, "edges_matched": 0}
    assert store.merge(node(("Domain", "x")), edge(("a", "x"), ("b", "x")), 1)["edges_created"] == 1
    assert store.merge(node(("Email", "b")), edge(("a", "x"), ("b", "x"), ("b", "x")), 2) == {"nodes_created": 1, "nodes_matched": 0, "edges_created": 1, "edges_matched": 1}


def test_random_batches_equal_one_by_one_merging(spark, tmp_path):
    rng = random.Random(4)
    store, want, links = GraphStore(spark, str(tmp_path / "store"), buckets=4), {}, set()
    for batch in range(5):
        rows = []
        for place in range(30):
            key = ("Email", f"e{rng.randrange(12)}")
            rows.append((*key, rng.choice([None, rng.random()]), rng.choice([None, f"n{rng.random()}"]), place))
        edges = [("Email", f"e{rng.randrange(14)}", "SENT_FROM", "Email", f"e{rng.randrange(14)}") for _ in range(10)]
        for label, key, risk, name, _ in rows:
            old = want.get((label, key), (None, None))
            want[label, key] = (old[0] if risk is None else risk, old[1] if name is None else name)
        links |= {e for e in edges if (e[0], e[1]) in want and (e[3], e[4]) in want}
        rng.shuffle(rows)
        store.merge(spark.createDataFrame(rows, "label string, key string, risk_score double, name string, order int"), spark.createDataFrame(edges, "src_label string, src_key string, rel string, dst_label string, dst_key string"), batch)
        assert state(store) == (want, links)
    assert g.repeated_keys(store.nodes()).isEmpty()


def test_sessions_on_a_stream(spark, tmp_path):
    """Mails in any order within the delay give the batch's sessions; late ones are counted, not lost in silence."""
    rng = random.Random(6)
    (tmp_path / "in").mkdir()
    times = sorted(rng.randrange(0, 40 * 3600) for _ in range(150))
    rows = [(f"d{rng.randrange(3)}", t) for t in times]
    parts = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    write = lambda n, part: (tmp_path / "in" / f"{n:03d}.json").write_text("\n".join(json.dumps({"domain": d, "t": t}) for d, t in part))
    schema, late = "domain string, t long", "8 hours"
    run = lambda: ingest.start_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).select("domain", F.timestamp_seconds("t").alias("ts")), "domain", str(tmp_path / "out"), str(tmp_path / "state"), late=late)
    dropped = 0
    for n, part in enumerate(parts):  # within a part in any order; parts overlap by less than the delay
        rng.shuffle(part)
        write(n, part)
    for extra in (range(5, 6), range(6, 7)):  # a mail far ahead closes all sessions; then one that is too late
        for n in extra:
            write(n, [("end", 100 * 3600)] if n == 5 else [("d0", 10), ("end", 101 * 3600)])
        query = run()
        query.awaitTermination()
        dropped += ingest.late_rows(query)
    got = sorted((r.domain, r.start, r.end, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = relay.bursts(spark.createDataFrame(rows, schema).select("domain", F.timestamp_seconds("t").alias("ts")).withColumn("event_id", F.monotonically_increasing_id()), "domain")
    assert got == sorted((r.domain, r.start, r.end, r.n) for r in batch.collect()) and dropped == 1
