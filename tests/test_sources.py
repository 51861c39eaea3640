"""Readers, case store and streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import messages
from lurewatch.sources import readers
from lurewatch.sources.cases import CaseStore
from lurewatch.streaming import ingest


def payload(k, risk, url="http://A.example/x"):
    return {"email": {"email_id": f"e{k}", "subject": f"s{k}", "sender": f"Desk <desk@D{k}.example>", "sender_domain": ""}, "iocs": {"domains": [{"value": "HTTPS://A.example/p", "source": "b"}], "ips": [{"value": "198.51.100.7"}, {"value": "bad"}], "urls": [{"value": url}], "hashes": [{"value": "ABCD"}]}, "detection": {"risk_score": risk}}


def test_hour_windows(spark, data):
    got = ingest.burst_windows(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_csv_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"two\nlines", HAM \nx,spam\nx,spam\ny,\nz,odd\n')
    rows = readers.labelled_csv(spark, str(tmp_path / "a.csv"), required=("body",))
    assert sorted(map(tuple, rows.collect())) == [("two\nlines", "benign"), ("x", "spam"), ("z", "odd")]
    assert [r.label for r in readers.unknown_labels(rows).collect()] == ["odd"]
    with pytest.raises(ValueError):
        readers.labelled_csv(spark, str(tmp_path / "a.csv"), required=("nothing",))


def test_folders_cases_and_documents(spark, tmp_path):
    for name in ("spam_1", "ham_1"):
        (tmp_path / "mail" / name).mkdir(parents=True)
        (tmp_path / "mail" / name / "m.eml").write_bytes(b"Subject: caf\xe9\n\nx")
    mails = readers.mail_folder(spark, str(tmp_path / "mail"), pattern="*.eml")
    assert sorted((r.label, r.raw[:13]) for r in mails.collect()) == [("benign", "Subject: café"), ("spam", "Subject: café")]
    assert readers.combined(mails, mails.select("path").withColumn("more", F.lit(1))).count() == 4
    cases = spark.createDataFrame([("c1", "2024-01-01T00:00:00", 1.0), ("c2", "2024-01-02T00:00:00", 2.0)], "case_id string, created_at string, score double")
    readers.save_cases(cases, str(tmp_path / "cases"))
    schema = "case_id string, created_at string, score double"
    assert [r.case_id for r in readers.latest_cases(spark, str(tmp_path / "cases"), schema, 0).collect()] == ["c2"]
    assert readers.case(spark, str(tmp_path / "cases"), schema, "c1").first().score == 1.0
    assert sorted(readers.from_document(readers.to_document(cases), cases.schema).collect()) == sorted(cases.collect())


def test_payload_lines_and_files(spark, tmp_path):
    one, two = ('{"analysis_id": "%s", "email": {"email_id": "%s"}}' % (k, k) for k in "ab")
    (tmp_path / "lines.json").write_text(one + "\n" + two + "\n")
    assert sorted(r.analysis_id for r in readers.payloads(spark, str(tmp_path / "lines.json")).collect()) == ["a", "b"]
    (tmp_path / "file.json").write_text("[" + one.replace(",", ",\n") + ",\n" + two + "]")
    assert sorted(r.analysis_id for r in readers.payloads(spark, str(tmp_path / "file.json"), whole_files=True).collect()) == ["a", "b"]


def test_folder_names_are_labels(spark):
    cases = {"file:/data/antispam/ham/x": "benign", "file:/d/spam_2/x": "spam", "file:/d/easy-ham/1": "benign", "file:/ham/spam/x.eml": "spam", "file:/d/hamlet/spammers/x": None, "file:/d/x.spam": None}
    got = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", readers.folder_label(F.col("path"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_corpora(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for name in ("a.eml", "b.txt", "c.pdf", "d"):
        (tmp_path / "c" / name).write_text("Subject: x\n\nbody")
    assert sorted(r.path[-1] for r in readers.corpus(spark, "nazario", str(tmp_path / "c")).collect()) == ["d", "l", "t"]
    (tmp_path / "t.csv").write_text("text,label\nhello,spam\n")
    assert readers.corpus(spark, "bec", str(tmp_path / "t.csv")).collect()[0].asDict() == {"body_text": "hello", "label": "bec"}
    rows, counts = readers.labelled_mails(spark, str(tmp_path / "c"), "phishing")
    assert [r.label for r in rows.collect()] == ["phishing"] and tuple(counts.first()) == (1, 0)
    with pytest.raises(ValueError):
        readers.corpus(spark, "none", "x")


def test_a_look_up_reads_one_bucket(spark, tmp_path):
    schema = "case_id string, created_at string, score double"
    store = CaseStore(spark, str(tmp_path / "store"), schema, buckets=8)
    rows = [(f"c{k}", f"2024-01-{k % 28 + 1:02d}T00:00:00", float(k)) for k in range(300)]
    assert store.case("c1").isEmpty()
    store.save(spark.createDataFrame(rows[:200], schema))
    store = CaseStore(spark, str(tmp_path / "store"), schema, buckets=99)  # the number that it was made with counts
    store.save(spark.createDataFrame(rows[200:], schema))
    assert store.buckets == 8 and store.table().count() == 300
    one = store.case("c250")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in plan and "EqualTo(case_id,c250)" in plan and len({f.rsplit("/", 1)[0] for f in store.table().inputFiles()}) == 8
    one.collect()
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 1
    assert one.collect()[0].score == 250.0 and store.case("nothing").isEmpty()
    assert [r.created_at for r in store.latest(2).collect()] == ["2024-01-28T00:00:00"] * 2 and len(store.latest(0).collect()) == 1
    store.export(str(tmp_path / "json"))
    assert sorted(r.case_id for r in readers.latest_cases(spark, str(tmp_path / "json"), schema, 200).collect())[:1] and spark.read.json(str(tmp_path / "json")).count() == 300


def test_messages_are_decoded_in_runs(spark):
    """A batch of many messages is cut by bytes; every message keeps its row."""
    rows = [(str(k), bytearray(b"Subject: s%d\n\n" % k + b"x" * (1 << 20))) for k in range(20)] + [("none", None), ("empty", bytearray(b""))]
    got = {r.email_id: r for r in messages.decoded(spark.createDataFrame(rows, "email_id string, content binary").coalesce(1)).collect()}
    assert set(got) == {i for i, _ in rows} and all(len(got[str(k)].text_plain) == 1 << 20 and got[str(k)].headers[0].value == f"s{k}" for k in range(20))
