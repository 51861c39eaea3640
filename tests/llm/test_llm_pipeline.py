"""The corpus pipeline, stage by stage, against brute force."""

import re
from collections import Counter

import corpus_pipeline as cp
from test_llm_operators import check_packing, odd_rows, quality_counts, SCHEMA, true_components  # noqa: I001
from pyspark.sql import functions as F

from lurewatch.llm import mixing, quality
from lurewatch.llm.common import table

WORDS = r"[^\x20\x09-\x0D]+"


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == docs.columns
        rows = out.collect()
        if k == 0:
            judged = {r.doc_id: r for r in quality.verdicts(docs, table(spark, data, "labels").filter("quality = 1").select("doc_id")).collect()}
            assert {r.doc_id for r in rows} == {i for i, r in judged.items() if not r.base_failed and r.score >= quality.THRESHOLD} and len(rows) < len(before)
            assert all(judged[i].base_failed == (quality_counts(t)[0] < 20 or 100 * quality_counts(t)[4] > 30 * quality_counts(t)[0]) for i, t in before.items())
        elif k == 1:
            newest = {}
            for i, t in before.items():
                newest[t] = max(i, newest.get(t, i))
            assert sorted(r.doc_id for r in rows) == sorted(newest.values())
        elif k == 2:
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in true_components(before).items() if c == i)
        elif k == 3:
            taken = {r.doc_id: (r.epochs, r.prefix_tokens) for r in mixing.plan(docs).collect()}
            want = Counter()
            for i, (epochs, prefix) in taken.items():
                words = re.findall(WORDS, before[i])
                want.update({(i, len(words)): epochs})
                want.update({(i, prefix): 1} if prefix else {})
            assert Counter((r.doc_id, len(re.findall(WORDS, r.text))) for r in rows) == +want
        if k < 4:
            assert rows
            docs = spark.createDataFrame(rows, docs.schema)
    single = docs.dropDuplicates(["doc_id"])  # the check below tells documents apart by doc_id
    check_packing(cp.STAGES[4][1](spark, single, data).collect(), [(r.doc_id, r.text) for r in single.collect()])


def test_odd_rows_and_columns(spark, data):
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("quality", F.lit(1)).withColumn("row", F.lit("x"))
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns
            out.collect()
        cp.STAGES[-1][1](spark, docs, data).collect()


def test_run(spark, data):
    out = cp.run(spark, data)
    assert out.count() > 0 and "sequence_id" in out.columns
