from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_near_text import slow_classes
from tests.llm.test_operators import ODD, odd_docs, slow_spans
from trajlake.llm import decontaminate, mixing, quality_rules
from trajlake.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality_rules", "near_duplicates", "repeats", "decontamination", "mixing"]

    one = by_name["quality_rules"](spark, docs, SF)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept

    two = by_name["near_duplicates"](spark, one, SF)
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    root = slow_classes(list(rows.items()))
    assert {r["doc_id"] for r in two.collect()} == {i for i in root if root[i] == i}

    two_rows = two.collect()
    three = by_name["repeats"](spark, two, SF)
    assert three.columns == docs.columns
    want = {i: (n, gone) for i, n, gone, _, _ in slow_spans([(r["doc_id"], r["text"].encode()) for r in two_rows], 50)}
    for r in three.collect():
        n, gone = want[r["doc_id"]]
        assert 0 <= len(r["text"].encode()) - (n - gone) <= 3 * (gone > 0) * n and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in two_rows} - {r["doc_id"] for r in three.collect()} <= {i for i, (n, gone) in want.items() if gone}

    four = by_name["decontamination"](spark, three, SF)
    m = decontaminate.Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 0.08)
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect() if not m.search(r["text"])}

    five = by_name["mixing"](spark, four, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rates = {r["doc_id"]: r["copies"] for r in mixing.mixed(four, labels, corpus_pipeline.FACTORS, relative=True).collect()}
    counted = {r["doc_id"]: r["n"] for r in five.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: c for i, c in rates.items() if c}


def test_run_keeps_documents_and_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
    out = written(corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01"), "mixed")
    assert {"doc_id", "text", "rate", "copy"} <= set(out.columns)
    words = lambda df: sum(len(r["text"].split()) for r in df.select("text").collect())
    n = docs.count()
    assert n > 600 and out.select("doc_id").distinct().count() >= 0.9 * n and 0.9 * n < out.count() < 1.2 * n
    assert 0.9 < words(out) / words(docs) < 1.1
    top = out.agg(F.max("copy"), F.max("rate")).first()
    assert top[0] <= mixing.BOUND and top[1] <= mixing.BOUND
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 and toxic = 0")
    lost = docs.join(clean, "doc_id", "left_semi").join(out, "doc_id", "left_anti").collect()
    assert len(lost) < 5 and all(len(r["text"].split()) < 50 for r in lost)  # what the stage before has left of a few says little


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), spark.createDataFrame([], ODD)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns), name
            out.count()
