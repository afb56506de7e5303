"""The pipeline: every stage on its own input."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from seekledger.llm import queries as q
from seekledger.llm import scratch, sentencepiece_codec


def test_stages(spark, sf_dir, documents):
    docs = q.table(spark, sf_dir, "documents")
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), "stage")
        results[name] = docs.collect()
        assert docs.columns[: len(columns)] == columns
    kept = {r.doc_id for r in q.op1_quality_rules(spark, sf_dir).filter("kept").collect()}
    assert {r.doc_id for r in results["quality_rules"]} == kept
    assert {r.doc_id for r in results["line_dedup"]} <= kept
    assert all(r.n_chars == len(r.text) for r in results["line_dedup"])
    joined = {r.doc_id for r in results["ngram_jaccard_join"]}
    assert joined <= {r.doc_id for r in results["line_dedup"]} and len(joined) == len(results["ngram_jaccard_join"])
    assert {r.doc_id for r in results["mixing"]} <= joined
    assert sorted((r.doc_id, r.text) for r in results["sentencepiece"]) == sorted((r.doc_id, r.text) for r in results["mixing"])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(results["sentencepiece"])


def test_texts_cross_once_to_be_coded(spark, sf_dir):
    docs = q.table(spark, sf_dir, "documents")
    out = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, sf_dir)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    model = sentencepiece_codec.Model.load(q.PIECES)
    two = sentencepiece_codec.encode(docs, model).withColumn("_ids", F.col("ids"))
    two = sentencepiece_codec.decode(two, model, ids="_ids").select(*docs.columns, "ids")
    assert out.schema == two.schema and sorted(map(str, out.collect())) == sorted(map(str, two.collect()))


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
