"""The pipeline's stages take effect, keep clean documents and follow one another."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from wardlake.llm import jaccard_join, secret_scan
from wardlake.llm.tables import kept
from wardlake.sources.tables import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf), "stage")
        after[name] = docs
        assert name == "packing" or docs.columns == columns
    whole = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    gone = whole.join(after["toxicity"], "doc_id", "left_anti")
    assert gone.join(labels.where("toxic = 0"), "doc_id").count() == 0
    assert gone.join(labels.where("toxic = 1"), "doc_id").count() > 0
    rule = jaccard_join.Rule(5, 80, 100)
    assert jaccard_join.join_components(after["near_duplicates"], rule).where(F.col("doc_id") != F.col("component_id")).count() == 0
    groups = jaccard_join.join_components(after["toxicity"], rule)
    assert groups.select("component_id").distinct().count() == after["near_duplicates"].count()
    before = {r["doc_id"]: r["text"] for r in after["near_duplicates"].collect()}
    masked = {r["doc_id"]: r for r in after["secrets"].collect()}
    assert before.keys() == masked.keys()
    for i, text in before.items():
        assert masked[i]["text"] == secret_scan.redacted(text) and not secret_scan.base_spans(masked[i]["text"])
    packed = after["packing"]
    assert packed.select("doc_id").distinct().count() == len(masked)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
