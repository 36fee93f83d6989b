"""Joins of tables that grow with the documents are no broadcasts, which the driver would hold."""

import corpus_pipeline
from tapeloom.llm import simhash


def joins(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_near_duplicates_broadcast_nothing(spark, small, monkeypatch):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    frame, checkpoint = type(docs), type(docs).checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **b: (seen.extend(joins(df)), checkpoint(df, *a, **b))[1])
    for module in (simhash, corpus_pipeline):
        monkeypatch.setattr(module, "stored", lambda df, tag, f=module.stored: (seen.extend(joins(df)), f(df, tag))[1])
    seen += joins(simhash.near_duplicates(docs)) + joins(corpus_pipeline.dedup_stage(spark, docs, small))
    assert len(seen) > 10
    assert [j for j in seen if "strategy=merge" not in j] == []
