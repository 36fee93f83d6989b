"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; all but the last
return the columns of documents, untouched. Between stages the rows are written to the shared folder and read again, so
a lost executor costs one stage's tasks at most.

A row is a document: near-dedup keeps one row of each group whatever ids it holds, so rows of one doc_id and different texts
stay apart, and a row without a doc_id stays where its group has no row with one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import decontam, mixing, quality, simhash, tokens
from tapeloom.llm.common import held_out, shuffled, stored, text_bytes

MIX = {"share": 0.8, "max_epochs": 1}


def _pick(docs: DataFrame, keep_score, name: str = "__tapeloom_score") -> DataFrame:
    return docs.withColumn(name, keep_score).where(F.col(name) >= 0.3).drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~held_out(5, 0))
    return _pick(docs, quality.scorer(docs, model)(text_bytes()))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: of the smallest doc_id, fingerprint and row in it; a row without an id only where no other is."""
    rows = stored(simhash.fingerprints(docs), "dedup-prints")
    by_fp = stored(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lonely"), "doc_id")).alias("least")), "dedup-distinct")
    groups = by_fp.join(shuffled(simhash.link_fingerprints(by_fp.select("fp"))), "fp")
    keepers = groups.groupBy("component").agg(F.min(F.struct("least.lonely", "least.doc_id", "fp")).alias("k"))
    keepers = stored(keepers.select("k.doc_id", "k.fp"), "dedup-keepers")
    chosen = keepers.where("doc_id IS NOT NULL").withColumn("chosen", F.lit(True))
    per_id = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(shuffled(chosen), ["doc_id", "fp"], "left")
    per_id = per_id.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max(F.coalesce("chosen", F.lit(False))).alias("kept"))
    apart = stored(per_id.where("NOT kept OR n > 1"), "dedup-apart")
    once = docs.where("doc_id IS NOT NULL").join(shuffled(apart.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    lonely = rows.where("doc_id IS NULL").limit(1).count() > 0
    repeated = apart.where("kept AND n > 1").limit(1).count() > 0
    if not (lonely or repeated):
        return once
    return once.unionByName(_one_row_each(docs, apart.where("kept AND n > 1").select("doc_id"), keepers))


def _one_row_each(docs: DataFrame, repeated: DataFrame, keepers: DataFrame) -> DataFrame:
    """Of rows that share a doc_id, and of rows without one, the least row of each kept id and fingerprint."""

    @F.pandas_udf("long")
    def prints(bodies: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash.fingerprint(t) for t in bodies], np.uint64).view(np.int64))

    again = docs.join(shuffled(repeated), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL")).withColumn("__print", prints(text_bytes()))
    chosen = keepers.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
    met = again.join(shuffled(chosen), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__fp")), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = met.groupBy("doc_id", "__print").agg(F.min(F.struct("text", *rest)).alias("__row"))
    return least.select("doc_id", "__row.*").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))  # rows are judged by their texts, with an id or without
    found = decontam.contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = stored(found.select(F.col("doc_id").alias("__text")).distinct(), "pipeline-leaks")
    return docs.withColumn("__text", key).join(leaks, "__text", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's token prefix of its seeded order, within its share of the budget."""
    return mixing.chosen_rows(docs, **MIX)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the chosen documents, and where each lies in them."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
