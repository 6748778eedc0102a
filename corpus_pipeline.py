"""Corpus cleaning pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, token encoding.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame that is written as
Parquet and reread as the next stage's docs. All but the last return the columns of documents; the last gives doc_id,
n_tokens, ids_sha256 and decoded_sha256 of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, decontaminate, exact_dedup, toxicity
from granary.llm.common import cut, read
from granary.llm.queries import kept_by_near_dedup


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_by_near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
