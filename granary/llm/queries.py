"""The registered queries of the subpackage: opN_<name>(spark, sf_dir) over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, html_main, language, near_dedup, quality, token_counts, toxicity, warc
from .common import read


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(read(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty, so every distinct text is encoded in every run."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, and which; documents that hold none have no row."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_ALL = (op1_minhash_near_dedup, op2_warc, op3_language, op4_exact_dedup, op5_html_main, op6_quality, op7_bpe, op8_token_counts, op9_toxicity, op10_decontaminate)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op2_warc": warc.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE}


def kept_by_near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near duplicates."""
    return near_dedup.deduplicated(docs)
