"""How the driver's tables stand for the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: source is the file, twenty ids are a page, every fifth is a table and so on."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("file_name"),
        F.expr("CAST(doc_id DIV 60 AS INT)").alias("page_num"),
        F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("text", "text", "table", "image", "superchunk")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("content_type"),
        F.col("text").alias("original_chunk"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 11 == 0, F.lit("alta")).otherwise(F.concat(F.lit("0."), (F.col("doc_id") % 10).cast("string"))).alias("confidence"),
        "lang",
    )


CHUNKS = """chunks AS (SELECT doc_id, source AS file_name, CAST(doc_id // 60 AS INT) AS page_num, 'chunk_' || doc_id AS chunk_id,
  ['text','text','table','image','superchunk'][CAST(doc_id % 5 + 1 AS INT)] AS content_type, text AS original_chunk,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'alta' ELSE '0.' || (doc_id % 10) END AS confidence, lang FROM documents)"""


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a small table: a header row, then its lines (name, code, quantity)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    row = lambda x: F.array(
        F.when(x["l_partkey"] % 3 == 0, F.concat(F.lit("F"), F.lpad((x["l_partkey"] % 100).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("item "), x["l_suppkey"].cast("string"))),
        F.concat(F.lit("P"), F.lpad((x["l_partkey"] % 1000).cast("string"), 3, "0")),
        F.when(x["q"] % 4 == 0, F.lit("")).otherwise(x["q"].cast("string")),
    )
    return o.select(F.col("l_orderkey").alias("table_id"), F.concat(F.array(F.array(F.lit("Nombre"), F.lit("Código"), F.lit("Cantidad"))), F.transform("lines", row)).alias("rows"))


TABLES = """order_lines AS (SELECT l_orderkey AS table_id, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'q': CAST(trunc(l_quantity) AS INT)} ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS INT)) AS lines
  FROM lineitem GROUP BY 1),
order_tables AS (SELECT table_id, list_concat([['Nombre','Código','Cantidad']], list_transform(lines, lambda x: [
  CASE WHEN x.p % 3 = 0 THEN 'F' || lpad(CAST(x.p % 100 AS VARCHAR), 2, '0') ELSE 'item ' || x.s END, 'P' || lpad(CAST(x.p % 1000 AS VARCHAR), 3, '0'),
  CASE WHEN x.q % 4 = 0 THEN '' ELSE CAST(x.q AS VARCHAR) END])) AS rows FROM order_lines)"""
