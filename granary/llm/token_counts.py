"""Token counts through a digest cache (operator 8).

A text's key is the SHA-256 of its content (null as empty; nothing else is normalised, since these vocabularies count
white space and case) and the digest of the tokenizer's file and version. Keys are joined to the stored counts; of the
misses one text per distinct digest is encoded; the new counts are appended to the cache, a Parquet table. Whole texts are
shuffled only where a digest may repeat (see exact_dedup) or where the cache holds most rows.

Edge cases: null text counts as empty, 0 tokens; repeated rows and rows without a doc_id get the count of their text; an empty
table gives an empty result and leaves the cache as it is; two runs that append the same digest leave two equal rows, read as one; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import cut, in_arrow, scratch, texts
from .exact_dedup import HOT, attach, may_repeat, repeat_filter

LIMIT = 4096
CACHE = "digest string, tokenizer string, n_tokens long"
_models: dict = {}


def version(path: str) -> str:
    """Digest of the tokenizer: its file and the library that reads it."""
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(lib.encode() + f.read()).hexdigest()


def counter(path: str):
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda items: [len(x) for x in model.encode(items, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _models[path] = lambda items: [len(t.encode(x, add_special_tokens=False).ids) for x in items]
    return _models[path]


def counts_of(rows: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Counts of rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            n = count(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["digest"], pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return in_arrow(rows.select("digest", "text"), run, CACHE)


def stored(spark, cache: str, tokenizer: str) -> DataFrame | None:
    try:
        held = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return held.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. cache: path of the cache; without it one that starts empty."""
    spark = docs.sparkSession
    path = path or vocabulary("piece_bpe_32k.model")
    cache = cache or scratch(spark, "token-cache")
    tokenizer = version(path)
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    keys = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "keys")
    held = stored(spark, cache, tokenizer)
    missing = keys if held is None else keys.join(held, "digest", "left_anti")
    blocks, n_cells = repeat_filter(missing, "digest")
    flagged = may_repeat(rows, "digest", blocks, n_cells, "__repeats")
    # Of each digest that may repeat the row of the smallest id, or, where no row has an id, all; then one of them.
    reps = may_repeat(missing, "digest", blocks, n_cells, "__repeats").where("__repeats").groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumnRenamed("digest", "rep_digest")
    again = flagged.where("__repeats").join(reps, F.col("digest").eqNullSafe(F.col("rep_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("digest", "text")
    alone = flagged.where("NOT __repeats").select("digest", "text")
    if held is not None:
        alone = alone.join(missing.select("digest"), "digest", "left_semi")
    todo = alone.unionByName(again.dropDuplicates(["digest"]))
    if missing.limit(1).count():
        counts_of(todo, path, tokenizer).write.mode("append").parquet(cache)
    held = stored(spark, cache, tokenizer)
    if held is None:
        out = keys.withColumn("n_tokens", F.lit(0).cast("long"))
    else:
        sizes = keys.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(HOT)
        out = attach(keys, cut(held.join(F.broadcast(sizes), "digest", "left"), "counts"), "digest", "n", "left").drop("n")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
