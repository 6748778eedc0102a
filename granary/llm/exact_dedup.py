"""Exact dedup in two Bloom-filtered passes (operator 4), with DataFrame functions only.

First pass: every row sets two cells of a filter; a cell that two rows set is marked. Second pass: a row with an unmarked
cell has no equal, and passes straight through; only rows with both cells marked are shuffled and grouped by digest. The
filter grows with the rows, CELLS_A_ROW bits for each, and is broadcast as rows of WORDS 64-bit words; so its bound is in bytes:
MAX_BYTES, or an eighth of what the session lets the driver collect (spark.driver.maxResultSize), whichever is less. Of rows
that have no equal, (1 - exp(-x) * (1 + x)) ** 2 with x = 2 * rows / cells are shuffled all the same: 0.00005 up to the bound (67
million rows at 128 MB), 0.07 at eight times and 0.35 at sixteen times as many; so a corpus of more rows wants larger settings, and with any
of them the result is the same. A key of very many rows is never joined in one task: the HOT largest groups are joined by broadcast.

Edge cases: null text counts as empty, and all empty texts are equal; rows that repeat both doc_id and text all have that
doc_id as keep_id and all count in group_size, and deduplicated() keeps one of them; an empty table gives an empty
result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, texts

SPACES = r"[\x20\x09-\x0D]+"
CELLS_A_ROW, MAX_BYTES = 16, 1 << 27
#: 64-bit words in a row of the filter's table.
WORDS = 64
#: Groups that are joined by broadcast: any other holds less than one in HOT of the rows.
HOT = 512


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def cells(key: str, n_cells: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n_cells)) for seed in (1, 2)]


def most_cells(spark: SparkSession) -> int:
    """Cells of the largest filter that is broadcast, a power of two."""
    value = spark.conf.get("spark.driver.maxResultSize", None) or spark.sparkContext.getConf().get("spark.driver.maxResultSize", "1g")
    result = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value))
    return 1 << (8 * min(MAX_BYTES, result // 8 if result > 0 else MAX_BYTES)).bit_length() - 1


def repeat_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The cells that more than one row sets, as rows (block, bits: WORDS words), and the number of cells."""
    n_cells = 1 << 16
    most = CELLS_A_ROW * keys.count()
    while n_cells < min(most, most_cells(keys.sparkSession)):
        n_cells *= 2
    hits = keys.select(F.explode(F.array(*cells(key, n_cells))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    words = hits.groupBy(F.expr("cell DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 64 AS INT)))").alias("bits"))
    slot = [F.expr(f"bit_or(IF(word % {WORDS} = {i}, bits, 0L))") for i in range(WORDS)]
    return cut(words.groupBy(F.expr(f"word DIV {WORDS}").alias("block")).agg(F.array(*slot).alias("bits")), "bloom"), n_cells


def may_repeat(rows: DataFrame, key: str, blocks: DataFrame, n_cells: int, flag: str) -> DataFrame:
    """rows with a boolean column flag: false where the key surely stands alone. The filter's bytes are bounded by most_cells()."""
    out = rows
    for i, cell in enumerate(cells(key, n_cells)):
        side = F.broadcast(blocks.select(F.col("block").alias(f"__block{i}"), F.col("bits").alias(f"__bits{i}")))
        out = out.withColumn(f"__cell{i}", cell).join(side, F.expr(f"__cell{i} DIV {64 * WORDS} = __block{i}"), "left")
    hit = lambda i: F.expr(f"coalesce(shiftright(__bits{i}[CAST(__cell{i} DIV 64 % {WORDS} AS INT)], CAST(__cell{i} % 64 AS INT)) & 1L, 0L) = 1L")
    return out.withColumn(flag, hit(0) & hit(1)).drop(*(f"__{c}{i}" for c in ("cell", "block", "bits") for i in (0, 1)))


def attach(rows: DataFrame, values: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """rows joined with values, which has one row for each key and, as size, about how many rows have that key. The HOT keys of
    the most rows come by broadcast (HOT rows at most), so no task gets all rows of a frequent key; the others by a plain join."""
    hot = values.orderBy(F.desc(size), key).limit(HOT).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    return marked.where("__hot").drop("__hot").unionByName(marked.where("__hot IS NULL").select(*rows.columns).join(values, key, how))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    hashed = cut(texts(docs).select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "digests")
    flagged = may_repeat(hashed, "text_sha256", *repeat_filter(hashed, "text_sha256"), "repeats")
    alone = flagged.where("NOT repeats").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    rest = flagged.where("repeats").select("doc_id", "text_sha256")
    found = cut(rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = alone.unionByName(attach(rest, found, "text_sha256", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that equal a row of a smaller doc_id. Whole rows are shuffled
    only where their digest may repeat."""
    with_key = docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    keys = cut(with_key.select("doc_id", "__sha"), "digests")
    blocks, n_cells = repeat_filter(keys, "__sha")
    rows = may_repeat(with_key, "__sha", blocks, n_cells, "__repeats")
    keep = may_repeat(keys, "__sha", blocks, n_cells, "__repeats").where("__repeats").groupBy("__sha").agg(F.min("doc_id").alias("doc_id"))
    rest = rows.where("__repeats").join(keep.select(F.col("__sha").alias("__s"), F.col("doc_id").alias("__d")), (F.col("__sha") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    return rows.where("NOT __repeats").select(*docs.columns).unionByName(rest.dropDuplicates(["__sha", "doc_id"]).select(*docs.columns))


ORACLE = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
