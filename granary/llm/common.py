"""Helpers that the operators of this subpackage share: tables, shared storage, lineage cuts, streaming of small groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of what kernels are given at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: Name of this driver's part of the shared folder.
RUN = uuid.uuid4().hex


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, one of this machine's, which only a
    local session may use, as in tests; on a cluster it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.granary.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.granary.shared.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under this driver's own part of it."""
    return f"{shared_dir(spark)}/granary-{RUN}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Deletes what this driver has written to the shared folder. Results that read from there are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/granary-{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: ends the lineage; a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about BATCH_ROWS rows and BATCH_BYTES bytes at most (one row at least). Spark bounds the bytes of the
    batches that it sends; the slices bound what kernels hold for each of them, whatever the session's settings."""
    for b in batches:
        step = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: f(sliced(batches)), schema)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Id and text as long and string, whatever else and whatever types the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys. Each table holds several groups; a group is never parted. Only
    for groups of bounded size."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        if t.num_rows < BATCH_ROWS:
            continue
        last = [t[k][t.num_rows - 1].as_py() for k in keys]
        n = t.num_rows
        cols = [t[k] for k in keys]
        while n and all(c[n - 1].as_py() == v for c, v in zip(cols, last, strict=True)):
            n -= 1
        if n:
            yield t.slice(0, n)
            held = t.slice(n).combine_chunks().to_batches()
        else:
            held = t.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)
