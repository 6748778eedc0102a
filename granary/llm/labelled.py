"""Bounded labelled samples to fit classifiers on, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

FOLDS = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no classifier learns from: crc32 of the id as text is divisible by FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and class weights of at most per_class rows of each class, those of the smallest hashes of their ids, none of the
    held-out fold. The ids are at most 2 * per_class, so they are broadcast. A row without a label or a text is left out; an id with
    several labels counts with the smallest. A weight is how many labelled rows of its class a sampled row stands for."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = texts(docs).where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    totals = dict(known.groupBy("label").agg(F.count("*")).collect())
    found = rows.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    label_of = found["label"].to_pylist()
    drawn = {v: max(1, label_of.count(v)) for v in (0, 1)}
    return found["text"].to_pylist(), label_of, [totals[v] / drawn[v] for v in label_of]
