"""Held-out figures of the classifiers: python -m granary.llm.figures TABLES... prints them for each folder of tables."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import toxicity
from .common import read, texts
from .labelled import sample
from .queries import op6_quality, op9_toxicity


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a row of class 1 scores higher than one of class 0; ties count half."""
    order = np.sort(score[y == 0])
    below = np.searchsorted(order, score[y == 1], side="left") + np.searchsorted(order, score[y == 1], side="right")
    return float(below.mean() / 2 / max(len(order), 1)) if (y == 1).any() else float("nan")


def summary(score: np.ndarray, predicted: np.ndarray, y: np.ndarray) -> dict[str, float]:
    hit = ((predicted == 1) & (y == 1)).sum()
    return {"rows": len(y), "ones": int(y.sum()), "auc": auc(score, y), "accuracy": float((predicted == y).mean()), "precision": float(hit / max((predicted == 1).sum(), 1)), "recall": float(hit / max((y == 1).sum(), 1))}


def largest_odds(docs: DataFrame, labels: DataFrame, rows: list[str]) -> np.ndarray:
    """What the network starts from: of each text the largest log odds of a word, without recurrence, attention or grams."""
    items, label, _ = sample(docs, labels, "toxic", toxicity.PER_CLASS)
    y = np.array(label, dtype=np.float64)
    w = toxicity.words_of(*K.flat(pa.array(items, pa.string())))
    known = dict(zip(w.hashes.tolist(), toxicity.odds(toxicity.presence(w, y)[0], y).tolist(), strict=True))
    t = toxicity.words_of(*K.flat(pa.array(rows, pa.string())))
    value = np.array([known.get(h, 0.0) for h in t.hashes.tolist()])
    return np.array([value[t.at[a:b]].max() if b > a else -9 for a, b in zip(t.first, t.first[1:], strict=False)])


def figures(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, float]]:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = {}
    for name, query, label in (("op6_quality", op6_quality, "quality"), ("op9_toxicity", op9_toxicity, "toxic")):
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
        held = query(spark, sf_dir).where("held_out").join(known, "doc_id").join(texts(docs), "doc_id").toPandas()
        y = held["y"].to_numpy()
        out[name] = summary(held["score"].to_numpy(), held["predicted"].to_numpy(), y)
        if label == "toxic":
            out[name]["auc_of_largest_word_odds"] = auc(largest_odds(docs, labels, held["text"].tolist()), y)
    return out


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    for folder in sys.argv[1:]:
        print(folder, {k: {m: round(x, 4) for m, x in v.items()} for k, v in figures(session, folder).items()})
