"""External models as pluggable functions on batches, with offline stand-ins that give the same result for the same input (O-09, O-112, O-164,
O-166, O-171, O-174, O-175)."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMENSION, BATCH = 64, 64
Provider = Callable[[list[str]], list]


class QuotaError(Exception):
    """The provider's quota is used up: no use in trying again."""


def hashed_embedding(texts: list[str]) -> list[list[float]]:
    """Unit vectors of hashed words: a stand-in of an embedding model."""
    out = []
    for t in texts:
        v = np.zeros(DIMENSION)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % DIMENSION] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def first_sentence(texts: list[str]) -> list[str]:
    """A stand-in of a chat model: the first sentence of its input."""
    return [t.split(". ")[0][:400] for t in texts]


def overlap_score(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in of a reranker: share of the query's words in the text."""
    out = []
    for q, t in pairs:
        words = set(q.lower().split())
        out.append(len(words & set(t.lower().split())) / len(words) if words else 0.0)
    return out


def with_retries(call: Provider, tries: int = 5, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """call with exponential waits between tries, at most so long each; a used-up quota ends at once."""

    def run(items: list[str]) -> list:
        for k in range(tries):
            try:
                return call(items)
            except QuotaError:
                raise
            except Exception as e:
                if k == tries - 1:
                    raise
                wait = getattr(e, "retry_after", None)
                sleep(min(wait if wait is not None else base * 2**k + random.random() * 0.1, most))
        return []

    return run


def embedded(chunks: DataFrame, provider: Provider = hashed_embedding) -> DataFrame:
    """id, vector of chunks (id, text): batches keep their order and are checked for length; empty texts have no vector (O-171)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            df = df[df["text"].fillna("").str.strip() != ""]
            for i in range(0, len(df), BATCH):
                b = df.iloc[i : i + BATCH]
                v = provider(b["text"].tolist())
                if len(v) != len(b):
                    raise ValueError("the provider left out vectors")
                yield pd.DataFrame({"id": b["id"].tolist(), "vector": v})

    return chunks.select("id", "text").mapInPandas(run, "id long, vector array<double>")


def reranked(rows: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]] = overlap_score) -> DataFrame:
    """Rows (query_id, doc_id, query, text) with rerank_score (O-112)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield df[["query_id", "doc_id"]].assign(rerank_score=scorer(list(zip(df["query"].fillna(""), df["text"].fillna(""), strict=True))))

    return rows.select("query_id", "doc_id", "query", "text").mapInPandas(run, "query_id long, doc_id long, rerank_score double")


def completed(rows: DataFrame, provider: Provider = first_sentence) -> DataFrame:
    """id, answer of prompts (id, prompt): one text field whatever the endpoint (O-174, O-175)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield pd.DataFrame({"id": df["id"].tolist(), "answer": with_retries(provider)(df["prompt"].fillna("").tolist())})

    return rows.select("id", "prompt").mapInPandas(run, "id long, answer string")
