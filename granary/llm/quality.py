"""Quality classifier (operator 6): histogram gradient-boosted trees over document statistics.

The statistics are sums over the bytes, words, lines and word triples of the whole text, computed for a batch at once. The
trees are grown in numpy on a bounded sample (PER_CLASS rows of each class, weighted to the classes' true shares) and laid
out as flat arrays, so that a batch walks each tree level by level without a loop over rows.

Edge cases: null text counts as empty, whose statistics are all 0; without labels of both classes the score is the share of
class 1 among the labels, or 0; repeated rows are scored each; an empty table gives an empty result; other columns are
never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, texts
from .labelled import held_out, sample

#: Bound of the training sample: rows of each class.
PER_CLASS = 4000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 48, 120, 4, 0.1, 2.0, 12.0
CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#$%&*@^~", "bang": b"!", "pipe": b"|", "stop": b".?", "comma": b",;:", "slash": b"/\\<>={}[]_", "line": b"\n"}


def distinct_share(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    return np.array([len(s) for s in K.distinct_sets(h, bounds)]) / np.maximum(n, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    size = np.diff(offsets)
    starts, ends, first = K.word_spans(data, offsets)
    words = np.diff(first)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    out = [np.log1p(size), np.log1p(words)]
    for chars in CLASSES.values():
        table = np.zeros(256, dtype=bool)
        table[list(chars)] = True
        out.append(np.diff(np.searchsorted(np.flatnonzero(table[data]), offsets)) * per_byte)
    length = ends - starts
    total = np.concatenate([[0], np.cumsum(length)])
    squares = np.concatenate([[0], np.cumsum(length * length)])
    mean = (total[first[1:]] - total[first[:-1]]) * per_word
    out += [mean, np.sqrt(np.maximum((squares[first[1:]] - squares[first[:-1]]) * per_word - mean * mean, 0))]
    if len(starts):
        tail, head = data[ends - 1], data[starts]
        odd = np.isin(tail, list(b"#$%&*!|~^@"))
        capital = (head >= 65) & (head < 91)
    else:
        odd = capital = np.zeros(0, dtype=bool)
    for mark in (odd, capital, length <= 2, length > 14):
        c = np.concatenate([[0], np.cumsum(mark)])
        out.append((c[first[1:]] - c[first[:-1]]) * per_word)
    h = K.span_hashes(K.LOWER[data], starts, ends)
    out.append(distinct_share(h, first))
    triples, bounds = K.shingle_hashes(h, first, 3)
    out.append(distinct_share(triples, bounds))
    same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    c = np.concatenate([[0], np.cumsum(same)])
    out.append((c[first[1:]] - c[first[:-1]]) * per_word)
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets[:-1]] = True
    breaks[1:][data == 10] = True
    line = np.flatnonzero(breaks[:-1]) if len(data) else np.zeros(0, np.int64)
    line_end = np.concatenate([line[1:], [len(data)]]) if len(line) else line
    line_first = np.searchsorted(line, offsets)
    out.append(distinct_share(K.span_hashes(data, line, line_end), line_first))
    out.append(np.diff(line_first) * per_word)
    return np.stack([np.asarray(c, dtype=np.float64) for c in out], axis=1)


@dataclass
class Forest:
    """Trees as flat arrays: node i tests x[feature[i]] <= limit[i] and goes to left[i] or left[i] + 1; leaves go to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                leaf = self.left[node] < 0
                node = np.where(leaf, node, self.left[node] + (x[rows, self.feature[node]] > self.limit[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Second-order boosting of the weighted logistic loss on binned statistics."""
    weight = weight / weight.mean()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    n_features = x.shape[1]
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    roots, feature, limit, left, value = [], [], [], [], []

    def leaf(g: float, h: float) -> int:
        for column, v in ((feature, 0), (limit, 0.0), (left, -1), (value, -RATE * g / (h + RIDGE))):
            column.append(v)
        return len(left) - 1

    for _ in range(TREES):
        q = 1 / (1 + np.exp(-total))
        g, h = weight * (q - y), weight * q * (1 - q)
        root = leaf(g.sum(), h.sum())
        roots.append(root)
        at = np.full(len(y), root)
        open_nodes = [root]
        for _ in range(DEPTH):
            if not open_nodes:
                break
            number = np.full(len(left), -1)
            number[open_nodes] = np.arange(len(open_nodes))
            rows = np.flatnonzero(number[at] >= 0)
            code = (number[at[rows]][:, None] * n_features + np.arange(n_features)) * BINS + binned[rows]
            cells = len(open_nodes) * n_features * BINS
            sums = [np.bincount(code.ravel(), weights=np.repeat(v[rows], n_features), minlength=cells).reshape(-1, n_features, BINS) for v in (g, h)]
            gl, hl = sums[0].cumsum(axis=2), sums[1].cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
            fresh = []
            for k, node in enumerate(open_nodes):
                j, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, j, b] <= 1e-3 or b >= len(edges[j]):
                    continue
                feature[node], limit[node] = int(j), float(edges[j][b])
                a = leaf(gl[k, j, b], hl[k, j, b])
                leaf(gt[k, j, 0] - gl[k, j, b], ht[k, j, 0] - hl[k, j, b])
                left[node] = a
                mine = at == node
                at[mine] = a + (binned[mine, j] > b)
                fresh += [a, a + 1]
            open_nodes = fresh
        total += np.array(value)[at]
    return Forest(base, np.array(roots), np.array(feature), np.array(limit), np.array(left), np.array(value))


def fit(items: list[str], labels: list[int], weights: list[float]) -> Forest:
    y, w = np.array(labels, dtype=np.float64), np.array(weights, dtype=np.float64)
    if len(y) and y.min() != y.max():
        return grow(np.concatenate([statistics(*K.flat(pa.array(items[i : i + 500], pa.string()))) for i in range(0, len(items), 500)]), y, w)
    base = 12.0 if len(y) and y[0] else -12.0
    return Forest(base, *(np.zeros(0, int) for _ in range(5)))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    forest = fit(*sample(docs, labels, "quality", per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.scores(statistics(*K.flat(b["text"])))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    out = in_arrow(texts(docs), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
