"""Toxicity classifier (operator 9): a bidirectional gated recurrent network with attention pooling.

Each word of a text comes in as a word vector (words of the training sample, by hash) and as the sum of the vectors of its
3- and 5-byte character grams, so unseen forms count too. Windows of WINDOW words, each overlapping the next by
WINDOW - STRIDE, cover the whole text; every window is scored, and the document's score is a logistic function of its best
windows. Trained in numpy on the driver, on a bounded sample (PER_CLASS rows of each class) by multiple-instance learning: a
toxic document's likeliest windows are its positives, and are picked again between rounds.

Edge cases: null and empty texts and texts without letters get the score of no window; shorter texts give one padded window;
without labels of both classes every score is 0; repeated rows are scored each; an empty table gives an empty result; other
columns (labels, lang, source, doc_id) are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, sliced, texts
from .labelled import held_out, sample

#: Bound of the training sample: rows of each class.
PER_CLASS = 1500
WINDOW, STRIDE = 20, 14
WORD_DIM = CHAR_DIM = HIDDEN = 8
GRAMS, LEAST_COUNT = 1 << 14, 3
THRESHOLD = 0.5


@dataclass
class Words:
    """Distinct words of a batch: hash, character grams (flat, with bounds); the word at each place; bounds of each text."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_bounds: np.ndarray
    at: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low, starts, ends, first = K.letter_words(data, offsets)
    hashes, index, at = np.unique(K.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[index], ends[index]
    n = e - s
    bounds = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - s, n)
    left = np.repeat(e, n) - pos
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))
    grams = [(K.mix((eight[pos] & K.MASKS[np.minimum(left, k)]) * K.GOLD + np.uint64(k)) % np.uint64(GRAMS // 2)).astype(np.int32) + (GRAMS // 2) * (k == 5) for k in (3, 5)]
    return Words(hashes, np.stack(grams, 1).ravel(), 2 * bounds, at.ravel(), first)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every window, and the bounds of each text's windows."""
    n = np.diff(first)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    text = np.repeat(np.arange(len(n)), count)
    start = first[text] + np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return start, np.minimum(n[text], WINDOW), bounds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    top: np.ndarray = field(default_factory=lambda: np.zeros(5))

    @staticmethod
    def fresh(vocabulary: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray) -> Network:
        r = np.random.default_rng(11)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": f(len(vocabulary) + 1, WORD_DIM, scale=0.05), "gram": f(GRAMS, CHAR_DIM, scale=0.05), "va": f(h, scale=0.3), "wa": f(2 * h, h, scale=0.3), "u": f(2 * h, scale=0.3), "b": np.zeros(1, np.float32)}
        p["word"][:-1, 0] = word_odds
        p["word"][-1] = 0
        p["gram"][:, 0] = gram_odds
        for side in "fb":
            p |= {f"w{side}": f(d, 3 * h, scale=0.35), f"c{side}": np.zeros(3 * h, np.float32), f"u{side}": f(h, 3 * h, scale=0.3)}
        return Network(vocabulary, p)

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of the distinct words and, last, of the padding; their rows in the word table; grams of each."""
        slot = np.searchsorted(self.vocabulary, w.hashes)
        known = slot < len(self.vocabulary)
        known[known] = self.vocabulary[slot[known]] == w.hashes[known]
        slot = np.where(known, slot, len(self.vocabulary))
        n = np.diff(w.gram_bounds)
        sums = np.zeros((len(n), CHAR_DIM), np.float32)
        for i in range(0, len(n), 8192):  # the vectors of all grams at once would take far more memory than their sums
            b = w.gram_bounds[i : i + 8193]
            sums[i : i + 8192] = np.add.reduceat(self.p["gram"][w.grams[b[0] : b[-1]]], b[:-1] - b[0], axis=0)
        x = np.concatenate([self.p["word"][slot], np.tanh(sums / np.maximum(n, 1)[:, None].astype(np.float32) * 4)], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), slot, sums

    def run(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; at: the inputs of each place (windows x WINDOW), -1 for padding."""
        p, h_n = self.p, HIDDEN
        out = np.empty((WINDOW, len(at), 2 * h_n), np.float32)
        steps = []
        for k, side in enumerate("fb"):
            px = (x @ p[f"w{side}"] + p[f"c{side}"]).astype(np.float32)
            h = np.zeros((len(at), h_n), np.float32)
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                a = px[at[:, t]]
                g = h @ p[f"u{side}"]
                zr = sigmoid(a[:, : 2 * h_n] + g[:, : 2 * h_n])
                z, r = zr[:, :h_n], zr[:, h_n:]
                n = np.tanh(a[:, 2 * h_n :] + r * g[:, 2 * h_n :])
                before = h
                h = n + z * (h - n)
                out[t, :, k * h_n : (k + 1) * h_n] = h
                if keep:
                    steps.append((side, t, z, r, n, before, g[:, 2 * h_n :]))
        e = np.tanh(out @ p["wa"])
        score = e @ p["va"]
        score[np.arange(WINDOW)[:, None] >= length[None, :]] = -1e9
        score = np.exp(score - score.max(axis=0))
        score /= score.sum(axis=0)
        pooled = (score[:, :, None] * out).sum(axis=0)
        logit = pooled @ p["u"] + p["b"][0]
        return (logit, out, e, score, pooled, steps) if keep else logit

    def places(self, w: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        grid = start[:, None] + np.arange(WINDOW)[None, :]
        at = np.full(grid.shape, len(w.hashes), np.int64)
        inside = np.arange(WINDOW)[None, :] < length[:, None]
        at[inside] = w.at[grid[inside]]
        return at

    def logits(self, w: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        x = self.inputs(w)[0]
        return np.concatenate([np.zeros(0, np.float32), *(self.run(x, self.places(w, start[i : i + 2048], length[i : i + 2048]), length[i : i + 2048]) for i in range(0, len(start), 2048))])

    def gradients(self, w: Words, start: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss by back-propagation through both directions."""
        p, h_n = self.p, HIDDEN
        x, slot, sums = self.inputs(w)
        at = self.places(w, start, length)
        logit, out, e, score, pooled, steps = self.run(x, at, length, keep=True)
        d = (weight * (sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["b"][0], g["u"] = d.sum(), pooled.T @ d
        d_pool = d[:, None] * p["u"]
        d_out = score[:, :, None] * d_pool
        d_score = (out * d_pool).sum(axis=2)
        d_score = score * (d_score - (score * d_score).sum(axis=0))
        g["va"] = np.einsum("tb,tbh->h", d_score, e)
        d_e = d_score[:, :, None] * p["va"] * (1 - e * e)
        g["wa"] = np.einsum("tbi,tbj->ij", out, d_e)
        d_out = d_out + d_e @ p["wa"].T
        d_x = np.zeros_like(x)
        d_h = {s: np.zeros((len(y), h_n), np.float32) for s in "fb"}
        for side, t, z, r, n, before, gn in reversed(steps):
            k = "fb".index(side)
            dh = d_h[side] + d_out[t, :, k * h_n : (k + 1) * h_n]
            dz = dh * (before - n) * z * (1 - z)
            dn = dh * (1 - z) * (1 - n * n)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            d_h[side] = dh * z + dg @ p[f"u{side}"].T
            g[f"u{side}"] += before.T @ dg
            xt = x[at[:, t]]
            g[f"w{side}"] += xt.T @ da
            g[f"c{side}"] += da.sum(axis=0)
            np.add.at(d_x, at[:, t], da @ p[f"w{side}"].T)
        d_x = d_x[:-1]
        g["word"] = (slot, d_x[:, :WORD_DIM])
        n = np.diff(w.gram_bounds)
        scale = 4 / np.maximum(n, 1)[:, None]
        d_sum = d_x[:, WORD_DIM:] * (1 - np.tanh(sums * scale) ** 2) * scale
        g["gram"] = (w.grams, np.repeat(d_sum, n, axis=0))
        return g

    def step(self, g: dict, state: dict, rate: float) -> None:
        """Adam for the weights, Adagrad for the rows of the tables that a batch touches."""
        state["n"] = state.get("n", 0) + 1
        for k, v in g.items():
            if isinstance(v, tuple):
                rows, at = np.unique(v[0], return_inverse=True)
                total = np.zeros((len(rows), v[1].shape[1]), np.float32)
                np.add.at(total, at.ravel(), v[1].astype(np.float32))
                held = state.setdefault(k, np.full_like(self.p[k], 1e-6))
                held[rows] += total * total
                self.p[k][rows] -= 5 * rate * total / np.sqrt(held[rows])
            else:
                m, s = state.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                self.p[k] -= rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(s / (1 - 0.99 ** state["n"])) + 1e-6)
        self.p["word"][-1] = 0

    def document_features(self, logits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each text: whether it has windows, the largest and the second largest probability, their log odds, a count."""
        n = np.diff(bounds)
        best, second, mass = np.full(len(n), -8.0), np.full(len(n), -8.0), np.zeros(len(n))
        some = np.flatnonzero(n > 0)
        if len(some):
            at = bounds[:-1][some]
            best[some] = np.maximum.reduceat(logits, at)
            text = np.repeat(np.arange(len(n)), n)
            rest = logits.copy()
            is_best = np.flatnonzero(rest == best[text])
            rest[is_best[np.unique(text[is_best], return_index=True)[1]]] = -8.0
            second[some] = np.maximum.reduceat(rest, at)
            mass[some] = np.add.reduceat(sigmoid(logits), at)
        return np.stack([np.ones(len(n)), np.clip(best, -8, 8), np.clip(second, -8, 8), np.log1p(mass), np.log1p(n)], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = words_of(data, offsets)
        start, length, bounds = windows(w.first)
        return sigmoid(self.document_features(self.logits(w, start, length), bounds) @ self.top)


def presence(w: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of how many texts of class 0 and 1 each word and each gram is a part (2 x words, 2 x grams); some texts at a time."""
    words, grams = np.zeros((2, len(w.hashes))), np.zeros((2, GRAMS))
    counts = np.diff(w.gram_bounds)
    for i in range(len(y)):
        mine = np.unique(w.at[w.first[i] : w.first[i + 1]])
        if len(mine):
            words[int(y[i]), mine] += 1
            n = counts[mine]
            source = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - w.gram_bounds[mine], n)
            grams[int(y[i]), np.unique(w.grams[source])] += 1
    return words, grams


def odds(seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of being in a text of class 1; 0 for what is in fewer than LEAST_COUNT texts."""
    zero, one = seen
    value = np.log((one + 0.5) / (y.sum() + 1)) - np.log((zero + 0.5) / (len(y) - y.sum() + 1))
    return np.where(one + zero >= LEAST_COUNT, np.clip(value / 2, -2, 2), 0).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge."""
    weight = weight / weight.mean()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (weight * (q - y)) + ridge * w)
    return w


def fit(items: list[str], labels: list[int], weights: list[float], rounds: int = 3, epochs: int = 2, batch: int = 256) -> Network | None:
    y = np.array(labels, dtype=np.float64)
    if len(y) < 2 or y.min() == y.max():
        return None
    w = words_of(*K.flat(pa.array(items, pa.string())))
    words, grams = presence(w, y)
    word_odds, counts = odds(words, y), np.diff(w.gram_bounds)
    frequent = words.sum(axis=0) >= LEAST_COUNT
    net = Network.fresh(w.hashes[frequent], word_odds[frequent], odds(grams, y))
    start, length, bounds = windows(w.first)
    text = np.repeat(np.arange(len(y)), np.diff(bounds))
    total = np.concatenate([[0], np.cumsum(np.maximum(word_odds[w.at], 0) ** 2)])
    guess = total[start + length] - total[start]
    r = np.random.default_rng(5)
    state: dict = {}
    for turn in range(rounds):
        order = np.lexsort((r.random(len(guess)), -guess, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(bounds[:-1], np.diff(bounds))
        extra = r.random(len(guess)) < 3 / np.maximum(np.diff(bounds)[text], 1)
        chosen = np.flatnonzero((rank == 0) | (y[text] == 0) & ((rank == 1) | extra))
        weight = np.where(y[text] == 1, 0.5 / max((y[text[chosen]] == 1).mean(), 1e-3), 0.5 / max((y[text[chosen]] == 0).mean(), 1e-3))
        for _ in range(epochs):
            mixed = r.permutation(chosen)
            for i in range(0, len(mixed), batch):
                b = mixed[i : i + batch]
                places = (start[b][:, None] + np.arange(WINDOW)).clip(max=len(w.at) - 1)
                used, inverse = np.unique(w.at[places], return_inverse=True)
                n = counts[used]
                part_bounds = np.concatenate([[0], np.cumsum(n)])
                source = np.arange(part_bounds[-1]) - np.repeat(part_bounds[:-1] - w.gram_bounds[used], n)
                part = Words(w.hashes[used], w.grams[source], part_bounds, inverse.ravel(), np.zeros(1, np.int64))
                net.step(net.gradients(part, np.arange(len(b)) * WINDOW, length[b], y[text[b]], weight[b]), state, 0.01 / (1 + turn))
        guess = net.logits(w, start, length)
    net.top = logistic(net.document_features(guess, bounds), y, np.array(weights))
    return net


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = net.scores(*K.flat(b["text"])) if net is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    return in_arrow(texts(docs), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    net = fit(*sample(docs, labels, "toxic", per_class))
    return scored(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    net = fit(*sample(docs, labels, "toxic", per_class))
    if net is None:
        return docs

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        rows = pa.RecordBatch.from_arrays([pa.array(column, pa.string(), from_pandas=True)], ["text"])
        return pd.Series(np.concatenate([np.zeros(0), *(net.scores(*K.flat(b["text"])) for b in sliced([rows]))]))

    return docs.where(score(F.col("text").cast("string")) < THRESHOLD)
