"""Benchmark decontamination by latent semantic retrieval (operator 10).

Passages of PASSAGE words of all documents are TF-IDF vectors over FEATURES hashed words. One distributed pass counts
the words' passages; a second sums A'(A Omega) for a random Omega over all passages, from which the driver has the leading
singular space (Nystrom form of the randomised SVD; its matrices are FEATURES x WIDTH whatever the corpus). A third pass
projects windows of every length class of the benchmark, at a stride of a third of their length, over whole texts, and takes
those whose cosine with an item is at least COSINE as candidates; words that no item has count as nothing in a window, and an
item or a window whose words all are without a weight has no cosine and is a candidate with all. A candidate stands if the longest common
subsequence of words has CERTAIN of the item's words, or LIKELY of them with ANSWER of its answer's (its last sentence), which holds for
paraphrases; regions that hold fewer than LIKELY of the item's words in any order are passed over before, which loses none.

Items of any length are found: the length classes go on to the longest item, and what an item needs is a share of its own words in
a region of its own length. The subsequence is computed bit-parallel for all candidates of a length class at once, and one by one for items of more than
64 * LIMBS words. Recall by kind and share of edits and by length is measured in tests/llm/test_leak_recall.py.

Edge cases: null and empty texts match nothing; items without words are left out; items of the same id are matched each;
repeated rows are matched each; an empty table of documents or of items gives an empty result; other columns are not read.
The benchmark is searched in blocks of BLOCK items, so that what tasks hold of it is bounded; very long texts are searched in
overlapping spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, in_arrow, sliced, texts

FEATURES, WIDTH, RANK, PASSAGE = 1 << 15, 40, 36, 48
#: Features in more passages than this share of all and RARE more have no weight.
COMMON, RARE = 0.04, 25
COSINE, CERTAIN, LIKELY, ANSWER = 0.4, 0.7, 0.5, 0.6
BLOCK, CHUNK_WORDS = 512, 40_000
#: Words of the items that are compared together, 64-bit limbs of an item that is compared so, and regions at once.
GROUP_WORDS, LIMBS, REGIONS = 16_000, 8, 1 << 16
EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)
LENGTHS = [8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450, 675, 1000]


@dataclass
class Tokens:
    """Word hashes of a batch and the first word of each text."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def features(self) -> np.ndarray:
        return (self.hashes & np.uint64(FEATURES - 1)).astype(np.int32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low, starts, ends, first = K.letter_words(data, offsets)
    return Tokens(K.span_hashes(low, starts, ends), first)


def passages(first: np.ndarray) -> np.ndarray:
    """The passage of each word, numbered over the batch."""
    n = np.diff(first)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], n)
    before = np.concatenate([[0], np.cumsum(-(-n // PASSAGE))])[:-1]
    return np.repeat(before, n) + inside // PASSAGE


def accumulated(docs: DataFrame, f, width: int) -> np.ndarray:
    """Sum over all batches of f(tokens, total), which adds to a FEATURES x width array. Each task streams its rows and gives
    one array in blocks of features, as many bytes for each input split and so a small, fixed share of the input; the blocks are
    summed in two levels, first in parts of the tasks and then together, so that no task reads what all others give."""
    per_block = 1024
    kind = np.float32 if width > 2 else np.float64
    schema = "block int, part int, sums binary"
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)

    def rows(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["block", "part", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, width), np.float64)
        for b in batches:
            f(tokens(*K.flat(b["text"])), total)
        part = TaskContext.get().partitionId() % parts
        yield rows({(k, part): x for k, x in enumerate(total.reshape(FEATURES // per_block, -1).astype(kind)) if x.any()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, p, v in zip(b["block"].to_pylist(), b["part"].to_pylist(), b["sums"].to_pylist(), strict=True):
                x = np.frombuffer(v, kind).astype(np.float64)
                if (k, p) in held:
                    held[k, p] += x
                else:
                    held[k, p] = x
        yield rows({k: x.astype(kind) for k, x in held.items()})

    found = in_arrow(in_arrow(docs.select("text"), partial, schema).repartition("block", "part"), summed, schema)
    found = in_arrow(found.withColumn("part", F.lit(0)).repartition("block"), summed, schema)
    out = np.zeros((FEATURES // per_block, per_block * width))
    for r in found.collect():
        out[r["block"]] = np.frombuffer(r["sums"], kind)
    return out.reshape(FEATURES, width)


def weights(docs: DataFrame) -> np.ndarray:
    """Inverse passage frequencies of the features; common ones are 0."""

    def count(t: Tokens, total: np.ndarray) -> None:
        if len(t.hashes):
            p = passages(t.first)
            pairs = np.sort(p.astype(np.int64) * FEATURES + t.features)
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            total[:, 0] += np.bincount(pairs & (FEATURES - 1), minlength=FEATURES)
            total[0, 1] += p[-1] + 1

    got = accumulated(docs, count, 2)
    df, n = got[:, 0], max(got[0, 1], 1)
    idf = np.log((n + 1) / (df + 1))
    return np.where(df > COMMON * n + RARE, 0, idf).astype(np.float32)


def singular_space(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Rows: the features' coordinates in the whitened leading right singular space of the passages' TF-IDF matrix."""
    omega = np.random.default_rng(17).standard_normal((FEATURES, WIDTH)).astype(np.float32)
    weighted = omega * idf[:, None]

    def add(t: Tokens, total: np.ndarray) -> None:
        f, p = t.features, passages(t.first)
        keep = idf[f] > 0
        f, p = f[keep], p[keep]
        for i in range(0, len(f), CHUNK_WORDS):  # a passage parted here counts as two
            fi, pi = f[i : i + CHUNK_WORDS], p[i : i + CHUNK_WORDS]
            new = np.concatenate([[True], pi[1:] != pi[:-1]])
            head, row = np.flatnonzero(new), np.cumsum(new) - 1
            z = np.add.reduceat(weighted[fi], head, axis=0) / np.add.reduceat(idf[fi] ** 2, head)[:, None]
            order = np.argsort(fi.astype(np.uint16), kind="stable")
            fs = fi[order]
            runs = np.flatnonzero(np.concatenate([[True], fs[1:] != fs[:-1]]))
            total[fs[runs]] += np.add.reduceat(z[row[order]], runs, axis=0) * idf[fs[runs]][:, None]

    y = accumulated(docs, add, WIDTH)
    shift = 1e-6 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T.astype(np.float64) @ y
    core = (core + core.T) / 2
    e, v = np.linalg.eigh(core)
    e = np.maximum(e, 1e-9 * max(e.max(), 1e-12))
    u, s, _ = np.linalg.svd(y @ (v / np.sqrt(e)), full_matrices=False)
    # A corpus of few or equal passages has fewer directions; what is left of the others is the shift, which must not be scaled up.
    kept = s[:RANK] ** 2 > 2 * shift
    return np.where(kept, u[:, :RANK] / np.where(kept, s[:RANK], 1), 0).astype(np.float32)


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


def items_of(rows: list[tuple[int, str]]) -> list[Item]:
    out = []
    for item_id, text in rows:
        words = tokens(*K.flat(pa.array([text], pa.string()))).hashes.tolist()
        parts = [tokens(*K.flat(pa.array([s], pa.string()))).hashes.tolist() for s in re.split(r"[.!?\n]+", text or "")]
        parts = [p for p in parts if len(p) >= 3]
        if words:
            out.append(Item(item_id, words, parts[-1] if parts else words))
    return out


def margin(item: Item) -> int:
    """Words before and after a window that are read with it."""
    return max(4, len(item.words) // 2)


def places(a: list[int]) -> dict[int, int]:
    """The places of each word as bits of one number."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common_length(a: list[int], b: list[int], where: dict[int, int] | None = None, least: float = 0) -> int:
    """Length of the longest common subsequence; where: places(a). If it is less than least, any number less than least."""
    where = places(a) if where is None else where
    found = [where[w] for w in b if w in where]
    if least:
        some = 0
        for m in set(found):
            some |= m
        if min(len(found), some.bit_count()) < least:
            return 0
    full = (1 << len(a)) - 1
    row = full
    for m in found:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def lengths_up_to(longest: int) -> list[int]:
    """The length classes, carried on by halves until the longest item has its own."""
    out = list(LENGTHS)
    while out[-1] < longest:
        out.append(out[-1] * 3 // 2)
    return out


def spans(first: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of the spans that texts are searched in: whole texts, but for those of more than most + overlap
    words, which are parted at every most words into spans that overlap by so many that any region lies whole in one."""
    n = np.diff(first)
    count = np.where(n > most + overlap, -(-(n - overlap) // most), 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + k * most
    return start, np.where(k == count[text] - 1, first[text + 1], start + most + overlap), text


class Group:
    """Items of one length class. Those of at most 64 * LIMBS words are compared with many regions at once: a word's places in
    an item are bits of its row in `masks`, and the longest common subsequence is counted bit-parallel over all regions."""

    def __init__(self, length: int, members: list[int], items: list[Item], vectors: np.ndarray, blank: np.ndarray, known: np.ndarray):
        self.length, self.members = length, np.array(members)
        mine = [items[i] for i in members]
        self.vectors, self.blank = vectors[members], blank[members]
        self.need = np.array([LIKELY * len(x.words) for x in mine])
        self.size = np.array([len(x.words) for x in mine])
        self.more = np.array([margin(x) for x in mine])
        own = np.unique(np.array([w for x in mine for w in x.words], dtype=np.uint64))
        #: Of each known word the row of `masks` or `counts`; row 0 is for words that no item of the group has.
        self.slot = np.zeros(len(known), np.int32)
        self.slot[np.searchsorted(known, own)] = np.arange(1, len(own) + 1)
        self.limbs = -(-int(self.size.max()) // 64)
        row = {w: k + 1 for k, w in enumerate(own.tolist())}
        self.long = [[row[w] for w in x.words] for x in mine] if self.limbs > LIMBS else None
        if self.long is None:
            self.masks = np.zeros((len(mine), len(own) + 1, self.limbs), np.uint64)
            for i, x in enumerate(mine):
                for k, w in enumerate(x.words):
                    self.masks[i, row[w], k // 64] |= np.uint64(1 << (k % 64))
        else:
            self.counts = np.stack([np.bincount(x, minlength=len(own) + 1) for x in self.long])
            self.where = [places(x) for x in self.long]
        self.has = ((self.masks != 0).any(axis=2) if self.long is None else self.counts > 0).T.astype(np.uint8)

    def held(self, slots: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """At most how many words of each item the regions slots[start:end] hold (regions x items): sums over cells that cover them."""
        width = max(1, self.length // 8)
        cells = np.zeros((-(-len(slots) // width) + 1, len(self.members)), np.int32)
        rows = self.has[np.concatenate([slots, np.zeros(-len(slots) % width, np.int32)])]
        for k in range(width):
            cells[1:] += rows[k::width]
        np.cumsum(cells, axis=0, out=cells)
        return cells[-(-end // width)] - cells[start // width]

    def shares(self, slots: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each region slots[start:end] with its item; a length that is surely below
        the item's need may be given as 0. Regions are sorted by item."""
        if self.long is not None:
            out = np.zeros(len(item), np.int64)
            for k, (a, b, i) in enumerate(zip(start.tolist(), end.tolist(), item.tolist(), strict=True)):
                found = slots[a:b]
                if np.minimum(np.bincount(found, minlength=self.counts.shape[1])[1:], self.counts[i, 1:]).sum() >= self.need[i]:
                    out[k] = common_length(self.long[i], found.tolist(), self.where[i])
            return out
        row = np.full((self.limbs, len(item)), EVERY, np.uint64)
        flat = self.masks.reshape(-1, self.limbs)
        base = item.astype(np.int64) * self.masks.shape[1]
        # Longest regions first, so that those still running at a step are the first ones.
        order = np.argsort(start - end, kind="stable")
        start, base, size = start[order], base[order], (end - start)[order]
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for step, n in enumerate(live.tolist()):
            mask = flat[base[:n] + slots[start[:n] + step]]
            carry = None
            for k in range(self.limbs):
                r = row[k, :n]
                u = r & mask[:, k]
                total = r + u
                over = total < r
                if carry is not None:
                    total += carry
                    over |= total < carry
                row[k, :n] = total | (r - u)
                carry = over.astype(np.uint64)
        out = np.empty(len(item), np.int64)
        out[order] = (64 * self.limbs) - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
        return out


class Searcher:
    """Finds items of one block in batches of texts."""

    def __init__(self, items: list[Item], idf: np.ndarray, space: np.ndarray):
        self.items = items
        feature = lambda words: (words & np.uint64(FEATURES - 1)).astype(np.int64)
        table = space * idf[:, None]
        vectors = np.stack([table[feature(np.array(x.words, dtype=np.uint64))].sum(axis=0) for x in items])
        blank = np.linalg.norm(vectors, axis=1) <= 1e-9
        vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]).astype(np.float32)
        self.known = np.unique(np.array([w for x in items for w in x.words], dtype=np.uint64))
        self.table = table[feature(self.known)].astype(np.float32)
        #: Whether items have a word of these upper 16 bits: most words of a text that no item has are told by it.
        self.high = np.zeros(1 << 16, dtype=bool)
        self.high[(self.known >> np.uint64(48)).astype(np.int64)] = True
        classes: dict[int, list[int]] = {}
        lengths = lengths_up_to(max(len(x.words) for x in items))
        for i, x in enumerate(items):
            classes.setdefault(min(lengths, key=lambda n: abs(np.log(n / len(x.words)))), []).append(i)
        self.groups = []
        for length, members in sorted(classes.items()):
            some = max(1, GROUP_WORDS // length)
            self.groups += [Group(length, members[k : k + some], items, vectors, blank, self.known) for k in range(0, len(members), some)]
        self.overlap = max(g.length + 2 * int(g.more.max()) for g in self.groups)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item_id, cosine, share of its words, share of its answer's words in sequence) for each text and item."""
        t = tokens(data, offsets)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        start, end, text = spans(t.first, CHUNK_WORDS, self.overlap)
        total = np.concatenate([[0], np.cumsum(end - start)])
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK_WORDS, side="right")) - 1)
            self.chunk(t.hashes[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a], text[a:b], best)
            a = b
        return [(text, self.items[i].item_id, *v) for (text, i), v in sorted(best.items())]

    def chunk(self, h: np.ndarray, first: np.ndarray, last: np.ndarray, texts: np.ndarray, best: dict) -> None:
        """Searches spans first..last of the words h."""
        if not len(h):
            return
        # Places of the words that items have, which of them, and how many there are up to each word.
        maybe = np.flatnonzero(self.high[(h >> np.uint64(48)).astype(np.int32)])
        word = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        same = self.known[word] == h[maybe]
        maybe, word = maybe[same], word[same]
        if not len(word):
            return
        told = np.zeros(len(h) + 1, np.int64)
        told[maybe + 1] = 1
        told = np.cumsum(told)
        # Sums of vectors up to each of them; words that no item has add nothing.
        total = np.concatenate([np.zeros((1, self.table.shape[1]), np.float32), np.cumsum(self.table[word], axis=0, dtype=np.float32)])
        n = last - first
        for g in self.groups:
            slots = g.slot[word]
            own = slots > 0
            slots, upto = slots[own], np.concatenate([[0], np.cumsum(own)])[told]
            stride = max(1, g.length // 3)
            count = np.where(n > g.length, -(-(n - g.length) // stride) + 1, np.minimum(n, 1))
            span = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
            start = first[span] + np.minimum(k * stride, np.maximum(n[span] - g.length, 0))
            end = np.minimum(start + g.length, last[span])
            low, high = first[span], last[span]
            # What is accepted has LIKELY of an item's words in the region that is read: with fewer words of any item it can't.
            wide = int(g.more.max())
            a, b = upto[np.maximum(start - wide, low)], upto[np.minimum(end + wide, high)]
            some = b - a >= g.need.min()
            span, start, end, low, high, a, b = (x[some] for x in (span, start, end, low, high, a, b))
            if not len(span):
                continue
            v = total[told[end]] - total[told[start]]
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            # A window without any word of weight has no cosine and is passed on as items without one are.
            near = (v @ g.vectors.T >= COSINE * np.maximum(norm, 1e-12)[:, None]) | g.blank | (norm <= 1e-9)[:, None]
            near &= g.held(slots, a, b) >= g.need
            hit, item = np.nonzero(near)
            more = g.more[item]
            a, b = upto[np.maximum(start[hit] - more, low[hit])], upto[np.minimum(end[hit] + more, high[hit])]
            some = b - a >= g.need[item]
            item, hit, a, b = item[some], hit[some], a[some], b[some]
            for i in range(0, len(item), REGIONS):
                part = slice(i, i + REGIONS)
                common = g.shares(slots, a[part], b[part], item[part])
                for j in np.flatnonzero(common >= g.need[item[part]]).tolist():
                    w, m = int(hit[i + j]), int(item[i + j])
                    region = h[max(low[w], start[w] - g.more[m]) : min(high[w], end[w] + g.more[m])].tolist()
                    self.accept(int(texts[span[w]]), int(g.members[m]), float(v[w] @ g.vectors[m] / max(norm[w], 1e-12)), int(common[j]), region, best)

    def accept(self, text: int, j: int, cosine: float, common: int, region: list[int], best: dict) -> None:
        item = self.items[j]
        share = common / len(item.words)
        held = best.get((text, j), (0.0, 0.0, 0.0))
        if (share, 1.0, 1.0) <= (*held[1:], held[0]):
            return
        answer = common_length(item.answer, region) / len(item.answer)
        if (share >= CERTAIN or answer >= ANSWER) and (share, answer, cosine) > (*held[1:], held[0]):
            best[text, j] = (cosine, share, answer)


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """A searcher for each block of items, after the passes over all documents."""
    rows = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL"), "benchmark")
    n_blocks = -(-rows.count() // BLOCK)
    if not n_blocks:
        return
    plain = texts(docs)
    idf = weights(plain)
    space = singular_space(plain, idf)
    for k in range(n_blocks):
        part = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        items = items_of([tuple(r) for r in part.orderBy("item_id", "text").collect()])
        if items:
            yield Searcher(items, idf, space)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer_share of every document that holds an item."""
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double"
    out = None
    for s in searchers(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], s: Searcher = s) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = s.find(*K.flat(b["text"]))
                ids = b["doc_id"].to_pylist()
                rows = [(ids[g[0]], *g[1:]) for g in got]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(5)], ["doc_id", "item_id", "cosine", "share", "answer_share"])

        found = in_arrow(texts(docs), run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def holder(s: Searcher):
    """Whether a text holds an item, as a function of a column."""

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        flags = np.zeros(len(column), dtype=bool)
        at = 0
        for part in sliced([pa.RecordBatch.from_arrays([pa.array(column, pa.string(), from_pandas=True)], ["text"])]):
            flags[[at + g[0] for g in s.find(*K.flat(part["text"]))]] = True
            at += part.num_rows
        return pd.Series(flags)

    return holds


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    out = docs
    for s in searchers(docs, benchmark):
        out = out.where(~holder(s)(F.col("text").cast("string")))
    return out
