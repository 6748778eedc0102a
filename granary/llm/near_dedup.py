"""MinHash near-duplicate detection (operator 1).

One-permutation hashing with optimal densification gives each set of five-word shingles a signature; bands of it are
bucket keys. Rows with equal sets are one representative from there on. In a bucket every member is paired with the
member of the smallest id only (a star), and the pairs are confirmed on full shingle sets. Links that a star leaves open
(two members that are linked with each other but not with the centre) are found in the buckets whose members are still in
different components: those are compared in blocks, first signature against signature, then, for members with a partner whose
signature allows the threshold, on full sets. Blocks are bounded and give members and links, never their pairs.

Edge cases: null text counts as empty; a text without words has an empty set, n_shingles 0, and is linked with nothing; a
text of one to four words is one shingle; an empty table gives an empty result; other columns are not read. A row is linked through its own text:
rows that repeat a doc_id or have none are linked as any others, each by its set, and not with one another for their id. The component_id is the
smallest doc_id of the component, null if none of its rows has one; kept then is true for those rows.

Recall: a pair of similarity 0.75 shares no bucket with probability (1 - 0.75 ** ROWS) ** BANDS, about 5e-6; the signature
screen is SCREEN_SIGMAS standard errors below the threshold, and left out for sets of fewer than SMALL shingles, which are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, in_arrow, runs, texts
from .exact_dedup import attach

WORDS = 5
#: Bins of a signature; the first BANDS * ROWS make the bands.
BINS, BANDS, ROWS = 256, 32, 4
#: Similarity in per cent at which documents are linked.
PERCENT = 75
#: Members of a block in the comparison of what the stars leave open.
BLOCK = 1024
SCREEN_SIGMAS, SMALL = 4.5, 64


def shingle_sets(column) -> list[np.ndarray]:
    data, offsets = K.flat(column)
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offsets)
    return K.distinct_sets(*K.shingle_hashes(K.span_hashes(data, starts, ends), first, WORDS))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = K.jumps(BINS)
    for b in batches:
        sets = shingle_sets(b["text"])
        sig = K.one_permutation(sets, BINS, table)
        bands = K.band_keys(sig[:, : BANDS * ROWS], ROWS).view(np.int64)
        low = mixed16(sig)
        yield pa.RecordBatch.from_arrays(
            [
                b["doc_id"],
                b["text_key"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array(list(bands), pa.list_(pa.int64())),
                pa.array([r.tobytes() for r in low], pa.binary()),
            ],
            ["doc_id", "text_key", "n_shingles", "set_key", "bands", "sig"],
        )


def mixed16(sig: np.ndarray) -> np.ndarray:
    return (K.mix(sig) & np.uint64(0xFFFF)).astype(np.uint16)


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b["text"])
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "shingles"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = b["left_set"], b["right_set"]
        keep = [linked(np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def block_pairs(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of whole groups (bucket, block, block): a row and those rows of its group in other components, of a size and
    a signature that allow the threshold. A pair that shares several buckets comes from the first of them only."""
    share = PERCENT / 100
    least = math.ceil(BINS * (share - SCREEN_SIGMAS * math.sqrt(share * (1 - share) / BINS)))
    key, low, high, block, ids, comp, size = (t[c].to_numpy() for c in ("key", "low", "high", "block", "rep", "comp", "n_shingles"))
    sig = np.stack([np.frombuffer(x, np.uint16) for x in t["sig"].to_pylist()])
    bands = np.array(t["bands"].to_pylist(), dtype=np.int64)
    change = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
    for i, j in zip([0, *change.tolist()], [*change.tolist(), len(key)], strict=True):
        at = np.arange(i, j)
        left, right = at[block[i:j] == low[i]], at[block[i:j] == high[i]]
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if low[i] == high[i] else True)]
            y = y[100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x])]
            if len(y):
                y = y[(np.minimum(size[y], size[x]) < SMALL) | ((sig[y] == sig[x]).sum(axis=1) >= least)]
            if len(y):
                same = bands[y] == bands[x]
                y = y[bands[x][same.argmax(axis=1)] == key[i]]
            if len(y):
                yield x, y


def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group that have a partner left; rows and not pairs, so no more come out than go in."""
    for t in runs(batches, ["key", "low", "high"]):
        keep = np.zeros(t.num_rows, dtype=bool)
        for x, y in block_pairs(t):
            keep[x] = keep[y] = True
        yield from t.select(["key", "low", "high", "block", "rep", "comp"]).filter(pa.array(keep)).to_batches()


def linked_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, confirmed on full sets; of those of a batch that would close a circle, none."""
    for t in runs(batches, ["key", "low", "high"]):
        ids, comp = t["rep"].to_numpy().tolist(), t["comp"].to_numpy().tolist()
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        at = np.cumsum([0, *map(len, sets)])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        mark = np.zeros(len(number) + 1, dtype=np.int64)
        for x, ys in block_pairs(t):
            # How many shingles each of them shares with x.
            mine = number[at[x] : at[x + 1]]
            mark[mine] = 1
            n = at[ys + 1] - at[ys]
            first = np.cumsum(n) - n
            both = np.add.reduceat(mark[number[np.arange(n.sum()) + np.repeat(at[ys] - first, n)]], first)
            mark[mine] = 0
            for y in ys[100 * both >= PERCENT * (len(mine) + n - both)].tolist():
                a, b = find(comp[x]), find(comp[y])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((ids[x], ids[y]))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right_set"))
    return in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set"), confirmed, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of a link, comp the smallest id that it reaches: large-star and small-star rounds until
    nothing changes. Both are an aggregate to one row a node and a join, so that a hub is never gathered."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def rows_with_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    rows = texts(docs, F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    signs = cut(in_arrow(rows, signed, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, sig binary"), "signatures")
    full = signs.where("n_shingles > 0")
    reps = full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")))
    # A number for each distinct set; written at once, so it stays.
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    band = reps.select("rep", F.explode("bands").alias("key"))
    buckets = band.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = cut(band.join(buckets, "key"), "buckets")
    inside = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "set_key")
    wanted = inside.select(F.col("doc_id").alias("wanted")).distinct()
    found = in_arrow(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text"), with_sets, "set_key binary, shingles binary")
    sets = cut(found.groupBy("set_key").agg(F.first("shingles").alias("shingles")).join(inside.select("set_key", F.col("rep").alias("id")), "set_key").select("id", "shingles"), "sets")
    stars = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(confirm(stars, sets), "links")
    comps = cut(components(links), "components")
    inside = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    open_keys = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = inside.join(open_keys, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = left.select("key", "rep", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "comp")
    grouped = lambda df: df.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    signature = reps.select("rep", "n_shingles", "bands", "sig")
    near = cut(in_arrow(grouped(dealt.join(signature, "rep")), screened, "key long, low int, high int, block int, rep long, comp long"), "open")
    near = near.join(signature, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    more = cut(in_arrow(grouped(near), linked_in_blocks, "a long, b long"), "links")
    if more.limit(1).count():
        comps = cut(components(links.union(more)), "components")
    named = reps.select("set_key", "rep", "doc_id", "rows").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).drop("rep")
    named = cut(named, "named")
    least = cut(named.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = cut(attach(named.drop("doc_id"), least, "comp", "n").select("set_key", "component_id", "rows"), "names")
    out = attach(signs.select("doc_id", "text_key", "n_shingles", "set_key"), named, "set_key", "rows", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return rows_with_components(docs).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near duplicates."""
    gone = rows_with_components(docs).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__gone_text"))
    return docs.join(gone, same, "left_anti")
