import random

import numpy as np
import pyarrow as pa

from granary.llm import kernels, near_dedup
from granary.llm.near_dedup import near_duplicates, shingle_sets


def brute(rows):
    """Same contract from plain Python sets."""
    import re

    sets = {}
    for i, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 12)))
    common = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "x " * 3000), (6, "É é A"), (7, "é é a")]
    i = 8
    for _ in range(12):
        base = [word() for _ in range(r.choice([4, 7, 40, 200]))]
        for _ in range(r.choice([1, 3, 8])):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 40)):
                t[r.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    for _ in range(40):  # a passage that many share, near the threshold
        rows.append((i, " ".join(common + [word() for _ in range(r.randint(2, 40))])))
        i += 1
    return rows


def test_agrees_with_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "'x' AS component_id")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_empty_table(spark):
    out = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_sets_are_distinct_and_sorted():
    a, b, c = shingle_sets(pa.array(["a b c d e a b c d e", None, "a b"]))
    assert len(a) == 5 and (np.diff(a.astype(object)) > 0).all() and len(b) == 0 and len(c) == 1


def test_rows_that_repeat_or_lack_an_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, b), (3, b + " y"), (None, c), (None, c + " z"), (7, c + " z z"), (None, "all alone here"), (5, a + " q"), (3, c + " unlike " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (3, 1, False), (None, 7, False), (None, 7, False), (7, 7, True), (None, None, True), (5, 1, False), (3, 3, True)], key=str)
    left = [r.text for r in near_dedup.deduplicated(df).collect()]
    assert sorted(left) == sorted([a, b, c + " z z", "all alone here", c + " unlike " + a])


def test_small_sets_at_the_threshold_are_linked_in_blocks():
    r = random.Random(8)
    batches, want = [], set()
    sets, size = [], 0
    for k in range(10_000):
        n = r.choice([4, 8, 12, 16, 20])
        common = [r.getrandbits(64) for _ in range(3 * n // 4)]
        extra = [r.getrandbits(64) for _ in range(n - len(common))]
        cut = r.randint(0, len(extra))
        pair = [np.unique(np.array(common + extra[:cut], dtype=np.uint64)), np.unique(np.array(common + extra[cut:], dtype=np.uint64))]
        sets += pair
        want.add((2 * k, 2 * k + 1))
    sig = kernels.one_permutation(sets, near_dedup.BINS, kernels.jumps(near_dedup.BINS))
    bands = kernels.band_keys(sig[:, : near_dedup.BANDS * near_dedup.ROWS], near_dedup.ROWS).view(np.int64)
    low = near_dedup.mixed16(sig)
    for k in range(10_000):
        x, y = bands[2 * k], bands[2 * k + 1]
        same = np.flatnonzero(x == y)
        if not len(same):
            want.discard((2 * k, 2 * k + 1))
            continue
        for i in (2 * k, 2 * k + 1):
            batches.append({"key": int(bands[i][same[0]]), "low": 0, "high": 0, "block": 0, "rep": i, "comp": i, "n_shingles": len(sets[i]), "bands": bands[i].tolist(), "sig": low[i].tobytes(), "shingles": sets[i].tobytes()})
    assert len(want) > 9_990
    batches.sort(key=lambda b: (b["key"], b["rep"]))
    schema = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("shingles", pa.binary())])
    table = pa.Table.from_pylist(batches, schema).to_batches(max_chunksize=300)
    kept = [i for b in near_dedup.screened(iter(table)) for i in b["rep"].to_pylist()]
    assert sorted(kept) == sorted(i for p in want for i in p)
    got = {(a, b) for t in near_dedup.linked_in_blocks(iter(table)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)}
    assert got == want
