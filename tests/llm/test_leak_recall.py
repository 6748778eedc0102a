"""Recall of decontamination by length of the item, kind and share of edits, against the subsequence rule itself."""

import random

import pyarrow as pa
import pytest

from granary.llm import decontaminate as D
from granary.llm import kernels as K

LENGTHS = [8, 14, 25, 60, 150, 400, 1000, 4000, 20_000]
EDITS = ["verbatim", "replaced", "dropped", "inserted", "moved"]
SHARE = 0.2


def edited(r, words, kind, fresh):
    if kind == "replaced":
        return [fresh() if r.random() < SHARE else w for w in words]
    if kind == "dropped":
        return [w for w in words if r.random() >= SHARE]
    if kind == "inserted":
        return [x for w in words for x in ((w, fresh()) if r.random() < SHARE else (w,))]
    if kind == "moved":
        n = int(len(words) * SHARE)
        a = r.randrange(len(words) - n + 1)
        rest = words[:a] + words[a + n :]
        b = r.randrange(len(rest) + 1)
        return rest[:b] + words[a : a + n] + rest[b:]
    return list(words)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(6000)]
    fresh = lambda: vocabulary[int(len(vocabulary) * r.random() ** 3)]
    items = [(10 * k + c, [fresh() for _ in range(n)]) for k, n in enumerate(LENGTHS) for c in range(4 if n < 4000 else 1)]
    docs, planted = [], []
    for i, words in items:
        for kind in EDITS:
            body = [fresh() for _ in range(r.randint(0, 500))]
            at = r.randrange(len(body) + 1)
            planted.append((len(docs), i, len(words), kind))
            docs.append((len(docs), " ".join(body[:at] + edited(r, words, kind, fresh) + body[at:])))
    clean = [(len(docs) + k, " ".join(fresh() for _ in range(r.choice([5, 200, 3000])))) for k in range(200)]
    return items, docs + clean, planted


def test_recall_by_edit_and_length(spark, corpus):
    items, docs, planted = corpus
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(16), bench).collect()}
    words = {i: D.tokens(*K.flat(pa.array([" ".join(w)]))).hashes.tolist() for i, w in items}
    texts = dict(docs)
    due, got = {}, {}
    for d, i, n, kind in planted:
        if D.common_length(words[i], D.tokens(*K.flat(pa.array([texts[d]]))).hashes.tolist()) >= D.CERTAIN * n:
            for key in (kind, n):
                due[key] = due.get(key, 0) + 1
                got[key] = got.get(key, 0) + ((d, i) in found)
    print({k: (got[k], v) for k, v in due.items()})
    assert all(got[k] == due[k] for k in ("verbatim", 20_000, 4000))
    for key in EDITS:
        assert got[key] >= 0.9 * due[key], key
    for key in LENGTHS:
        assert got[key] >= 0.9 * due[key], key
    assert not {f for f in found if f[0] >= len(planted)}


def test_regions_are_compared_as_the_plain_subsequence():
    r = random.Random(4)
    for n in (1, 5, 63, 64, 65, 130, 500, 520):
        words = lambda k: [r.randrange(40) for _ in range(k)]  # noqa: E731, B023
        hashes = [int(K.mix(K.GOLD * (K.np.arange(1, dtype=K.np.uint64) + K.np.uint64(w)))[0]) for w in range(40)]
        items = [D.Item(k, [hashes[w] for w in words(max(1, n - k % 3))], [1]) for k in range(4)]
        s = D.Searcher(items, K.np.ones(D.FEATURES, K.np.float32), K.np.random.default_rng(1).standard_normal((D.FEATURES, 8)).astype(K.np.float32))
        text = [hashes[w] for w in words(3 * n + 5)]
        known = K.np.searchsorted(s.known, K.np.array(text, dtype=K.np.uint64))
        ok = s.known[K.np.minimum(known, len(s.known) - 1)] == K.np.array(text, dtype=K.np.uint64)
        for g in s.groups:
            slots = K.np.where(ok, g.slot[K.np.minimum(known, len(s.known) - 1)], 0)
            item = K.np.repeat(K.np.arange(len(g.members)), 12)
            start = K.np.array([r.randrange(len(text)) for _ in item])
            end = K.np.array([r.randint(a, len(text)) for a in start])
            got = g.shares(slots, start, end, item)
            for x, a, b, i in zip(got, start, end, item, strict=True):
                want = D.common_length(items[g.members[i]].words, text[a:b])
                assert x == want or (x < g.need[i] and want < g.need[i])


def test_long_texts_are_searched_in_overlapping_spans():
    first = K.np.array([0, 10, 10, 250, 255])
    start, end, text = D.spans(first, 50, 20)
    assert text.tolist() == [0, 1, 2, 2, 2, 2, 2, 3] and start.tolist() == [0, 10, 10, 60, 110, 160, 210, 250] and end.tolist() == [10, 10, 80, 130, 180, 230, 250, 255]


def test_items_of_one_id_and_repeated_rows(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x y z {a} w"), (1, f"x y z {a} w"), (2, f"q {b} r"), (None, a)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, a), (5, b), (5, a)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == {(1, 5), (2, 5), (None, 5)}
    assert D.decontaminated(docs, bench).count() == 0
