import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import kernels, labelled, quality, toxicity

BAD = ["grumblefop", "nastywug", "vilequx"]


def words(r, n):
    return ["".join(r.choice(["ba", "ko", "ti", "re", "su", "na"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def toxic_rows(n=600):
    r = random.Random(2)
    rows = []
    for i in range(n):
        w = words(r, r.randint(3, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", "s", "!!", ","])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_gradients_agree_with_differences():
    r = np.random.default_rng(0)
    w = toxicity.words_of(*kernels.flat(pa.array(["ab cd ef gh ab", "cd xy zz"])))
    net = toxicity.Network.fresh(w.hashes[:3], r.standard_normal(3).astype(np.float32), np.zeros(toxicity.GRAMS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, length, _ = toxicity.windows(w.first)
    y, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        z = net.run(net.inputs(w)[0], net.places(w, start, length), length).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    g = net.gradients(w, start, length, y, weight)
    for k in ("u", "va", "wa", "wf", "ub", "cf"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        eps = 1e-2
        net.p[k][at] += eps
        up = loss()
        net.p[k][at] -= 2 * eps
        down = loss()
        net.p[k][at] += eps
        assert abs((up - down) / (2 * eps) - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-4, k


def test_windows_cover_all_words():
    first = np.array([0, 0, 5, 5 + 20, 25 + 133])
    start, length, bounds = toxicity.windows(first)
    for i in range(4):
        seen = set()
        for s, n in zip(start[bounds[i] : bounds[i + 1]], length[bounds[i] : bounds[i + 1]], strict=True):
            seen |= set(range(s, s + n))
        assert seen == set(range(first[i], first[i + 1]))


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "ba " * 50_000 + "nastywug")], "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS held_out")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows] + [(1, None, None)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and got[9000].score == got[9001].score and got[9002].predicted == 1
    test = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([got[i].predicted == y for i, y in test]) > 0.95
    left = {r.doc_id for r in toxicity.clean(docs, labels).collect()}
    assert left == {i for i in got if got[i].predicted == 0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}


def test_quality_on_held_out_rows(spark):
    r = random.Random(4)
    rows = []
    for i in range(500):
        w = words(r, r.randint(5, 200))
        bad = i % 3 == 0
        rows.append((i, " ".join(x + "$$" if bad and r.random() < 0.5 else x for x in w), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    test = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 502 and np.mean([got[i].predicted == y for i, y in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs.limit(3), labels.limit(0)).count() == 3


def test_flat_trees_agree_with_a_walk():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    f = quality.grow(x, y, np.ones(400))
    for row, s in zip(x[:50], f.scores(x[:50]), strict=True):
        total = f.base
        for n in f.roots:
            while f.left[n] >= 0:
                n = f.left[n] + int(row[f.feature[n]] > f.limit[n])
            total += f.value[n]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((f.scores(x) > 0.5) == y).mean() > 0.95


def test_statistics_of_each_text_stand_alone():
    items = ["Hello world.\nHello world.\n", None, "", "$$ ## !!", "ÀÉ " * 30, "A" * 5000, "\n\n", "a a a b"]
    together = quality.statistics(*kernels.flat(pa.array(items, pa.string())))
    for i, t in enumerate(items):
        assert np.allclose(together[i], quality.statistics(*kernels.flat(pa.array([t], pa.string())))[0])


def test_samples_are_bounded_and_never_held_out(spark):
    rows = [(i, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id long, toxic int")
    items, y, w = labelled.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 20)
    assert len(items) == 40 and sum(y) == 20 and all(zlib.crc32(re.sub(r"\D", "", t).encode()) % 5 for t in items) and min(w) > 1


def test_cleanup_leaves_nothing(spark):
    import os

    from granary.llm.common import RUN, cleanup, cut, shared_dir

    assert cut(spark.range(3).toDF("id"), "x").count() == 3
    where = shared_dir(spark).removeprefix("file://") + f"/granary-{RUN}"
    assert os.path.isdir(where)
    cleanup(spark)
    assert not os.path.exists(where)
