import gzip
import hashlib
import re

from granary.llm import exact_dedup, warc
from granary.llm.common import scratch

DOCS = [(3, "a b"), (1, "a  \n b"), (2, " a b"), (4, None), (5, ""), (6, "x" * 200_000), (7, "x" * 200_000), (3, "a b"), (8, "a b")]


def test_groups(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS __repeats2", "3 AS group_size")
    got = sorted(tuple(r) for r in exact_dedup.groups(df).collect())
    keys = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in DOCS}
    want = []
    for i, t in DOCS:
        k = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        same = [j for j, u in DOCS if keys[j] == k]
        want.append((i, min(same), len(same), i == min(same), hashlib.sha256(k.encode()).hexdigest()))
    assert got == sorted(want)


def test_deduplicated_keeps_columns(spark):
    df = spark.createDataFrame([(*d, "en") for d in DOCS], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang) for r in exact_dedup.deduplicated(df).collect())
    assert got == [(1, "en"), (2, "en"), (4, "en"), (6, "en"), (8, "en")]
    assert exact_dedup.deduplicated(df.limit(0)).count() == 0
    assert exact_dedup.groups(df.limit(0)).count() == 0


def test_a_full_filter_only_shuffles_more(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BYTES", 1)
    monkeypatch.setattr(exact_dedup, "cells", lambda key, n: [exact_dedup.F.lit(0).cast("long")] * 2)
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup.groups(df).dropDuplicates(["doc_id"]).collect()) == 5


PAGES = [(5, "http://a/\r\nX: y", "p" * 150), (2, None, "p" * 150), (9, "http://b", "p" * 99), (8, "http://c", "p" * 99), (7, "u", None), (1, "ü", "é\r\n\r\nWARC/1.1" * 30000), (None, "n", "q" * 200)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS shard")
    out = scratch(spark, "test")
    warc.write(df, out, shard_bytes=300, file_bytes=100)
    got = {r.page_id: r for r in warc.read(spark, out, payloads=True).collect()}
    assert set(got) == {p[0] for p in PAGES}
    for i, url, html in PAGES:
        b = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if i == 5 else ("response", None))
        assert r.payload == (None if i == 5 else b)
    again = scratch(spark, "test")
    warc.write(df.repartition(3), again, shard_bytes=300, file_bytes=100)
    name = lambda p: sorted((r.file, r.sha256, r.records) for r in spark.read.parquet(p + "/manifest").collect())
    assert name(out) == name(again) and len(name(out)) > 3
    for r in spark.read.parquet(out + "/manifest").collect():
        with open(out.removeprefix("file://") + "/" + r.file, "rb") as f:
            raw = f.read()
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(df).count() == 0


def test_clumped_ids_are_parted(spark):
    sizes = spark.range(1000).selectExpr("id + IF(id > 500, 1000000000000, 0) AS page_id", "10L AS payload_bytes")
    bounds = warc.shard_bounds(sizes, 1000)
    assert 9 <= len(bounds) <= 12
