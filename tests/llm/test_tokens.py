import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import bpe, kernels, token_counts
from granary.llm.common import scratch

TEXTS = [None, "", "  \n ", "Hello  world", "don't it's 'll 12345 a<|endoftext|>b <|startoftext|>", "é é ́x ΑΣ ΑΣ. İstanbul ſ", "日本語 テスト 한국어 각", "x" * 5000, " a b\u0085c\x1cd\x00e", "Ŀ ŉ İİ ſs ÷×ÿŸ Œuvre a_b [x]{y} ~` \\ é1é2 ½", "A\U0001f600B \U0001f468‍\U0001f469"]


def long_texts():
    r = random.Random(1)
    words = ["".join(r.choice("abcdeéß'!1") for _ in range(r.randint(1, 9))) for _ in range(300)]
    shared = " ".join(r.choice(words) for _ in range(400))
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 600))) + r.choice([" ", "\n", "  "]) + shared for _ in range(12)]


@pytest.mark.parametrize("mask", [63, 3])
def test_ids_and_decoding_are_the_library_s(mask):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    enc = bpe.Encoder(bpe.vocabulary(), mask)
    items = TEXTS + long_texts()
    assert enc.apart
    for _ in range(2):
        got = enc.encode(*kernels.flat(pa.array(items, pa.string())))
        for s, (ids, decoded) in zip(items, got, strict=True):
            want = t.encode(s or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded.decode() == t.decode(want, skip_special_tokens=False)
    assert enc.reused > enc.encoded


def test_vocabulary_with_white_space_in_tokens():
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    enc = bpe.Encoder(path, 3)
    items = TEXTS + long_texts()[:4]
    assert not enc.apart
    for s, (ids, decoded) in zip(items, enc.encode(*kernels.flat(pa.array(items, pa.string()))), strict=True):
        want = t.encode(s or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_digests(spark):
    items = list(enumerate(TEXTS)) + [(3, "Hello  world")]
    df = spark.createDataFrame(items, "doc_id long, text string").selectExpr("*", "'x' AS ids")
    got = bpe.digests(df).collect()
    assert len(got) == len(items) and {r.n_tokens for r in got if r.doc_id < 3} == {0}
    assert {r.ids_sha256 for r in got if r.doc_id == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.digests(df.limit(0)).count() == 0


def test_counts_and_cache(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary("piece_bpe_32k.model"))
    items = list(enumerate(TEXTS + long_texts())) + [(100, "Hello  world"), (3, "Hello  world"), (101, "tok " * 9000)]
    df = spark.createDataFrame(items, "doc_id long, text string").selectExpr("*", "1 AS digest")
    cache = scratch(spark, "cache")
    want = sorted((i, len((s or "").encode()), len(sp.encode(s or "")), len(sp.encode(s or "")) > 4096) for i, s in items)
    some = df.where("doc_id < 5")
    assert sorted(map(tuple, token_counts.token_counts(some, cache).collect())) == [w for w in want if w[0] < 5]
    assert sorted(map(tuple, token_counts.token_counts(df, cache).collect())) == want
    held = spark.read.parquet(cache).count()
    assert held == len({s or "" for _, s in items})
    assert sorted(map(tuple, token_counts.token_counts(df, cache).collect())) == want
    assert spark.read.parquet(cache).count() == held
    assert token_counts.token_counts(df.limit(0), cache).count() == 0


def test_long_white_space_and_letters_of_several_bytes():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    r = random.Random(6)
    words = ["日本語のテキスト", "éàü" * 20, "ñ" * 33, "a" * 64, "b" * 65, "한국어", "x", "don't", "😀😀", "ß" * 32 + "s", "12", "İ"]
    gap = lambda: r.choice([" ", "\n", " " * r.randint(60, 70), " " * r.randint(160, 210), "\t" * 64])
    items = ["".join(r.choice(words) + gap() for _ in range(r.randint(1, 80))) for _ in range(300)]
    items += [w + " " * k + "next word" for w in words for k in (1, 63, 64, 65, 129, 171, 199, 200, 201)]
    for mask in (63, 1):
        enc = bpe.Encoder(bpe.vocabulary(), mask)
        for s, (ids, decoded) in zip(items, enc.encode(*kernels.flat(pa.array(items, pa.string()))), strict=True):
            want = t.encode(s, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_reuse_is_measured(spark):
    shared = " ".join(f"word{i}" for i in range(600))
    got = bpe.reuse(spark.createDataFrame([(i, shared) for i in range(10)], "doc_id long, text string").coalesce(2)).first()
    assert got.repeated_in_corpus == got.chunks * 9 // 10 and 0 < got.reused_by_workers <= got.repeated_in_corpus


def test_counts_of_rows_without_an_id(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary("piece_bpe_32k.model"))
    items = [(None, "one text"), (None, "one text"), (None, "another"), (1, "third"), (None, "third"), (None, None), (2, "unique")]
    df = spark.createDataFrame(items, "doc_id long, text string")
    want = sorted(((i, len((s or "").encode()), len(sp.encode(s or "")), False) for i, s in items), key=str)
    cache = scratch(spark, "cache")
    assert sorted(map(tuple, token_counts.token_counts(df.where("doc_id = 1"), cache).collect())) == [w for w in want if w[0] == 1]
    for _ in range(2):
        assert sorted(map(tuple, token_counts.token_counts(df, cache).collect()), key=str) == want
