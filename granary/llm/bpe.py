"""BPE encoding and decoding with content-defined chunk reuse (operator 7).

A text is cut into chunks after words where a rolling hash of the last WINDOW words meets a fixed pattern, so passages that
documents share give equal chunks wherever they stand. A worker encodes each distinct chunk once and keeps its ids under a
128-bit digest. Where the vocabulary never joins tokens over white space, a chunk it has not met is put together from the
tokenizer's own units (letter runs, digits, marks), of which new ones are encoded in one go and kept likewise, if its
characters are such that the units are certain; any other chunk is encoded whole. Joins between chunks are repaired: the
words at a join are encoded together, and where that differs from their ids apart, more is encoded as one, at worst the
whole text. Stores are bounded and drop what has not been met for longest, so memory is bounded too.

Chunks are shared by all documents that a worker reads, not by a table of the whole corpus: to encode a chunk once in the
corpus, the texts of all chunks and then the ids of all documents would have to be shuffled, which is about twice the
input, to save the encoding of what is repeated; reuse() measures both shares for any table.

Edge cases: null text counts as empty and gives no ids and an empty decoded text; special strings in a text are handled
as the library does; words and runs of white space may be of any length, and letters of several bytes at any place; repeated rows and ids are encoded each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, texts

WINDOW, MASK = 4, 63
UNIT_STORE, CHUNK_STORE, JOIN_STORE = 250_000, 12_000, 200_000
#: Joins of longer words are not stored but encoded.
LONGEST = 64
#: Characters whose units are certain: ASCII but for the apostrophe, and precomposed Latin letters that are one letter in lower case.
CERTAIN = re.compile("[ \\t\\n\\r!-&(-~À-ÖØ-öø-įı-ſ]*")
UNIT = re.compile("[a-zß-öø-įı-ſ]+|[0-9]|[!-/:-@\\[-`{-~]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Store:
    """A bounded memory of two generations: what is asked for moves to the new one; when that is full the old one goes."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict = {}
        self.old: dict = {}

    def lacking(self, keys: set) -> list:
        """Those of keys that neither generation has; the others are in the new one from here on."""
        keys = keys - self.new.keys()
        kept = keys & self.old.keys()
        self.new.update((k, self.old[k]) for k in kept)
        return list(keys - kept)

    def age(self) -> None:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library, reusing chunks and words."""

    def __init__(self, path: str, mask: int = MASK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mask = np.uint64(mask)
        self.plain = self.tokenizer.decoder is None
        with open(path) as f:
            self.apart = self.words_stand_apart(json.load(f))
        self.ids = Store(UNIT_STORE)
        self.chunks = Store(CHUNK_STORE)
        self.joins = Store(JOIN_STORE)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for t, n in vocabulary.items():
            self.token[n] = t.encode()
        self.ends = np.array([t.endswith(b"</w>") for t in self.token])
        self.reused = self.encoded = 0

    def words_stand_apart(self, spec: dict) -> bool:
        """Whether white space never is in a token nor changes its neighbours' ids: the pre-tokenizer's first step drops all
        that its pattern does not match, and each alternative of the pattern excludes white space. Probed as well."""
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = first.get("pattern", {}).get("Regex", " ")
        known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and first.get("behavior") == "Removed" and first.get("invert")
        stripping = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        parts = ["don", "'t", "x1", "é", "́a", "ΑΣ", "!!", "<|endoftext|>", " b", "ᄀ", "ᅡ", "İ"]
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        return bool(known) and not stripping and self.plain and all(ids(a + sep + b) == ids(a) + ids(b) for a in parts for b in parts for sep in (" ", "\n\t"))

    def raw(self, items: list[str]) -> list[bytes]:
        """The library's ids of each item."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(items, add_special_tokens=False)]

    def units(self, chunk: bytes) -> list[str] | None:
        """The tokenizer's units of a chunk; null where they are not certain."""
        text = chunk.decode()
        return UNIT.findall(text.lower()) if CERTAIN.fullmatch(text) and "<|" not in text else None

    def learn(self, units: set[str]) -> None:
        """Stores new units: encoded as one text, in which each ends with one token that ends a word."""
        todo = self.ids.lacking(units)
        for i in range(0, len(todo), 20_000):
            part = todo[i : i + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            bounds = (4 * np.concatenate([[0], ends])).tolist()
            if len(ends) != len(part) or (len(ids) and ends[-1] != len(ids)):
                raise ValueError("a unit is not one word of the vocabulary")
            raw = ids.tobytes()
            self.ids.new.update((u, raw[a:b]) for u, a, b in zip(part, bounds, bounds[1:], strict=False))

    def solve(self, missing: dict[bytes, bytes]) -> None:
        """Stores the ids of chunks, by digest."""
        parts = {k: self.units(c) for k, c in missing.items()}
        self.learn(set().union(*(p for p in parts.values() if p)))
        whole = [k for k, p in parts.items() if p is None]
        self.chunks.new.update(zip(whole, self.raw([missing[k].decode() for k in whole]), strict=True))
        ids = self.ids.new.__getitem__
        self.chunks.new.update((k, b"".join(map(ids, p))) for k, p in parts.items() if p is not None)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """Byte positions at which the chunks of each text begin, and its end."""
        starts, ends, first = K.word_spans(data, offsets)
        h = K.span_hashes(data, starts, ends)
        rolling = np.zeros(len(h), np.uint64)
        for j in range(WINDOW):
            back = h if j == 0 else np.concatenate([np.zeros(min(j, len(h)), np.uint64), h[:-j]])
            rolling = K.mix((rolling ^ back) + K.GOLD)
        number = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        after = np.flatnonzero(((rolling & self.mask) == 0) & (number >= WINDOW - 1)) + 1
        out = []
        marks = np.searchsorted(after, first)
        for i in range(len(offsets) - 1):
            inner = after[marks[i] : marks[i + 1] + 1]
            inner = inner[(inner > first[i]) & (inner < first[i + 1])]
            out.append([int(offsets[i]), *starts[inner].tolist(), int(offsets[i + 1])])
        return out

    def check(self, joins: set[tuple[bytes, bytes]]) -> None:
        """Stores for each pair of words whether they have the same ids together as apart."""
        todo = self.joins.lacking(joins)
        words = list({w for j in todo for w in j})
        apart = dict(zip(words, self.raw([w.decode() for w in words]), strict=True))
        for j, both in zip(todo, self.raw([(a + b" " + b).decode() for a, b in todo]), strict=True):
            self.joins.new[j] = apart[j[0]] + apart[j[1]] == both

    def repaired(self, pieces: list[bytes]) -> bytes:
        """Ids of consecutive chunks whose ids may depend on one another (white space is in tokens): where the ids around a join
        differ together and apart, both sides are encoded as one, at worst the whole text."""
        ids, held = b"", b""
        for k, piece in enumerate(pieces):
            held += piece
            tail = held[-64:].decode(errors="ignore")
            nxt = pieces[k + 1] if k + 1 < len(pieces) else b""
            both, a, b = self.raw([tail + nxt[:64].decode(errors="ignore"), tail, nxt[:64].decode(errors="ignore")])
            if not nxt or both == a + b:
                ids += self.raw([held.decode()])[0]
                held = b""
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids and the decoded text of every text of a batch."""
        raw = data.tobytes()
        bounds = self.cut(data, offsets)
        pieces = [[raw[a:b] for a, b in zip(p, p[1:], strict=False) if b > a] for p in bounds]
        if not self.apart:
            return [self.decoded(self.repaired(p)) for p in pieces]
        keys = [[xxhash.xxh3_128_digest(c) for c in p] for p in pieces]
        chunk = {k: c for p, q in zip(pieces, keys, strict=True) for c, k in zip(p, q, strict=True)}
        missing = self.chunks.lacking(chunk.keys() | set())
        self.encoded += len(missing)
        self.reused += sum(map(len, keys)) - len(missing)
        self.solve({k: chunk[k] for k in missing})
        # One byte more than the longest word that is stored: a word that is cut short here is longer than that, and never decoded.
        joins = [[(a.rstrip()[-LONGEST - 1 :].split()[-1:], b.lstrip()[: LONGEST + 1].split()[:1]) for a, b in zip(p, p[1:], strict=False)] for p in pieces]
        short = lambda a, b: bool(a and b) and len(a[0]) <= LONGEST and len(b[0]) <= LONGEST
        self.check({(a[0], b[0]) for js in joins for a, b in js if short(a, b)})
        out = []
        for p, q, js in zip(pieces, keys, joins, strict=True):
            agree = all(short(a, b) and self.joins.new[a[0], b[0]] for a, b in js)
            out.append(self.decoded(b"".join(map(self.chunks.new.__getitem__, q)) if agree else self.raw([b"".join(p).decode()])[0]))
        for store in (self.ids, self.chunks, self.joins):
            store.age()
        return out

    def decoded(self, ids: bytes) -> tuple[bytes, bytes]:
        """ids, and their text as the library decodes them; without a decoder it joins the tokens by spaces."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return ids, b" ".join(map(self.token.__getitem__, numbers)) if self.plain else self.tokenizer.decode(numbers, skip_special_tokens=False).encode()


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian 32-bit numbers as binary), decoded of every row. A worker keeps its encoder between tasks."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for b in batches:
            got = enc.encode(*K.flat(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return in_arrow(texts(docs), run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encoded(docs, path).select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reuse(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row: chunks of all texts, those that workers took from their stores, and those that the whole corpus has met before."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            data, offsets = K.flat(b["text"])
            raw, before = data.tobytes(), enc.reused
            keys = [xxhash.xxh3_128_digest(raw[x:y]) for p in enc.cut(data, offsets) for x, y in zip(p, p[1:], strict=False) if y > x]
            enc.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(([enc.reused - before] + [0] * len(keys))[: len(keys)], pa.int64())], ["chunk", "reused"])

    found = in_arrow(texts(docs), run, "chunk binary, reused long").groupBy("chunk").agg(F.count("*").alias("n"), F.sum("reused").alias("reused"))
    return found.agg(F.sum("n").alias("chunks"), F.sum("reused").alias("reused_by_workers"), F.sum(F.col("n") - 1).alias("repeated_in_corpus"))
