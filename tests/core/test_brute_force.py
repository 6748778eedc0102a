"""Queries without SQL against plain versions of their definitions, over the whole smallest tables."""

import difflib
import math
import os
import re
from itertools import groupby

import pandas as pd
import pytest

from granary import catalog
from granary.operators import chunking as C
from granary.plans.inputs import chunks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def found(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
    return row[-1]


def test_refusals_by_dynamic_programming(spark):
    bare = lambda s: re.sub("[\"'.,]", "", s).lower()
    want = {}
    for r in table("conversations").query("role == 'assistant'").itertuples():
        a = bare("I don't know" if r.conv_id % 3 == 0 else r.text or "")
        want[r.conv_id, r.turn] = any(200 * common(a, bare(k)) / len(a + bare(k)) >= 60 for k in ("I don't know.", "None"))
    got = found(spark, "refusal_similarity")
    assert len(got) == len(want) and {(c, t): x for c, t, x in got} == want and set(want.values()) == {True, False}


def test_file_names_against_every_known_one(spark):
    part = table("part")
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    known = sorted(part["p_brand"].unique())
    best = {}
    for cited in {b + "x" for b in known}:
        likeness = {k: difflib.SequenceMatcher(None, bare(cited), bare(k)).ratio() for k in known}
        best[cited] = {k for k in known if likeness[k] == max(likeness.values()) >= 0.7}
    got = found(spark, "file_name_match")
    assert sorted((i, n) for i, n, _ in got) == sorted((r.p_partkey, r.p_brand + "x") for r in part.itertuples())
    assert all(m in best[n] if best[n] else m is None for _, n, m in got)


def test_semantic_groups_row_by_row(spark):
    want = set()
    rows = sorted((r.vec_id, r.vec_id // 4, [float(x) for x in r.embedding]) for r in table("embeddings").itertuples())
    cosine = lambda a, b: math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))
    for _, file in groupby(rows, lambda r: r[0] // 100):
        free, number = list(file), 0
        while free:
            seed, *rest = free
            group, last = [seed], seed[1]
            for r in rest:
                if r[1] > last + 2:
                    break
                if cosine(seed[2], r[2]) >= 0.4:
                    group.append(r)
                    last = r[1]
            free = [r for r in rest if len(group) == 1 or r not in group]
            if len(group) > 1:
                want |= {(r[0], number) for r in group}
                number += 1
    got = found(spark, "semantic_groups")
    assert len(got) == len(set(got)) and set(got) == want and want


def test_fuzzy_dedup_against_all_kept(spark):
    signs = lambda s: re.findall(r"\d+(?:[.,]\d+)?|[<>=≤≥±]", s)
    want = {}
    rows = sorted(chunks(spark, SF).select("doc_id", "content_type", "original_chunk").collect())
    for _, file in groupby(rows, lambda r: r.doc_id // 50):
        kept = []
        for r in file:
            text = (r.original_chunk or "").strip()
            alike = lambda k: difflib.SequenceMatcher(None, *sorted((text.lower(), k.lower()))).ratio() >= 0.85  # noqa: B023, E731
            near = [k for k in kept if len(k) <= 2 * len(text) <= 4 * len(k) and signs(k.lower()) == signs(text.lower())] if r.content_type not in C.SKIPPED else []
            reason = "duplicate" if text in kept else "similarity" if any(map(alike, near)) else "unique"
            if reason == "unique":
                kept.append(text)
            want[r.doc_id] = (reason == "unique", reason)
    got = found(spark, "fuzzy_dedup")
    assert len(got) == len(want) and {i: (k, r) for i, k, r in got} == want


def test_superchunks_hold_their_members(spark):
    text = {(str(r.conv_id), f"c{r.turn}"): r.text for r in table("conversations").itertuples()}
    seen = set()
    for file, name, n, pages, members, joined in found(spark, "superchunk_build"):
        turns = [int(m[1:]) for m in members]
        assert n == len(members) > 1 and turns == list(range(turns[0], turns[0] + n)) and pages == f"{turns[0]}-{turns[-1]}"
        assert joined == "\n\n".join(text[file, m] for m in members) and name.startswith(f"superchunk_{turns[0] // 4}")
        assert len(joined) <= 3000 and not seen & {(file, m) for m in members}
        seen |= {(file, m) for m in members}
    for file, m in text.keys() - seen:
        mates = [t for (f, c), t in text.items() if f == file and c != m and int(c[1:]) // 4 == int(m[1:]) // 4 and abs(int(c[1:]) - int(m[1:])) == 1 and (f, c) not in seen]
        assert all(len(t) + len(text[file, m]) + 2 > 3000 for t in mates)


def test_sheets_keep_every_row_once(spark):
    rows = {}
    for r in table("orders").sort_values("o_orderkey").itertuples():
        rows.setdefault(str(r.o_custkey % 40), []).append((r.o_orderpriority, r.o_totalprice, r.o_orderstatus))
    got = {}
    for file, _, part, tabular, text in sorted(found(spark, "sheet_reader")):
        lines = [x.split(" | ") for x in text.split("\n")] if tabular else [text]
        assert not tabular or len(lines) <= 41 and sum(len(" | ".join(x)) for x in lines[1:]) <= 1800
        got.setdefault(file, []).append((part, tabular, lines))
    assert got.keys() == rows.keys()
    for file, parts in got.items():
        if not parts[0][1]:
            assert len(rows[file]) < 3
            continue
        head, *body = rows[file]
        assert [p for p, _, _ in parts] == list(range(len(parts))) and all(lines[0] == parts[0][2][0] for _, _, lines in parts)
        lines = [parts[0][2][0]] + [x for _, _, ls in parts for x in ls[1:]]
        assert [(a, float(b), c) for a, b, c in lines] == [head, *body]


def test_splits_cover_whole_texts(spark):
    parts = {}
    for i, position, _, chunk, _ in sorted(found(spark, "recursive_split")):
        parts.setdefault(i, []).append((position, chunk))
    docs = {r.doc_id: r.text for r in table("documents").itertuples()}
    assert parts.keys() == {i for i, t in docs.items() if t and t.strip()}
    for i, pieces in parts.items():
        end, at, t = 0, -1, docs[i]
        assert [p for p, _ in pieces] == list(range(len(pieces)))
        for _, c in pieces:
            assert 0 < len(c) <= C.SIZE
            # Pieces begin in order, at most an overlap before the end of the one before, and leave out white space only.
            first = next((b for b in range(max(at + 1, end - C.OVERLAP), len(t)) if t.startswith(c, b) and (b <= end or not t[end:b].strip())), None)
            assert first is not None
            at, end = first, first + len(c)
        assert not t[end:].strip()
