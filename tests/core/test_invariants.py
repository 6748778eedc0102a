"""Invariants of the operators on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from granary.functions import tables as T
from granary.functions import text as X
from granary.operators import chunking as C
from granary.operators import entities as E
from granary.operators import evaluation as V
from granary.operators import linking as L
from granary.operators import quality as Q
from granary.operators import retrieval as R
from granary.operators import telemetry as TL
from granary.schemas import cleaned
from granary.sources import models as M
from granary.sources import readers as S
from granary.sources import sinks


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {k}" for n, k in zip(names, ["string"] * len(names), strict=True))).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "key,want",
    [("Q734", ["q734"]), ("Q58(4)", ["q58"]), ("91.5 kg", ["91.5", "91.5kg"]), ("7 V", ["7v"]), ("3.25 m/s", ["3.25", "3.25m", "3.25m/s"]), ("from 5 to 140°C", ["140", "140°c"])],
)
def test_anchors(spark, key, want):
    assert one(spark, X.anchors(F.col("k")), k=key) == want


@pytest.mark.parametrize("key", ["0", "7", "64"])
def test_keys_that_tell_nothing(spark, key):
    assert one(spark, X.verifiable(F.col("k")), k=key) is False
    assert one(spark, X.answer_present(F.col("k"), F.array("t")), k=key, t="64") is None


def test_presence(spark):
    present = lambda k, t: one(spark, X.answer_present(F.col("k"), F.array("t")), k=k, t=t)
    assert present("7 V", "fed with 7V direct") is True and present("Q734", "Q735") is False
    assert present("4,75 m/s", "column | 4.75 | end") is True and present("tighten coupling", "then tighten the coupling") is True


@pytest.mark.parametrize(
    "text,want", [("V 110/190 Hz 60 A 5.25/4.75", {"110V", "190V", "60Hz", "5.25A", "4.75A"}), ("Breaker 16A 10mA", {"16A", "10mA"}), ("9 kW 110/190 Vca", {"9kW", "110Vca", "190Vca"})]
)
def test_magnitudes(spark, text, want):
    assert set(one(spark, X.magnitudes(F.col("t")), t=text)) == want


def test_disputed_and_unsupported(spark):
    assert one(spark, X.disputed(F.col("a"), F.col("b")), a="A 8.25 V 110", b="A 8.5 V 110") == ["8.25A", "8.5A"]
    assert one(spark, X.unsupported(F.col("a"), F.col("b")), a="190V", b="V 110 / 190") is False and one(spark, X.unsupported(F.col("a"), F.col("b")), a="191V", b="V 110/190") is True


def test_json_is_salvaged(spark):
    get = lambda t: one(spark, X.salvaged_json(F.col("t")), t=t)
    assert get('```json\n{"a": 1}\n```') == '{"a":1}' and get('Sure: {"a": [1]} ok') == '{"a":[1]}' and get("none") is None


def test_equal_questions(spark):
    n = lambda t: one(spark, X.normalised_question(F.col("t")), t=t)
    assert n("¿Dónde está la  Q734?") == n("donde esta la q734") != n("donde esta la q735")
    assert n("ﬁne ½ Ⅳ Ǻ ｆｕｌｌ ⅲ x\u0301 Ệ") == "fine 1 2 iv a full iii x e"


def test_letters_are_decomposed_as_the_standard_says(spark):
    import unicodedata

    chars = [chr(c) for c in range(0xA0, 0x10000) if not 0xAC00 <= c <= 0xD7A3 and not 0xD800 <= c <= 0xDFFF and chr(c).lower() == chr(c) and unicodedata.category(chr(c))[0] in "LN"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    for r in df.select("c", X.unaccented(F.col("c")).alias("x")).collect():
        want = "".join(x for x in unicodedata.normalize("NFKD", r.c) if not unicodedata.combining(x)).lower()
        assert r.x == want or r.x == r.c.lower() == want, (r.c, r.x, want)


def test_refusals(spark):
    r = lambda t: one(spark, V.is_refusal(F.col("t")), t=t)
    assert r("I don't know") and r("") and r("none.") and not r("The motor is M1 and runs at 50 Hz")


def test_index_grid(spark):
    grid = [["a", "Q734", "b", "Q735", ""], ["c", "Q736", "d", "Q737", ""], ["e", "Q741", "f", "Q742", ""], ["g", "Q743", "h", "Q744", ""]]
    df = spark.createDataFrame([(grid,)], "rows array<array<string>>")
    r = df.select(T.parameter_pairs(F.col("rows")).alias("p"), T.is_index_table(F.col("rows")).alias("i"), T.needs_split(F.col("rows"), F.lit("")).alias("n")).first()
    assert [x["code"] for x in r["p"]] == ["Q734", "Q735", "Q736", "Q737", "Q741", "Q742", "Q743", "Q744"] and r["i"] and r["n"]


def test_fault_table(spark):
    head, rows = ["Code", "Cause"], [[c, "x"] for c in ("E51", "E52", "E60", "E64", "E65", "E71")]
    df = spark.createDataFrame([([head, *rows],), ([head, *rows[:3]],), ([head, ["cause", "E1"], ["other", "E2"]],)], "rows array<array<string>>")
    assert [r["x"] for r in df.select(T.needs_split(F.col("rows"), F.lit("")).alias("x")).collect()] == [True, False, False]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, file_name string, text string, has_media boolean, dense_similarity double, bm25_rank int, quality double, question string, arrival long")


def test_containment(spark):
    long = "the motor turns the pump in the hall"
    c = candidates(spark, [(1, 1, "f", "turns the pump", False, 0.95, None, 0.9, None, 1), (1, 2, "f", long, False, 0.6, None, 0.6, None, 2), (1, 3, "f", "pump", True, 0.5, None, 0.5, None, 3), (1, 4, "g", "pump", False, 0.5, None, 0.5, None, 4)])
    assert {(r.doc_id, r.dense_similarity) for r in R.without_contained(c).collect()} == {(2, 0.95), (3, 0.5), (4, 0.5)}


def test_marked_context_is_no_content(spark):
    a = "[CONTEXTO PREVIO]\nalpha beta\n\n[CHUNK RELEVANTE]\ngamma\n\n[CONTEXTO SIGUIENTE]\ndelta"
    c = candidates(spark, [(1, 1, "f", a, False, 0.9, None, 0.9, None, 1), (1, 2, "f", "gamma rays", False, 0.6, None, 0.6, None, 2)])
    assert {r.doc_id for r in R.without_contained(c).collect()} == {2}


def test_collapse(spark):
    c = candidates(spark, [(1, 1, "f", "", False, 0.9, None, 0.9, "q1", 1), (1, 2, "f", "", True, 0.5, 3, 0.5, None, 2), (1, 3, "f", "", False, 0.7, None, 0.9, "q2", 3), (1, 4, "f", "", False, 0.7, None, 0.9, "q1", 4)])
    r = R.collapsed(c, F.col("file_name")).first()
    assert (r.doc_id, r.dense_similarity, r.bm25_rank, r.arrival, r.questions) == (2, 0.9, 3, 1, ["q1", "q2"])


def test_facet_base(spark):
    b = lambda t: one(spark, R.facet_base(F.col("t")), t=t)
    assert b("chunk_3_visual") == "chunk_3" and b("chunk_3_table_part2") is None


def test_quota_keeps_merit_and_invents_nothing(spark):
    rows = [(1, i, "dom", "", False, 1 - i / 100, None, None, None, i) for i in range(10)] + [(1, 20, "o1", "", False, 0.3, None, None, None, 20)]
    got = {r.doc_id for r in R.other_document_quota(candidates(spark, rows), 10, 2).collect()}
    assert got == {*range(9), 20}
    assert R.other_document_quota(candidates(spark, rows[:5]), 10, 2).count() == 5


def test_gates_without_any_similarity(spark):
    c = candidates(spark, [(1, 1, "f", "", False, None, 1, None, None, 1), (1, 2, "f", "", False, 0.4, None, None, None, 2)])
    assert R.gate_absolute(c, sparse=True).count() == 0 and R.gate_relative(c).count() == 2


def test_neighbours_skip_their_own_figure(spark):
    rows = [("p7_chunk_1", 1, None), ("p7_chunk_2_visual", 2, "fig"), ("p7_chunk_2_ocr", 3, "fig"), ("p8_chunk_1", 4, None)]
    df = spark.createDataFrame([("d", *r) for r in rows], "file_name string, id string, n int, fig string")
    got = {r.id: (r.prev_id, r.next_id) for r in L.linked_neighbours(df, "file_name", "n", "fig").collect()}
    assert got["p7_chunk_2_visual"] == got["p7_chunk_2_ocr"] == ("p7_chunk_1", "p8_chunk_1") and got["p7_chunk_1"][0] == ""


def test_codes_and_pages(spark):
    assert one(spark, L.code_range(F.col("t")), t="KX07–KX09") == ["KX07", "KX08", "KX09"] and one(spark, L.code_range(F.col("t")), t="M1") == ["M1"]
    assert one(spark, L.page_numbers(F.col("t")), t="34-33") == [33, 34]
    assert [tuple(e) for e in one(spark, L.chain_edges(F.col("t")), t="A → B ↔ C")] == [("A", "B", False), ("B", "C", True)]


def test_chains_of_similar_chunks(spark):
    base = "the pump of the second line has to be checked every week by the operator on duty"
    near, far = base.replace("week", "month"), "something else that is not like it at all, and long enough"
    rows = [(1, "f", 1, "text", base), (2, "f", 2, "text", near), (3, "f", 3, "text", base), (4, "f", 4, "table", near), (5, "f", 5, "text", far), (6, "f", 6, "text", base + " 5")]
    got = {r.id: (r.kept, r.reason) for r in C.fuzzy_dedup(spark.createDataFrame(rows, "id long, file_name string, ordinal int, content_type string, text string")).collect()}
    assert got[1] == (True, "unique") and got[2] == (False, "similarity") and got[3] == (False, "duplicate") and got[4][0] and got[5][0] and got[6][0]


def test_splitter_keeps_all_words_and_sizes():
    text = "\n\n".join(f"Paragraph {i} " + "word " * (i * 7) for i in range(60))
    parts = C.split_text(text, 300, 60)
    assert all(len(p) <= 300 for p in parts) and set(text.split()) == set(" ".join(parts).split())
    assert C.split_text("short") == ["short"] and C.split_text("x" * 2500, 1000, 0) == ["x" * 1000, "x" * 1000, "x" * 500]


def test_superchunks(spark):
    rows = [("f", 0, i, f"c{i}", i, "x" * 1400) for i in range(5)] + [("f", 1, 9, "c9", 9, "y")]
    got = {r.chunk_id: r.members for r in C.superchunks(spark.createDataFrame(rows, "file_name string, group int, ordinal int, chunk_id string, page int, text string")).collect()}
    assert got == {"superchunk_0_part1": ["c0", "c1"], "superchunk_0_part2": ["c2", "c3"]}


def test_outside_brackets_and_labels():
    assert C.split_outside("a (b, c), d") == ["a (b, c)", "d"]
    assert C.labelled_fields("Type: x\nmore\nParts: y", ["Type", "Parts"]) == {"Type": "x\nmore", "Parts": "y"}


def test_resolver_levels_and_borders(spark):
    a = spark.createDataFrame([("W1", "W1", "code"), ("KLEO", "Z05", "specific"), ("válvula", "Y02", "weak"), ("Y02", "Y02", "code"), ("rack 4 x 6", "U09", "specific")], "term string, code string, level string")
    t = spark.createDataFrame([(1, "W12 and KLEO-X3"), (2, "La Válvula Y02"), (3, "Rack 4 x 6 mm; crack 4 x 6"), (4, None)], "id long, text string")
    assert {tuple(r) for r in E.resolved(t, a).collect()} == {(1, "Z05", "specific"), (2, "Y02", "code"), (3, "U09", "specific")}


def test_paths_are_simple_and_short(spark):
    e = spark.createDataFrame([("A", "B", False), ("B", "C", True), ("C", "D", False), ("A", "D", False), ("D", "A", False)], "origin string, target string, both boolean")
    p = spark.createDataFrame([("A", "D"), ("D", "B")], "origin string, target string")
    got = [(r.origin, r.path) for r in E.paths(e, p).orderBy("origin", "n").collect()]
    assert got == [("A", ["A", "D"]), ("A", ["A", "B", "C", "D"]), ("D", ["D", "A", "B"])]


def test_gold_pages_of_ranges(spark):
    r = spark.createDataFrame([(1, 1, "f", "8-11"), (1, 2, "f", "9"), (2, 1, "f", "10")], "item_id long, position int, file_name string, page_num string")
    i = spark.createDataFrame([(1, "f", ["9"]), (2, "g", ["10"]), (3, "f", ["8"])], "item_id long, gold_file string, gold_pages array<string>")
    assert {x.item_id: x.rank for x in V.gold_rank(r, i).collect()} == {1: 2, 2: None, 3: None}


def test_verdicts_and_runs(spark):
    e = spark.createDataFrame([("a", 1, "keep", "t"), ("a", 2, None, None), ("b", 1, "discard", "t"), ("b", 3, None, "")], "k string, ts int, verdict string, revised_text string")
    assert {r.k: (r.verdict, r.revised_text) for r in V.verdicts(e, ["k"]).collect()} == {"a": ("keep", "t"), "b": ("discard", None)}
    d = spark.createDataFrame([("x", 1, "approved"), ("y", 1, "rejected"), ("z", 5, "approved")], "k string, ts int, state string")
    c = spark.createDataFrame([("x", 2), ("y", 2), ("z", 2)], "k string, ts int")
    assert {r.k: r.state for r in V.run_states(d, c, ["k"]).collect()} == {"x": "pending", "y": "rejected", "z": "approved"}


@pytest.mark.parametrize("sql", ["", "DELETE FROM x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "select * from x where drop = 1"])
def test_guard_refuses(sql):
    with pytest.raises(ValueError):
        TL.guarded(sql)


def test_guard_allows_words_inside_words(spark):
    assert TL.guarded("SELECT created_at, updates FROM t ;") == "SELECT created_at, updates FROM t"
    assert TL.query(spark, "SELECT repeat('x', 900) AS s, id FROM range(600)").agg(F.count("*"), F.max(F.length("s"))).first()[:] == (500, 500)


def test_validator(spark):
    rows = [("x" * 60, "text", None), ("a", "table", None), ("a", "text", None), ("-" * 60, "text", None), ("x" * 60, "text", "0.1"), (None, "text", None), ("x" * 9000, "text", "alta")]
    got = [r.reason for r in Q.validated(spark.createDataFrame(rows, "original_chunk string, content_type string, confidence string"), threshold=0.3).collect()]
    assert got == ["valid", "valid", "too_short", "no_alphanumeric", "low_confidence", "missing_original_chunk", "too_long"]


def test_legibility(spark):
    ok = lambda t: one(spark, X.legible(F.col("t")), t=t)
    assert ok("Figura 3: esquema de conexionado") and not ok("x1 ~ || L2 -- a b") and not ok("word 1 word 2 word")


def test_sentinels(spark):
    df = spark.createDataFrame([("nan", float("nan")), (" None ", 1.0), ("x", 2.0)], "a string, b double")
    assert [tuple(r) for r in cleaned(df).collect()] == [(None, None), (None, 1.0), ("x", 2.0)]


def test_files_runs_and_sinks(spark, tmp_path):
    for name in ("a/01_Manual rev2.py", "a/old/x.py", "a/b.txt", "a/Manual.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b'"""Doc."""\nx = "\xe9"\n\ndef f():\n    return 1\n' if "rev2" in name else b"def g(:")
    files = S.corpus(spark, f"file://{tmp_path}/a")
    assert {r.name for r in files.collect()} == {"01_Manual rev2.py", "Manual.py"}
    logical, revision = S.logical_name(F.col("stem"))
    assert {(r.stem, r.superseded_by) for r in S.superseded(files.select("stem", logical.alias("logical"), revision.alias("revision"))).collect()} == {("01_Manual rev2", None), ("Manual", "01_Manual rev2")}
    got = S.program_chunks(files).collect()
    assert {(r.stem, r.kind) for r in got} == {("01_Manual rev2", "summary"), ("01_Manual rev2", "code"), ("Manual", "code")}
    crops = tmp_path / "j/crops"
    crops.mkdir(parents=True)
    (tmp_path / "j/p10.json").write_text('[{"page_num": "10", "chunk_id": "c1"}]')
    (tmp_path / "j/p2.json").write_text('[{"page_num": "2", "chunk_id": "c2"}, {"page_num": "2", "chunk_id": "c1"}]')
    (tmp_path / "j/p3.json").write_text('{"page_num": "3", "chunk_id": "c1"}')
    (crops / "x.json").write_text("{}")
    assert [(r.page_num, r.chunk_id) for r in S.chunk_files(spark, f"file://{tmp_path}/j").collect()] == [("2", "c1"), ("2", "c2"), ("3", "c1"), ("10", "c1")]
    df = spark.range(3).selectExpr("id", "id % 2 AS k")
    sinks.json_report(df, f"file://{tmp_path}/r")
    sinks.csv_export(df, f"file://{tmp_path}/c")
    sinks.replace_partitions(df, f"file://{tmp_path}/p", "k")
    sinks.replace_partitions(df.where("k = 1").withColumn("id", F.lit(7).cast("long")), f"file://{tmp_path}/p", "k")
    sinks.append(df.select("id"), f"file://{tmp_path}/q")
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/p").collect()) == [0, 2, 7]
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == spark.read.text(f"file://{tmp_path}/r").count() == 3


def test_retries():
    waits, calls = [], []

    def flaky(items):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return items

    assert M.with_retries(flaky, sleep=waits.append)(["a"]) == ["a"] and len(waits) == 2

    def spent(items):
        raise M.QuotaError

    with pytest.raises(M.QuotaError):
        M.with_retries(spent, sleep=waits.append)(["a"])
    assert len(waits) == 2


def test_stream_counts_repeated_events_once(spark, tmp_path):
    from granary.streaming import telemetry as ST

    rows = spark.range(10).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    rows.union(rows).write.parquet(f"file://{tmp_path}/in")
    q = ST.windowed(ST.events(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT max(n) FROM windows").first()[0] == 10


def test_rest_without_optional_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "granary").rglob("*.py"):
        if "llm" not in p.parts:
            assert "granary.llm" not in p.read_text() and "from .llm" not in p.read_text(), p


def test_boxes_and_images(spark):
    import numpy as np

    from granary.functions import images as I

    box = [0.2, 0.2, 0.5, 0.5]
    texts = [[[0.3, 0.45, 0.5, 0.55]], [[0.2, 0.5, 0.5, 0.8]], [], [[0.3, 0.45, 0.5, 0.55], [0.0, 0.3, 0.22, 0.35]], [[0.0, 0.0, 0.9, 0.49]]]
    f = spark.createDataFrame([(i, box, t) for i, t in enumerate(texts)], "i int, b array<double>, t array<array<double>>")
    got = {r.i: r.x for r in f.select("i", I.fitted(F.col("b"), F.col("t")).alias("x")).collect()}
    assert got[0][3] == pytest.approx(0.55)  # mostly inside: taken in
    assert got[1][3] == pytest.approx(0.5)  # touched: left out
    assert got[2] == got[4] == pytest.approx([0.17, 0.17, 0.53, 0.53])  # nothing near; too little would stay
    assert got[3] == pytest.approx([0.22, 0.17, 0.53, 0.55])  # one taken in, one left out
    page = np.full((60, 80), 255.0)
    page[20:30, 40:55] = np.random.default_rng(0).integers(0, 255, (10, 15))
    assert I.located(page, page[18:32, 38:58]) == (38, 18) and I.located(page, np.full((5, 5), 255.0)) is None
    blank, drawn = bytes([255] * 4800), page.astype(np.uint8).tobytes()
    df = spark.createDataFrame([(0, bytearray(blank)), (1, bytearray(drawn))], "i int, c binary")
    r = {x.i: x for x in df.select("i", I.ink_ratio("c", F.lit(80), F.lit(60)).alias("ink"), I.content_box("c", F.lit(80), F.lit(60)).alias("box")).collect()}
    assert r[0].ink < I.LEAST_INK < r[1].ink and r[0].box is None and r[1].box == [40, 20, 55, 30]


def test_overrides():
    assert V.overrides("a=false, b=.35,c=x,d=7") == {"a": False, "b": 0.35, "c": "x", "d": 7} and V.overrides("") == {}
    with pytest.raises(ValueError):
        V.overrides("a")


def test_media_paths_of_all_documents(spark, tmp_path):
    from granary.plans.ingestion import query

    rows = [(1, "a", "x"), (6000, "a", "x"), (59_999, "a", "x"), (60_000, "a", "x"), (600_000, "a", "x")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.path.split("/")[1] for r in query.queries["media_paths"](spark, str(tmp_path)).collect()}
    assert got == {1: "page_000", 6000: "page_100", 59_999: "page_999", 60_000: "page_1000", 600_000: "page_10000"}
