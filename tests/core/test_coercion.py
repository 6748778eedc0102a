"""Coercion of texts to numbers against the SQL in DuckDB, on texts that the test tables have few of or none."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from granary import catalog
from granary.functions import text as X

duckdb = pytest.importorskip("duckdb")
ALPHABET = " \t\n\v\0\x1c\x7f\u0085  ٣é" + "+-._" + "01259" + "eExXbBaFdfgL"
LONG = (
    "1_000.5 1.5_5 1e1_0 1e0_1 1e-1 5e-1 4e-1 -5e-1 15e-1 1.5e3 1.45e1 1e+2 -0x1 +0x1 0x_1 0x1_0 0x1F 0xFFFFFFFF 0x7FFFFFFF 0x0000000000000000001F 0xFFFFFFFFFFFFFFFFF -0b1 0b101 0b1_0 "
    "0b1111111111111111111111111111111 0b11111111111111111111111111111111 0o7 .e1 1.e1 .5e1 1._5 1__0 2147483647 2147483648 -2147483648 -2147483649 2147483647.4 2147483647.5 00x1 0_x1 1.5.5 1e1.5"
).split() + ["  12.5\n", " 0x1F", "0x1F ", "12.5 ", "1 2", "1" + "0" * 30, "0" * 40 + "7"]


def write(con, path, texts):
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents SELECT unnest(range(len($1))), unnest($1)", [texts])
    con.execute(f"COPY documents TO '{path}' (FORMAT parquet)")


def test_estimated_tokens_on_short_texts(spark, tmp_path):
    texts = ["".join(p) for n in range(4) for p in product(ALPHABET, repeat=n)] + [None, "56. Rest", "1.5 Rest", "0x1F", "123456", "12.́ é\U0001f600"]
    con = duckdb.connect()
    write(con, tmp_path / "documents.parquet", texts)
    want = con.execute(catalog.ORACLES["estimated_tokens"]).fetchall()
    found = {r.doc_id: r for r in catalog.QUERIES["estimated_tokens"](spark, str(tmp_path)).collect()}
    assert len(found) == len(want) == len(texts)
    assert [(texts[i], *w) for i, *w in want if [found[i].tokens, found[i].coerced] != w] == []


def test_whole_number_of_longer_texts(spark, tmp_path):
    con = duckdb.connect()
    write(con, tmp_path / "documents.parquet", LONG)
    want = dict(con.execute("SELECT text, try_cast(text AS INT) FROM documents").fetchall())
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.text: r.x for r in d.select("text", X.whole_number(F.col("text")).alias("x")).collect()} == want
