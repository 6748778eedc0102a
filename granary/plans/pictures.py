"""Queries of boxes and images: suppliers' balances as boxes, vectors as small gray images."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import images as I

from .inputs import read
from .registry import Registry

query = Registry()


def boxes(spark, sf):
    s = read(spark, sf, "supplier")
    x, y = (F.col("s_suppkey") % 7) / 10, (F.col("s_suppkey") % 5) / 10
    u, v = (F.col("s_suppkey") % 6) / 10, (F.col("s_suppkey") % 4) / 10
    return s.select("s_suppkey", F.array(x, y, x + 0.3, y + 0.4).alias("a"), F.array(u, v, u + 0.2, v + 0.5).alias("b"))


BOXES = "boxes AS (SELECT s_suppkey, (s_suppkey % 7) / 10 AS x, (s_suppkey % 5) / 10 AS y, (s_suppkey % 6) / 10 AS u, (s_suppkey % 4) / 10 AS v FROM supplier)"
OVERLAP = "greatest(least(x + 0.3::DOUBLE, u + 0.2::DOUBLE) - greatest(x, u), 0) * greatest(least(y + 0.4::DOUBLE, v + 0.5::DOUBLE) - greatest(y, v), 0) / greatest((u + 0.2::DOUBLE - u) * (v + 0.5::DOUBLE - v), 1e-9)"


@query(f"WITH {BOXES} SELECT s_suppkey, round({OVERLAP}, 6) AS share FROM boxes")
def box_overlap(spark, sf):
    return boxes(spark, sf).select("s_suppkey", F.round(I.overlap(F.col("a"), F.col("b")), 6).alias("share"))


@query(f"WITH {BOXES}, o AS (SELECT *, round({OVERLAP}, 9) >= 0.25 AS h FROM boxes) SELECT s_suppkey, round(CASE WHEN h THEN least(x, u) ELSE x END, 6) AS x0, round(CASE WHEN h THEN greatest(y + 0.4::DOUBLE, v + 0.5::DOUBLE) ELSE y + 0.4::DOUBLE END, 6) AS y1 FROM o WHERE abs({OVERLAP} - 0.25) > 1e-9")
def box_with_images(spark, sf):
    b = boxes(spark, sf).where(F.abs(I.overlap(F.col("a"), F.col("b")) - 0.25) > 1e-9)
    e = I.with_images(F.col("a"), F.array("b"))
    return b.select("s_suppkey", F.round(e[0], 6).alias("x0"), F.round(e[3], 6).alias("y1"))


@query()
def box_fitted(spark, sf):
    """Boxes against two text blocks each; the rule is tested against a plain version."""
    b = boxes(spark, sf)
    other = F.transform("b", lambda x: F.round(F.lit(0.9) - x, 6))
    return b.select("s_suppkey", F.transform(I.fitted(F.col("a"), F.array("b", F.array(other[2], other[3], other[0], other[1]))), lambda x: F.round(x, 6)).alias("box"))


@query()
def blank_image_ink(spark, sf):
    """Vectors as images of eight by eight pixels."""
    e = read(spark, sf, "embeddings")
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(F.round(x * 200 + 200), F.lit(0.0)), F.lit(255.0)).cast("int"))
    raw = F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    e = e.select("vec_id", raw.alias("c"))
    return e.select("vec_id", I.ink_ratio("c", F.lit(8), F.lit(8)).alias("ink"), I.content_box("c", F.lit(8), F.lit(8)).alias("box"))
