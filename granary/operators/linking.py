"""Order, neighbours, hierarchy, groups and structure of chunks (O-05, O-06, O-11, O-36 to O-39, O-52, O-53, O-101, O-123, O-124,
O-130, O-131, O-137 to O-141)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROCEDURE = r"(?i)\b(?:step|paso|procedure|procedimiento)\b"


def natural_key(page: Column, chunk_id: Column) -> Column:
    """Key that sorts pages by number and ids by text parts and numbers: numbers sort after texts at the same place (O-124)."""
    start = F.coalesce(F.regexp_extract(F.coalesce(page, F.lit("")), r"^\s*(\d+)", 1).try_cast("long"), F.lit(0))
    parts = F.filter(F.regexp_extract_all(F.coalesce(chunk_id, F.lit("")), F.lit(r"\d+|\D+"), 0), lambda p: p != "")
    keyed = F.transform(parts, lambda p: F.struct(p.rlike(r"^\d+$").cast("int").alias("kind"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("number"), F.when(p.rlike(r"^\d+$"), "").otherwise(p).alias("text")))
    return F.struct(start.alias("page"), keyed.alias("parts"))


def linked_neighbours(chunks: DataFrame, file: str, order: str, group: str | None = None) -> DataFrame:
    """prev_id and next_id of each chunk, "" at the ends; the facets of one figure are one place, so none is its sibling's neighbour
    (O-123). chunks: id. Rows of a place are a run of equal group; a null group is a place of its own."""
    w = Window.partitionBy(file).orderBy(order)
    g = F.col(group) if group else F.lit(None)
    rows = chunks.withColumn("__new", F.coalesce((g != F.lag(g).over(w)).cast("int"), F.lit(1))).withColumn("__place", F.sum("__new").over(w))
    ends = rows.groupBy(file, "__place").agg(F.min_by("id", order).alias("__first"), F.max_by("id", order).alias("__last"))
    p = Window.partitionBy(file).orderBy("__place")
    ends = ends.select(file, "__place", F.coalesce(F.lag("__last").over(p), F.lit("")).alias("prev_id"), F.coalesce(F.lead("__first").over(p), F.lit("")).alias("next_id"))
    return rows.join(ends, [file, "__place"]).drop("__new", "__place")


def filled_hierarchy(rows: DataFrame, file: str, page: str, section: str) -> DataFrame:
    """The section of each page, or of the nearest earlier one that has any (O-52)."""
    w = Window.partitionBy(file).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled_section", F.last(section, ignorenulls=True).over(w))


def islands(rows: DataFrame, file: str, order: str, gap: int) -> DataFrame:
    """Number of the group of each row: a new one begins where the order's gap to the row before is over gap (O-11)."""
    w = Window.partitionBy(file).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def attached_above(images: DataFrame, blocks: DataFrame, file: str, row: str) -> DataFrame:
    """Each image with the last block above its row (O-11): an as-of fill over the union of both, one pass and no range join."""
    both = blocks.select(file, row, F.col("block_id"), F.lit(None).cast("string").alias("image_id")).unionByName(images.select(file, row, F.lit(None).cast("string").alias("block_id"), "image_id"))
    w = Window.partitionBy(file).orderBy(row, F.col("image_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("block_id", F.last("block_id", ignorenulls=True).over(w)).where("image_id IS NOT NULL")


def procedure_runs(rows: DataFrame, file: str, order: str, text: str, least: int = 2) -> DataFrame:
    """Runs of at least so many consecutive procedure chunks: file, first, last, n (O-130)."""
    w = Window.partitionBy(file).orderBy(order)
    r = rows.withColumn("__p", F.col(text).rlike(PROCEDURE)).withColumn("__n", F.row_number().over(w))
    r = r.where("__p").withColumn("__run", F.col("__n") - F.row_number().over(w))
    return r.groupBy(file, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__run")


def stratified(rows: DataFrame, strata: list[str], quota: int, seed: int = 0) -> DataFrame:
    """quota rows of each stratum, in the order of a hash of their id (O-131)."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))), "id")
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= quota)


def newest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows; older ones are evicted (O-137)."""
    return rows.orderBy(F.desc(by), "id").limit(n)


def exploded_questions(chunks: DataFrame, normal: Column) -> DataFrame:
    """One row for each distinct question, of the first chunk that asks it (O-36). chunks: id, order, questions, flagged."""
    q = chunks.where("NOT flagged").select("id", "order", F.posexplode("questions").alias("at", "question"))
    keyed = q.withColumn("norm", normal).where("norm <> ''")
    return keyed.groupBy("norm").agg(F.min_by(F.struct("id", "question"), F.struct("order", "at")).alias("w")).select(F.col("w.id").alias("id"), F.col("w.question").alias("question"), "norm")


def code_range(text: Column, most: int = 50) -> Column:
    """SSR01–SSR03 as its codes with their zeros; one code alone; none where the range is longer than most or turned (O-37)."""
    at = lambda i: F.regexp_extract(text, r"^\s*([A-Za-z]+)(\d+)\s*[-–]\s*(?:[A-Za-z]+)?(\d+)\s*$", i)
    a, b = at(2).try_cast("int"), at(3).try_cast("int")
    many = F.transform(F.sequence(a, b), lambda n: F.concat(at(1), F.lpad(n.cast("string"), F.length(at(2)), F.lit("0"))))
    return F.when((at(1) != "") & (b >= a) & (b - a < most), many).when(at(1) == "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))


def chain_edges(chain: Column) -> Column:
    """origin, target, both of each step of A → B ↔ C (O-38)."""
    nodes = F.transform(F.split(chain, "[→↔]"), lambda x: F.trim(x))
    arrows = F.regexp_extract_all(chain, F.lit("[→↔]"), 0)
    return F.transform(arrows, lambda a, i: F.struct(F.get(nodes, i).alias("origin"), F.get(nodes, i + 1).alias("target"), (a == "↔").alias("both")))


def page_numbers(pages: Column) -> Column:
    """Pages of "55-56" from the smaller to the larger; one page alone (O-39)."""
    a = F.split_part(pages, F.lit("-"), F.lit(1)).try_cast("int")
    b = F.coalesce(F.split_part(pages, F.lit("-"), F.lit(2)).try_cast("int"), a)
    return F.sequence(F.least(a, b), F.greatest(a, b))


def outline(rows: DataFrame, file: str, order: str, section: str, most: int = 40) -> DataFrame:
    """First distinct sections of each document in order, one a line (O-101)."""
    first = rows.where(F.length(section) > 0).groupBy(file, section).agg(F.min(order).alias("__o"))
    w = Window.partitionBy(file).orderBy("__o", section)
    top = first.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return top.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", section))), lambda x: x[section]), "\n").alias("outline"))


def corpus_union(*parts: DataFrame) -> DataFrame:
    """Parts one after the other, with the part's number (O-138)."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)), allowMissingColumns=True)
    return out


def differences(old: DataFrame, new: DataFrame, keys: list[str], text: str) -> DataFrame:
    """State of each key of two runs: new, lost, changed or same (O-80, O-140)."""
    a = old.select(*keys, F.col(text).alias("old_text"), F.lit(True).alias("__old"))
    b = new.select(*keys, F.col(text).alias("new_text"), F.lit(True).alias("__new"))
    j = a.join(b, keys, "full")
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "lost").when(F.col("old_text").eqNullSafe(F.col("new_text")), "same").otherwise("changed")
    return j.withColumn("state", state).drop("__old", "__new")


def reviewed(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Chunks without discarded ones and with revised texts (O-53). verdicts: id, verdict, revised_text."""
    kept = chunks.join(verdicts.where("verdict = 'discard'").select("id"), "id", "left_anti")
    return kept.join(verdicts.select("id", "revised_text"), "id", "left").withColumn("text", F.coalesce("revised_text", "text")).drop("revised_text")
