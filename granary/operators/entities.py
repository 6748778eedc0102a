"""Entities and graphs: resolver of names, code normaliser, edges with precedence, neighbourhoods and paths (O-81 to O-88, O-106, O-141,
O-155 to O-159, O-162)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import unaccented

LEVELS = {"code": 1, "specific": 2, "weak": 3}
CONFIDENCE = {"alta": 1, "media": 2, "baja": 3}
#: An alias table of more rows is not broadcast.
MOST_ALIASES = 20_000


def resolved(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, code, level of the components that each text names: a term stands in the plain text, not inside a word (O-81). A component
    of a stronger level has no weaker one. aliases: term, code, level. Terms of one word, which are most, are joined to the words of
    the texts by equality; only the others are tried on each text."""
    a = aliases.select(F.trim(unaccented(F.col("term"))).alias("term"), "code", "level").where(F.length("term") >= 2).distinct()
    t = texts.select("id", unaccented(F.col("text")).alias("plain"))
    single = a.where(F.col("term").rlike(r"^\w+$"))
    words = t.select("id", F.explode(F.array_distinct(F.regexp_extract_all("plain", F.lit(r"(?U)\w+"), 0))).alias("term"))
    hits = words.join(single, "term").select("id", "code", "level")
    several = a.where(~F.col("term").rlike(r"^\w+$"))
    if several.limit(MOST_ALIASES + 1).count() <= MOST_ALIASES:
        several = F.broadcast(several)
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("term"), F.lit(r"\E(?!\w)"))
    more = t.join(several, F.contains("plain", "term") & F.regexp_like("plain", pattern)).select("id", "code", "level")
    order = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in LEVELS.items()])
    found = hits.unionByName(more).groupBy("id", "code").agg(F.min_by("level", order).alias("level"))
    return found


def tags(texts: DataFrame, aliases: DataFrame, documented: DataFrame | None = None) -> DataFrame:
    """id, codes: what a text asserts, by its code or a specific name (O-83); without what its document is about as a whole."""
    found = resolved(texts, aliases).where("level <> 'weak'")
    if documented is not None:
        found = found.join(texts.select("id", "file_name"), "id").join(documented, ["file_name", "code"], "left_anti")
    return found.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def roots(text: Column) -> Column:
    """Words of four letters or more, cut to their first four letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(unaccented(text), F.lit("[a-z]{4,}"), 0), lambda w: F.substring(w, 1, 4)))


def normalised_codes(mentions: DataFrame, components: DataFrame) -> DataFrame:
    """The code that a mention means: the longest one that stands in it, else the component that shares most roots, of ties the one
    that shares most of its name; a single shared root only where no other component shares any as well; else null (O-82)."""
    c = components.select("code", "name", roots(F.col("name")).alias("roots"))
    words = mentions.select("id", F.explode(F.regexp_extract_all(F.upper("mention"), F.lit(r"[A-Z]+\d+"), 0)).alias("code"))
    literal = words.join(c.select("code"), "code").groupBy("id").agg(F.max_by("code", F.struct(F.length("code"), "code")).alias("literal"))
    m = mentions.select("id", F.explode(roots(F.col("mention"))).alias("root"))
    k = c.select("code", F.size("roots").alias("n_roots"), F.explode("roots").alias("root"))
    shared = m.join(k, "root").groupBy("id", "code", "n_roots").agg(F.count("*").alias("common"))
    w = Window.partitionBy("id").orderBy(F.desc("common"), F.asc("n_roots"), F.asc("code"))
    best = shared.withColumn("__n", F.row_number().over(w)).withColumn("__of", F.count("*").over(Window.partitionBy("id"))).where("__n = 1").where("common > 1 OR __of = 1")
    return mentions.select("id").distinct().join(literal, "id", "left").join(best.select("id", F.col("code").alias("scored")), "id", "left").select("id", F.coalesce("literal", "scored").alias("code"))


def conflicts(proposed: DataFrame, declared: DataFrame) -> DataFrame:
    """Each proposed edge against the declared ones: same, reversed or none (O-84)."""
    d = declared.select("origin", "target").distinct()
    same, back = d.withColumn("__s", F.lit(True)), d.select(F.col("origin").alias("target"), F.col("target").alias("origin"), F.lit(True).alias("__b"))
    j = proposed.join(same, ["origin", "target"], "left").join(back, ["origin", "target"], "left")
    return j.withColumn("conflict", F.when(F.col("__s"), "same").when(F.col("__b"), "reversed").otherwise("none")).drop("__s", "__b")


def merged_edges(reviewed: DataFrame, inventory: DataFrame, extracted: DataFrame) -> DataFrame:
    """Edges by precedence: confirmed ones of the review, those of the inventory that were not discarded, extracted ones of pairs that
    neither has decided, in either direction (O-85)."""
    pair = F.concat_ws("|", F.least("origin", "target"), F.greatest("origin", "target"))
    yes = reviewed.where("state = 'confirmed'").select("origin", "target", F.lit("review").alias("source"))
    inv = inventory.join(reviewed.select("origin", "target"), ["origin", "target"], "left_anti").select("origin", "target", F.lit("inventory").alias("source"))
    decided = reviewed.select("origin", "target").unionByName(inventory.select("origin", "target")).select(pair.alias("pair")).distinct()
    ext = extracted.withColumn("pair", pair).join(decided, "pair", "left_anti").select("origin", "target", F.lit("extracted").alias("source"))
    return yes.unionByName(inv).unionByName(ext).distinct()


def best_of_pairs(edges: DataFrame) -> DataFrame:
    """The most confident edge of each pair (O-141)."""
    order = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE.items()], F.lit(9))
    return edges.groupBy("origin", "target").agg(F.min_by("confidence", order).alias("confidence"))


def inverted(records: DataFrame) -> DataFrame:
    """code, records that name it (O-86). records: record, codes (array)."""
    return records.select("record", F.explode("codes").alias("code")).groupBy("code").agg(F.array_sort(F.collect_set("record")).alias("records"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("origin", "target").unionByName(edges.where("both").select(F.col("target").alias("origin"), F.col("origin").alias("target"))).distinct()


def neighbourhood(edges: DataFrame) -> DataFrame:
    """node, neighbour, direction: out, in or both (O-156)."""
    one = edges.where("NOT both")
    parts = [
        one.select(F.col("origin").alias("node"), F.col("target").alias("neighbour"), F.lit("out").alias("direction")),
        one.select(F.col("target").alias("node"), F.col("origin").alias("neighbour"), F.lit("in").alias("direction")),
        edges.where("both").select(F.col("origin").alias("node"), F.col("target").alias("neighbour"), F.lit("both").alias("direction")),
        edges.where("both").select(F.col("target").alias("node"), F.col("origin").alias("neighbour"), F.lit("both").alias("direction")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def paths(edges: DataFrame, pairs: DataFrame, hops: int = 4, most: int = 3) -> DataFrame:
    """The shortest simple paths of each pair (origin, target), at most hops edges and most paths; ties by their nodes (O-157). Each hop
    is a join by node; a path ends at its target and never meets a node twice."""
    step = both_ways(edges).select(F.col("origin").alias("__at"), F.col("target").alias("__to"))
    live = pairs.select("origin", "target", F.array("origin").alias("path"))
    done = []
    for _ in range(hops):
        grown = live.join(step, F.element_at("path", -1) == F.col("__at")).where(~F.array_contains("path", F.col("__to"))).withColumn("path", F.concat("path", F.array("__to"))).drop("__at", "__to")
        done.append(grown.where(F.element_at("path", -1) == F.col("target")))
        live = grown.where(F.element_at("path", -1) != F.col("target"))
    w = Window.partitionBy("origin", "target").orderBy(F.size("path"), "path")
    return reduce(DataFrame.unionByName, done).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def path_pairs(codes: DataFrame) -> DataFrame:
    """All ordered pairs of different codes that one question names (O-159). codes: query_id, code; a question's few codes."""
    return codes.select("query_id", F.col("code").alias("origin")).join(codes.select("query_id", F.col("code").alias("target")), "query_id").where("origin <> target")


def open_discrepancies(found: DataFrame, most: int = 2) -> DataFrame:
    """The first unresolved discrepancies of each component (O-158). found: id, components (array), state."""
    rows = found.where("state <> 'resolved'").select("id", F.explode("components").alias("code"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= most)


def glossary(components: DataFrame) -> DataFrame:
    """The glossary as lines of text for a prompt, by system (O-155)."""
    line = F.concat(F.lit("- "), F.col("code"), F.lit(": "), F.col("name"))
    return components.groupBy("system").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("glossary"))


def current_files(indexed: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of each indexed file: superseded, unknown or current (O-87)."""
    m = manifest.select("file_name", "current")
    return indexed.select("file_name").distinct().join(m, "file_name", "left").withColumn("state", F.when(F.col("current").isNull(), "unknown").when(~F.col("current"), "superseded").otherwise("current")).drop("current")


def purged(rows: DataFrame, blank: DataFrame) -> DataFrame:
    """Rows without blank figures and without the questions about them (O-88). blank: file_name, page_num, chunk_id."""
    keys = ["file_name", "page_num"]
    own = rows.join(blank, [*keys, "chunk_id"], "left_anti")
    return own.join(blank.withColumnRenamed("chunk_id", "parent_chunk_id"), [*keys, "parent_chunk_id"], "left_anti")


def proposals(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known edges and those new ones whose key is not known; reviewed ones stay as they are (O-162)."""
    fresh = new.dropDuplicates(["origin", "target"]).join(known.select("origin", "target"), ["origin", "target"], "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)
