"""Sources: corpus scan, incremental skip, revisions, runs of chunk JSON, tables of spreadsheets and source code (O-01 to O-18)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that are not scanned, and suffixes that are.
SKIPPED = ["old", "descartados", "__pycache__"]
SUFFIXES = ["pdf", "xlsx", "py"]


def corpus(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """path, name, stem, content and sha256 of the files under root (O-01). The filter of suffixes is of the listing, so other files are not read."""
    glob = "*.{" + ",".join(suffixes or SUFFIXES) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(SKIPPED))
    name = F.element_at(F.split("path", "/"), -1)
    return df.where(~inside).select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "content", F.sha2("content", 256).alias("sha256"))


def unprocessed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files that the manifest does not have as done with the same content (O-02)."""
    return files if force else files.join(manifest.where("status = 'success'").select("stem", "sha256"), ["stem", "sha256"], "left_anti")


def named(files: DataFrame, parts: list[str]) -> DataFrame:
    """Files whose name has any of the parts, in any case (O-03)."""
    tests = [F.lower("name").contains(p.lower()) for p in parts]
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return files.where(out)


def logical_name(stem: Column) -> tuple[Column, Column]:
    """Name without its leading number and trailing revision, in lower case, and the revision; null without one (O-04)."""
    base = F.regexp_replace(stem, r"^\d+[_ -]+", "")
    rev = F.regexp_extract(base, r"(?i)[ _-]*(?:rev|v|r)\.?\s*(\d+(?:\.\d+)?)$", 1)
    return F.lower(F.trim(F.regexp_replace(base, r"(?i)[ _-]*(?:rev|v|r)\.?\s*\d+(?:\.\d+)?$", ""))), F.when(rev != "", rev.try_cast("double"))


def superseded(files: DataFrame) -> DataFrame:
    """Files with the revision that replaces them, if any; a file without a revision gives way to any that has one (O-05). files: stem,
    logical, revision."""
    best = files.groupBy("logical").agg(F.max("revision").alias("__best"), F.max_by("stem", "revision").alias("__by"))
    old = F.col("__best").isNotNull() & (F.col("revision").isNull() | (F.col("revision") < F.col("__best")))
    return files.join(best, "logical").withColumn("superseded_by", F.when(old, F.col("__by"))).drop("__best", "__by")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each document that has chunks (O-06, O-176). runs: document, run, n_chunks; names of runs sort by time."""
    return runs.where("n_chunks > 0").groupBy("document").agg(F.max("run").alias("run"))


def chunk_files(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of JSON files, one object or a list each, in order of page and id; crops are not read (O-07)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).where(~F.col("path").contains("/crops/"))
    text = F.trim(F.decode("content", "UTF-8"))
    fields = "file_name string, page_num string, chunk_id string, content_type string, original_chunk string, confidence string"
    one = F.when(text.startswith("["), F.from_json(text, f"array<struct<{_struct(fields)}>>")).otherwise(F.array(F.from_json(text, fields)))
    rows = raw.select("path", F.explode(one).alias("c")).select("path", "c.*")
    return rows.orderBy(F.coalesce(F.regexp_extract("page_num", r"^(\d+)", 1).try_cast("int"), F.lit(0)), "chunk_id")


def _struct(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (f.strip().split(" ") for f in ddl.split(",")))


def decoded(raw: bytes) -> str:
    """UTF-8, else the Western code page, else Latin-1 (O-13)."""
    for name in ("utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def code_cells(source: str, budget: int = 2200) -> list[tuple[str, str]]:
    """(kind, text) of a program: its summary, then cells between marker lines or top-level definitions, short neighbours together up to a
    budget; a function is never split (O-12)."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return [("code", source)]
    names = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    out = [("summary", (ast.get_docstring(tree) or "") + ("\nDefines: " + ", ".join(names) if names else ""))]
    if re.search(r"^# %%", source, re.M):
        pieces = [p for p in re.split(r"(?m)^(?=# %%)", source) if p.strip()]
    else:
        lines = source.splitlines(keepends=True)
        starts = sorted({min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in tree.body})
        bounds = [*starts, len(lines)]
        pieces = ["".join(lines[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    held = ""
    for p in pieces:
        if held and len(held) + len(p) > budget:
            out.append(("code", held))
            held = ""
        held += p
    return [*out, ("code", held)] if held.strip() else out


def program_chunks(files: DataFrame) -> DataFrame:
    """stem, position, kind, text of the chunks of Python files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = [(s, i, k, t) for s, c in zip(df["stem"], df["content"], strict=True) for i, (k, t) in enumerate(code_cells(decoded(bytes(c))))]
            yield pd.DataFrame(rows, columns=["stem", "position", "kind", "text"])

    return files.where("name LIKE '%.py'").select("stem", "content").mapInPandas(run, "stem string, position int, kind string, text string")


def sheet_parts(df: pd.DataFrame, budget: int = 1800, most: int = 40) -> pd.DataFrame:
    """Rows of one sheet in parts of a budget of characters or rows, the header with each: the header is the first row of two filled cells
    or more that two such rows follow; without one the sheet is free text (O-10)."""
    df = df.sort_values("row")
    filled = [sum(bool(str(c or "").strip()) for c in r) for r in df["cells"]]
    head = next((i for i in range(len(filled) - 2) if min(filled[i : i + 3]) >= 2), None)
    file, sheet = df["file_name"].iloc[0], df["sheet"].iloc[0]
    line = lambda cells: " | ".join(str(c or "").strip() for c in cells)
    rows = [line(c) for c in df["cells"]]
    if head is None:
        text = " — ".join(r for r, n in zip(rows, filled, strict=True) if n)
        return pd.DataFrame([(file, sheet, 0, False, text)], columns=["file_name", "sheet", "part", "tabular", "text"])
    out, held, size = [], [], 0
    for r, n in zip(rows[head + 1 :], filled[head + 1 :], strict=True):
        if not n:
            continue
        if held and (size + len(r) > budget or len(held) >= most):
            out.append(held)
            held, size = [], 0
        held.append(r)
        size += len(r)
    if held:
        out.append(held)
    return pd.DataFrame([(file, sheet, i, True, "\n".join([rows[head], *h])) for i, h in enumerate(out)], columns=["file_name", "sheet", "part", "tabular", "text"])


def sheet_chunks(cells: DataFrame) -> DataFrame:
    """Chunks of sheets given as rows: file_name, sheet, row, cells (array)."""
    return cells.groupBy("file_name", "sheet").applyInPandas(lambda df: sheet_parts(df), "file_name string, sheet string, part int, tabular boolean, text string")


def page_counters(pages: DataFrame, least: int = 20) -> DataFrame:
    """Pages of each file that have a text layer and those that recognition has to read; images seen once for each content (O-08). pages:
    file_name, page, text, image_sha (array)."""
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) >= least
    n = pages.groupBy("file_name").agg(F.count("*").alias("pages"), F.count_if(has).alias("with_text"), F.count_if(~has).alias("to_recognise"))
    images = pages.select("file_name", F.explode("image_sha").alias("sha")).groupBy("file_name").agg(F.countDistinct("sha").alias("images"))
    return n.join(images, "file_name", "left").withColumn("images", F.coalesce("images", F.lit(0)))


def media_path(document: Column, page: Column, content: Column, suffix: str = "png") -> Column:
    """Place of a media file by the digest of its content (O-17); page numbers have three digits at least."""
    number = page.cast("string")
    return F.concat_ws("/", document, F.concat(F.lit("page_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))), F.concat(F.substring(F.md5(content), 1, 12), F.lit("." + suffix)))


def routed(chunks: DataFrame) -> DataFrame:
    """Rows of the text and the visual index: prose goes to text; figures to text under their description's id and to visual too; rows
    without a vector are left out (O-14, O-15). chunks: file_name, page_num, chunk_id, content_type, has_vector."""
    ok = chunks.where("has_vector")
    figure = F.col("content_type").isin("image", "diagram_visual")
    key = F.concat_ws("_", "file_name", F.col("page_num").cast("string"), "chunk_id")
    text = ok.select("*", F.lit("text").alias("index_name"), F.when(figure, F.concat(key, F.lit("_desc"))).otherwise(key).alias("id"))
    visual = ok.where(figure).select("*", F.lit("visual").alias("index_name"), F.concat(key, F.lit("_visual")).alias("id"))
    return text.unionByName(visual)


def facets(figures: DataFrame, keywords: str = r"(?i)diagram|schematic|wiring|circuit|connection|conexión|esquema|electrical|eléctric|electric|distribution|plan|layout") -> DataFrame:
    """A visual row for each figure whose notes say that it is a diagram, and one of its recognised text where that is legible (O-35).
    figures: id, notes, ocr_text."""
    from granary.functions.text import legible

    f = figures.where(F.col("notes").rlike(keywords))
    parts = F.array(F.struct(F.lit("_visual").alias("suffix"), F.col("notes").alias("text")), F.when(legible(F.col("ocr_text")), F.struct(F.lit("_ocr").alias("suffix"), F.col("ocr_text").alias("text"))))
    e = f.select("id", F.explode(F.array_compact(parts)).alias("p"))
    return e.select("id", F.concat(F.col("id").cast("string"), F.col("p.suffix")).alias("facet_id"), "p.text")


def readable(revised: Column, markdown: Column, rows: Column, notes: Column, raw: Column, most: int = 400) -> Column:
    """Text of a chunk by precedence: revised, table's markdown, its rows, the figure's notes, the raw text (O-54)."""
    lines = F.array_join(F.slice(F.transform(rows, lambda r: F.array_join(r, "\t")), 1, most), "\n")
    given = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(given(revised), given(markdown), given(lines), given(notes), raw)


def embed_text(override: Column, parts: list[Column]) -> Column:
    """What is embedded: the override, else the parts that are not empty, a line each; null where nothing is (O-55)."""
    given = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    joined = F.concat_ws("\n", *[given(p) for p in parts])
    return F.coalesce(given(override), given(joined))


def media_references(chunks: DataFrame) -> DataFrame:
    """Chunks with their media as typed references, short texts left out; ids are digests of the key (O-173). chunks: id, content_type, text,
    media_path."""
    kind = F.when(F.col("content_type").isin("image", "diagram_visual"), "image").when(F.col("content_type") == "table", "table").otherwise("text")
    key = F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "media_path"), 256), 1, 12)
    ref = F.when(F.col("media_path").isNotNull(), F.array(F.struct(key.alias("media_id"), kind.alias("type"), F.col("media_path").alias("path"))))
    return chunks.where((kind != "text") | (F.length("text") >= 5)).withColumn("kind", kind).withColumn("media", F.coalesce(ref, F.array().cast("array<struct<media_id:string,type:string,path:string>>")))


def prompts(chunks: DataFrame, near: int = 600) -> DataFrame:
    """Context of each chunk for a model: the ends of its neighbours (O-172). chunks: id, file_name, ordinal, text."""
    w = Window.partitionBy("file_name").orderBy("ordinal")
    return chunks.select("id", F.substring(F.lag("text").over(w), -near, near).alias("before"), F.substring(F.lead("text").over(w), 1, near).alias("after"))
