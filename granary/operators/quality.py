"""Validation, deduplication by content, metrics and rules of chunk quality (O-43 to O-49, O-90 to O-93, O-100, O-125)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import tables as T

# Types without a least length, types with prose, words of procedures.
MEDIA_TYPES = ["image", "table", "diagram_visual", "diagram_description", "diagram_text"]
PROSE_TYPES = ["", "text", "superchunk", "diagram_text"]
PROCEDURE_WORDS = ["step", "paso", "procedure", "procedimiento", "instrucción", "instruction"]
BLANK_IMAGE = (
    r"(?i)imagen (está|esta) en blanco|no contiene informaci[óo]n visible|imagen (en blanco|vac[íi]a)|sin contenido visible"
    r"|no se (pueden|puede) identificar (componentes|elementos)|no hay (informaci[óo]n|contenido) (visible|alguna|alguno)"
)
CONSONANT_RUN = r"[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{15,}"
SYMBOL_RUN = r"(?U)[^\w\s]{5,}"
ALTERNATION = r"(?<![A-Za-z])\d[A-Za-z]\d[A-Za-z]\d(?![A-Za-z0-9])"
LEVELS = [(0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor")]


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def confidence_of(column: Column, default: float) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(default))


def reason(text: Column, content_type: Column, confidence: Column, least: int = 50, most: int = 8000, threshold: float = 0.0) -> Column:
    """The first rule that a chunk breaks, or valid (O-43)."""
    t = stripped(text)
    low = F.when(F.lower(F.coalesce(content_type, F.lit(""))).isin(MEDIA_TYPES), 1).otherwise(least)
    return (
        F.when(text.isNull(), "missing_original_chunk")
        .when(F.length(t) < low, "too_short")
        .when(F.length(t) > most, "too_long")
        .when(confidence_of(confidence, 1.0) < threshold, "low_confidence")
        .when(~t.rlike(r"[\p{L}\p{N}]"), "no_alphanumeric")
        .otherwise("valid")
    )


def validated(chunks: DataFrame, **limits) -> DataFrame:
    return chunks.withColumn("reason", reason(F.col("original_chunk"), F.col("content_type"), F.col("confidence"), **limits))


def validation_stats(chunks: DataFrame, **limits) -> DataFrame:
    """Rows for each reason (O-44)."""
    return validated(chunks, **limits).groupBy("reason").agg(F.count("*").alias("n"))


def first_of_equal(chunks: DataFrame, order: str, *within: str) -> DataFrame:
    """Chunks with the first one's order, dup_of, among those of equal stripped text (O-125). An aggregate and a join, so that
    a text of very many chunks is combined before it is shuffled and can be parted in the join."""
    keyed = chunks.withColumn("text_md5", F.md5(stripped(F.col("original_chunk"))))
    first = keyed.groupBy("text_md5", *within).agg(F.min(order).alias("dup_of"))
    return keyed.join(first, ["text_md5", *within])


def repeated_text(chunks: DataFrame) -> DataFrame:
    """Chunks whose squeezed text stands at least twice in their file (O-100)."""
    keyed = chunks.withColumn("squeezed", F.trim(F.regexp_replace(F.coalesce("original_chunk", F.lit("")), r"\s+", " "))).where("squeezed <> ''")
    keyed = keyed.withColumn("squeezed", F.md5("squeezed"))
    often = keyed.groupBy("file_name", "squeezed").agg(F.count("*").alias("repeats")).where("repeats >= 2")
    return keyed.join(often, ["file_name", "squeezed"]).drop("squeezed")


def ocr_signs(text: Column) -> dict[str, Column]:
    """Counts of what broken recognition leaves in a text (O-47)."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[A-Za-z]{4,}$"))
    return {
        "consonant_runs": F.regexp_count(text, F.lit(CONSONANT_RUN)),
        "symbol_runs": F.regexp_count(text, F.lit(SYMBOL_RUN)),
        "alternations": F.regexp_count(text, F.lit(ALTERNATION)),
        "specials": F.regexp_count(text, F.lit(r"(?U)[^\w\s]")),
        "words": F.size(words),
        "vowelless": F.size(F.filter(words, lambda w: ~F.lower(w).rlike("[aeiou]"))),
    }


def ocr_warnings(text: Column, content_type: Column) -> Column:
    """Codes of the signs that are over their limits; none for tables and images and for short texts (O-47)."""
    s = ocr_signs(text)
    flags = [
        F.when(s["consonant_runs"] > 10, "consonant_runs"),
        F.when(s["symbol_runs"] > 10, "symbol_runs"),
        F.when(s["alternations"] > 10, "alternations"),
        F.when(F.try_divide(s["specials"], F.length(text)) > 0.4, "specials"),
        F.when(F.try_divide(s["vowelless"], s["words"]) > 0.4, "vowelless"),
    ]
    applies = F.lower(F.coalesce(content_type, F.lit(""))).isin(PROSE_TYPES) & (F.length(text) >= 20)
    return F.when(applies, F.array_compact(F.array(*flags))).otherwise(F.array().cast("array<string>"))


def table_warnings(rows: Column, markdown: Column, image: Column) -> tuple[Column, Column]:
    """Whether a specification table is of no use, and the codes of its flaws (O-45)."""
    has_other = (F.trim(F.coalesce(markdown, F.lit(""))) != "") | (F.coalesce(image, F.lit("")) != "")
    none = F.coalesce(F.size(rows) <= 0, F.lit(True))
    total = F.size(F.flatten(rows))
    flaws = F.array_compact(F.array(F.when(T.bare_numbers(rows) > F.size(rows) * 0.5, "numbers_without_units"), F.when(T.empty_cells(rows) > total * 0.3, "empty_cells")))
    return none & ~has_other, F.when(none, F.array(F.when(has_other, "no_rows").otherwise("empty_table"))).otherwise(flaws)


def missing_steps(text: Column) -> Column:
    """Steps that a procedure's numbering leaves out; null where the text is none or has no numbers (O-46)."""
    low = F.lower(text)
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"(?:step|paso)\s+(\d+)"), 1), lambda n: n.try_cast("int"))
    is_procedure = F.exists(F.array(*[F.lit(w) for w in PROCEDURE_WORDS]), lambda w: F.contains(low, w))
    return F.when(is_procedure & (F.size(numbers) > 0), F.array_except(F.when(F.array_max(numbers) >= 1, F.sequence(F.lit(1), F.array_max(numbers))).otherwise(F.array().cast("array<int>")), numbers))


def figure_warnings(description: Column, notes_length: Column, has_parts: Column, ocr_confidence: Column) -> tuple[Column, Column]:
    """Whether a figure is said to be blank, and the codes of its flaws (O-48)."""
    flaws = F.array_compact(F.array(F.when((F.coalesce(notes_length, F.lit(0)) < 10) & ~F.coalesce(has_parts, F.lit(False)), "no_description"), F.when(ocr_confidence < 50, "weak_ocr")))
    return F.coalesce(description.rlike(BLANK_IMAGE), F.lit(False)), flaws


def warning_counts(rows: DataFrame, warnings: str = "warnings") -> DataFrame:
    """Rows for each code before its colon (O-49)."""
    return rows.select(F.explode(warnings).alias("w")).groupBy(F.substring_index("w", ":", 1).alias("warning")).agg(F.count("*").alias("n"))


def ingestion_metrics(chunks: DataFrame) -> DataFrame:
    """One row of metrics for each file (O-90)."""
    t = stripped(F.col("original_chunk"))
    ok = (F.length(t) >= 50) & F.col("chunk_id").isNotNull() & (confidence_of(F.col("confidence"), 1.0) >= 0.3)
    page = F.trim(F.split_part(F.col("page_num").cast("string"), F.lit("-"), F.lit(1)))
    base = chunks.select("file_name", "content_type", page.alias("page"), F.length(t).alias("len"), ok.alias("ok"), confidence_of(F.col("confidence"), 0.8).alias("conf"), F.md5(t).alias("h"))
    m = base.groupBy("file_name").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("valid"),
        F.countDistinct("h").alias("unique"),
        F.avg("len").alias("avg_length"),
        F.avg("conf").alias("avg_confidence"),
        F.countDistinct("page").alias("pages"),
        F.countDistinct("content_type").alias("types"),
        F.count_if(F.col("content_type") == "image").alias("images"),
    )
    return m.withColumn("duplicates", F.col("total") - F.col("unique"))


def with_scores(metrics: DataFrame) -> DataFrame:
    """Derived rates and the score (O-91)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = metrics.withColumn("validation_rate", zero(F.try_divide("valid", "total")))
    m = m.withColumn("dedup_savings", zero(F.try_divide("duplicates", F.col("total") + F.col("duplicates"))))
    m = m.withColumn("chunks_per_page", zero(F.try_divide("total", "pages")))
    raw = F.col("validation_rate") * 0.4 + F.col("avg_confidence") * 0.4 + F.least(F.col("types") / 3, F.lit(1.0)) * 0.2
    return m.withColumn("score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def with_rules(scored: DataFrame) -> DataFrame:
    """Level, problems and recommendations (O-92)."""
    level = F.lit("unusable")
    for limit, name in reversed(LEVELS):
        level = F.when(F.col("score") >= limit, name).otherwise(level)
    codes = lambda pairs: F.array_compact(F.array(*[F.when(c, n) for n, c in pairs]))
    c = F.col
    problems = codes([("low_validation", c("validation_rate") < 0.8), ("low_confidence", c("avg_confidence") < 0.6), ("short_chunks", c("avg_length") < 100), ("long_chunks", c("avg_length") > 3000), ("one_type", (c("types") == 1) & (c("images") == c("total"))), ("many_images", c("images") > c("total") * 0.3)])
    advice = codes([("stricter_validation", c("validation_rate") < 0.9), ("check_ocr", c("avg_confidence") < 0.75), ("overlap", c("dedup_savings") > 0.15), ("smaller_chunks", c("chunks_per_page") < 2), ("larger_chunks", c("chunks_per_page") > 10), ("longer_chunks", c("avg_length") < 200), ("excellent", c("score") >= 0.85)])
    return scored.withColumn("level", level).withColumn("problems", problems).withColumn("recommendations", advice)


def across_files(scored: DataFrame) -> DataFrame:
    """One row over all files (O-93); files are an ordered list, as many as there are files."""
    return scored.agg(
        F.count("*").alias("files"), F.sum("total").alias("chunks"), F.sum("unique").alias("unique"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("validation_rate").alias("avg_validation")
    )


def review_counters(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of each file by state of review (O-102)."""
    rows = chunks.join(verdicts.select("doc_id", "verdict"), "doc_id", "left")
    return rows.groupBy("file_name").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("content_type").isin("image", "diagram_visual")).alias("visual"),
        F.count_if(F.col("verdict").isNotNull()).alias("reviewed"),
        F.count_if(F.col("verdict").isNull()).alias("pending"),
        F.count_if(F.col("verdict") == "discard").alias("discarded"),
    )
