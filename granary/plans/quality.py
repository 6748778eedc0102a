"""Queries of chunk quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import quality as Q

from .inputs import CHUNKS, TABLES, chunks, order_tables, read
from .registry import Registry

query = Registry()
STRIP = r"regexp_replace(coalesce(original_chunk, ''), '^\s+|\s+$', '', 'g')"
MEDIA = "('image','table','diagram_visual','diagram_description','diagram_text')"
REASON = rf"""CASE WHEN original_chunk IS NULL THEN 'missing_original_chunk'
  WHEN length({STRIP}) < CASE WHEN content_type IN {MEDIA} THEN 1 ELSE 50 END THEN 'too_short' WHEN length({STRIP}) > 8000 THEN 'too_long'
  WHEN coalesce(TRY_CAST(confidence AS DOUBLE), 1.0) < 0.3 THEN 'low_confidence' WHEN NOT regexp_matches({STRIP}, '[\p{{L}}\p{{N}}]') THEN 'no_alphanumeric' ELSE 'valid' END"""


@query(f"WITH {CHUNKS} SELECT doc_id, {REASON} AS reason FROM chunks")
def chunk_validate_reasons(spark, sf):
    return Q.validated(chunks(spark, sf), threshold=0.3).select("doc_id", "reason")


@query(f"WITH {CHUNKS} SELECT {REASON} AS reason, count(*) AS n FROM chunks GROUP BY 1")
def chunk_validation_stats(spark, sf):
    return Q.validation_stats(chunks(spark, sf), threshold=0.3)


@query(f"WITH {CHUNKS} SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({STRIP})) AS dup_of FROM chunks")
def chunk_exact_dedup(spark, sf):
    return Q.first_of_equal(chunks(spark, sf), "doc_id").select("doc_id", "dup_of")


@query(f"WITH {CHUNKS} SELECT doc_id, md5(original_chunk) AS content_hash, substr(md5(original_chunk), 1, 12) AS media_id FROM chunks")
def chunk_content_hash(spark, sf):
    return chunks(spark, sf).select("doc_id", F.md5("original_chunk").alias("content_hash"), F.substring(F.md5("original_chunk"), 1, 12).alias("media_id"))


@query(rf"""WITH {CHUNKS}, k AS (SELECT *, trim(regexp_replace(coalesce(original_chunk, ''), '\s+', ' ', 'g')) AS s FROM chunks),
 g AS (SELECT *, count(*) OVER (PARTITION BY file_name, s) AS repeats FROM k WHERE s <> '') SELECT doc_id, file_name, repeats FROM g WHERE repeats >= 2""")
def boilerplate_repeats(spark, sf):
    return Q.repeated_text(chunks(spark, sf)).select("doc_id", "file_name", "repeats")


OCR = r"""SELECT doc_id, CAST(len(regexp_extract_all(original_chunk, '[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{15,}')) AS INT) AS consonant_runs,
 CAST(len(regexp_extract_all(original_chunk, '[^\p{L}\p{N}\p{M}_\s]{5,}')) AS INT) AS symbol_runs, CAST(len(regexp_extract_all(original_chunk, '[^\p{L}\p{N}\p{M}_\s]')) AS INT) AS specials,
 CAST(len(list_filter(regexp_extract_all(original_chunk, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{4,}'))) AS INT) AS words,
 CAST(len(list_filter(regexp_extract_all(original_chunk, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{4,}') AND NOT regexp_matches(lower(w), '[aeiou]'))) AS INT) AS vowelless FROM chunks"""


@query(f"WITH {CHUNKS} {OCR}")
def ocr_corruption_signs(spark, sf):
    s = Q.ocr_signs(F.col("original_chunk"))
    return chunks(spark, sf).select("doc_id", *[s[k].cast("int").alias(k) for k in ("consonant_runs", "symbol_runs", "specials", "words", "vowelless")])


@query(f"""WITH {CHUNKS}, s AS ({OCR}) SELECT doc_id, list_filter([CASE WHEN consonant_runs > 10 THEN 'consonant_runs' END, CASE WHEN symbol_runs > 10 THEN 'symbol_runs' END,
 CASE WHEN specials / length(original_chunk) > 0.4 THEN 'specials' END, CASE WHEN words > 0 AND vowelless / words > 0.4 THEN 'vowelless' END], lambda x: x IS NOT NULL) AS warnings
 FROM s JOIN chunks USING (doc_id) WHERE content_type IN ('text', 'superchunk') AND length(original_chunk) >= 20""")
def ocr_corruption_flags(spark, sf):
    rows = chunks(spark, sf).where("content_type IN ('text', 'superchunk') AND length(original_chunk) >= 20")
    return rows.select("doc_id", Q.ocr_warnings(F.col("original_chunk"), F.col("content_type")).alias("warnings"))


@query(f"""WITH {TABLES}, f AS (SELECT table_id, CAST(len(list_filter(flatten(rows), lambda c: trim(c) IN ('', '-', 'N/A', 'n/a'))) AS INT) AS empty_cells,
 CAST(len(list_filter(flatten(rows), lambda c: regexp_full_match(trim(c), '[0-9]+\\.?[0-9]*'))) AS INT) AS bare, len(rows) AS n, len(flatten(rows)) AS total FROM order_tables)
 SELECT table_id, false AS fatal, list_filter([CASE WHEN bare > n * 0.5 THEN 'numbers_without_units' END, CASE WHEN empty_cells > total * 0.3 THEN 'empty_cells' END], lambda x: x IS NOT NULL) AS warnings FROM f""".replace("\\\\", "\\"))
def spec_table_validation(spark, sf):
    fatal, warnings = Q.table_warnings(F.col("rows"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return order_tables(spark, sf).select("table_id", fatal.alias("fatal"), warnings.alias("warnings"))


STEPS = "steps AS (SELECT l_orderkey AS id, string_agg('Paso ' || l_linenumber, '; ' ORDER BY l_linenumber) AS text FROM lineitem GROUP BY 1)"


@query(rf"""WITH {STEPS}, n AS (SELECT id, list_transform(regexp_extract_all(lower(text), '(?:step|paso)\s+(\d+)', 1), lambda x: CAST(x AS INT)) AS nums FROM steps)
 SELECT id, list_filter(generate_series(1, list_max(nums)), lambda x: NOT list_contains(nums, CAST(x AS INT)))::INT[] AS missing FROM n""")
def procedure_missing_steps(spark, sf):
    t = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("Paso "), n.cast("string"))), "; ").alias("text"))
    return t.select("id", Q.missing_steps(F.col("text")).alias("missing"))


@query(r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'La imagen está en blanco' ELSE substr(text, 1, CAST(doc_id % 20 AS INT)) END AS d, doc_id % 4 = 0 AS parts, CAST(doc_id % 100 AS DOUBLE) AS conf FROM documents)
 SELECT doc_id, regexp_matches(d, '(?i)imagen (está|esta) en blanco|no contiene informaci[óo]n visible|imagen (en blanco|vac[íi]a)|sin contenido visible') AS fatal,
 list_filter([CASE WHEN length(d) < 10 AND NOT parts THEN 'no_description' END, CASE WHEN conf < 50 THEN 'weak_ocr' END], lambda x: x IS NOT NULL) AS warnings FROM f""")
def diagram_label_validation(spark, sf):
    d = F.when(F.col("doc_id") % 9 == 0, "La imagen está en blanco").otherwise(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 20).cast("int")))
    rows = read(spark, sf, "documents").select("doc_id", d.alias("d"))
    fatal, warnings = Q.figure_warnings(F.col("d"), F.length("d"), F.col("doc_id") % 4 == 0, (F.col("doc_id") % 100).cast("double"))
    return rows.select("doc_id", fatal.alias("fatal"), warnings.alias("warnings"))


#: Of every ninth chunk the vowels are lost, as a bad recognition loses them.
DAMAGED = "CASE WHEN doc_id % 9 = 4 THEN regexp_replace(text, '[aeiouAEIOU]', '', 'g') ELSE text END"


@query(f"""WITH {CHUNKS.replace('text AS original_chunk', DAMAGED + ' AS original_chunk')}, s AS ({OCR}), w AS (SELECT unnest([CASE WHEN consonant_runs > 10 THEN 'consonant_runs' END, CASE WHEN symbol_runs > 10 THEN 'symbol_runs' END,
 CASE WHEN specials / length(original_chunk) > 0.4 THEN 'specials' END, CASE WHEN words > 0 AND vowelless / words > 0.4 THEN 'vowelless' END]) AS warning
 FROM s JOIN chunks USING (doc_id) WHERE content_type IN ('text', 'superchunk') AND length(original_chunk) >= 20) SELECT warning, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY 1""")
def composite_warning_counts(spark, sf):
    damaged = F.when(F.col("doc_id") % 9 == 4, F.regexp_replace("original_chunk", "[aeiouAEIOU]", "")).otherwise(F.col("original_chunk"))
    return Q.warning_counts(chunks(spark, sf).withColumn("original_chunk", damaged).select(Q.ocr_warnings(F.col("original_chunk"), F.col("content_type")).alias("warnings")))


METRICS = f"""b AS (SELECT file_name, content_type, page_num, length({STRIP}) AS l, length({STRIP}) >= 50 AND coalesce(TRY_CAST(confidence AS DOUBLE), 1.0) >= 0.3 AS ok,
 coalesce(TRY_CAST(confidence AS DOUBLE), 0.8) AS conf, md5({STRIP}) AS h FROM chunks),
m AS (SELECT file_name, count(*) AS total, count(*) FILTER (ok) AS valid, count(DISTINCT h) AS "unique", avg(l) AS avg_length, avg(conf) AS avg_confidence, count(DISTINCT page_num) AS pages,
 count(DISTINCT content_type) AS types, count(*) FILTER (content_type = 'image') AS images, count(*) - count(DISTINCT h) AS duplicates FROM b GROUP BY 1),
s AS (SELECT *, valid / total AS validation_rate, duplicates / (total + duplicates) AS dedup_savings, total / pages AS chunks_per_page,
 least(greatest(valid / total * 0.4 + avg_confidence * 0.4 + least(types / 3, 1.0) * 0.2, 0.0), 1.0) AS score FROM m)"""


@query(f'WITH {CHUNKS}, {METRICS} SELECT file_name, total, valid, "unique", duplicates, pages, types, images, round(avg_length, 4) AS avg_length, round(avg_confidence, 6) AS avg_confidence FROM m')
def quality_metrics_by_source(spark, sf):
    m = Q.ingestion_metrics(chunks(spark, sf))
    return m.select("file_name", "total", "valid", "unique", "duplicates", "pages", "types", "images", F.round("avg_length", 4).alias("avg_length"), F.round("avg_confidence", 6).alias("avg_confidence"))


@query(f"WITH {CHUNKS}, {METRICS} SELECT file_name, round(validation_rate, 6) AS validation_rate, round(dedup_savings, 6) AS dedup_savings, round(chunks_per_page, 6) AS chunks_per_page, round(score, 6) AS score FROM s")
def quality_scores(spark, sf):
    s = Q.with_scores(Q.ingestion_metrics(chunks(spark, sf)))
    return s.select("file_name", *[F.round(c, 6).alias(c) for c in ("validation_rate", "dedup_savings", "chunks_per_page", "score")])


@query(f"""WITH {CHUNKS}, {METRICS} SELECT file_name, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' WHEN score >= 0.3 THEN 'poor' ELSE 'unusable' END AS level,
 list_filter([CASE WHEN validation_rate < 0.8 THEN 'low_validation' END, CASE WHEN avg_confidence < 0.6 THEN 'low_confidence' END, CASE WHEN avg_length < 100 THEN 'short_chunks' END, CASE WHEN avg_length > 3000 THEN 'long_chunks' END,
  CASE WHEN types = 1 AND images = total THEN 'one_type' END, CASE WHEN images > total * 0.3 THEN 'many_images' END], lambda x: x IS NOT NULL) AS problems,
 list_filter([CASE WHEN validation_rate < 0.9 THEN 'stricter_validation' END, CASE WHEN avg_confidence < 0.75 THEN 'check_ocr' END, CASE WHEN dedup_savings > 0.15 THEN 'overlap' END, CASE WHEN chunks_per_page < 2 THEN 'smaller_chunks' END,
  CASE WHEN chunks_per_page > 10 THEN 'larger_chunks' END, CASE WHEN avg_length < 200 THEN 'longer_chunks' END, CASE WHEN score >= 0.85 THEN 'excellent' END], lambda x: x IS NOT NULL) AS recommendations FROM s""")
def quality_level_rules(spark, sf):
    return Q.with_rules(Q.with_scores(Q.ingestion_metrics(chunks(spark, sf)))).select("file_name", "level", "problems", "recommendations")


@query(f"""WITH {CHUNKS}, {METRICS} SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS chunks, CAST(sum("unique") AS BIGINT) AS "unique", round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score,
 round(max(score), 6) AS max_score, round(avg(validation_rate), 6) AS avg_validation FROM s""")
def quality_across_files(spark, sf):
    a = Q.across_files(Q.with_scores(Q.ingestion_metrics(chunks(spark, sf))))
    return a.select("files", "chunks", "unique", *[F.round(c, 6).alias(c) for c in ("avg_score", "min_score", "max_score", "avg_validation")])


@query(f"""WITH {CHUNKS}, v AS (SELECT doc_id, CASE quality WHEN 0 THEN 'discard' ELSE 'keep' END AS verdict FROM labels)
 SELECT file_name, count(*) AS total, count(*) FILTER (content_type = 'image') AS visual, count(verdict) AS reviewed, count(*) - count(verdict) AS pending, count(*) FILTER (verdict = 'discard') AS discarded
 FROM chunks LEFT JOIN v USING (doc_id) GROUP BY 1""")
def review_counts(spark, sf):
    verdicts = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "discard").otherwise("keep").alias("verdict"))
    return Q.review_counters(chunks(spark, sf), verdicts)


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda t: true) AS toks FROM documents),
 t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM d),
 c AS (SELECT doc_id, pos, regexp_replace(tok, '^[.,;:()\[\]"''“”|—-]+|[.,;:()\[\]"''“”|—-]+$', '', 'g') AS w FROM t),
 g AS (SELECT *, regexp_full_match(w, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+') AS ok FROM c),
 r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM g),
 b AS (SELECT doc_id, grp, count(*) FILTER (ok AND length(w) >= 4) AS n FROM r GROUP BY 1, 2)
 SELECT doc_id, CAST(max(n) AS INT) AS run, max(n) >= 2 AS legible FROM b GROUP BY 1""")
def ocr_legibility(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.legible_run(F.col("text")).alias("run"), X.legible(F.col("text")).alias("legible"))
