"""Schemas of the engine's tables, and the cleaning of values that stand for null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = (
    "file_name string, run_id string, page_num string, chunk_id string, content_type string, original_chunk string, confidence string, prev_chunk_id string, next_chunk_id string, "
    "heading string, sub_heading string, document_section string, document_chapter string, hierarchy_path string, context_summary string, synthetic_questions array<string>, revised_text string"
)
CANDIDATE = (
    "query_id long, doc_id string, text string, file_name string, page_num string, chunk_id string, parent_chunk_id string, content_type string, question string, media_path string, "
    "dense_similarity double, dense_rank int, bm25_rank int, visual_rank int, fused_score double, rerank_score double, arrival long"
)
TABLE_PAYLOAD = "table_markdown string, table_json struct<rows: array<array<string>>>, image_path string, caption string, notes string"
FIGURE_NOTES = (
    "diagram_type string, description string, components array<string>, connections array<string>, labels array<string>, zones array<string>, parts array<string>, illegible array<string>, "
    "ratings map<string,string>, dimensions map<string,string>, equipment_locations map<string,string>"
)
MANIFEST = "file_stem string, sha256 string, last_processed_at string, status string, logical_name string, revision double, current boolean, superseded_by string"
RUNS = "document string, run string, sha256 string, state string, decided_at string, who string, note string"
VERDICTS = "document string, run string, page string, chunk_id string, verdict string, note string, who string, ts string, revised_text string"
CONNECTIONS = "document string, run string, page string, origin string, target string, state string, evidence string, conflict string, note string, who string, ts string"
EXECUTIONS = (
    "query_id string, created_at string, question string, answer string, conv_id string, is_followup boolean, rewritten_question string, answered boolean, from_cache boolean, index_name string, "
    "answer_model string, embedding_provider string, embedding_model string, embedding_dim int, top_k int, similarity_threshold double, cross_gate boolean, n_contexts int, n_with_image int, "
    "max_score double, timings_json string, extra_json string"
)
CONTEXTS = "query_id string, position int, file_name string, page_num string, chunk_id string, content_type string, score double, cited boolean, shown boolean, media_path string, text string"
STAGES = "query_id string, ordinal int, stage string, n_in int, n_out int, note string"
CANDIDATES = "query_id string, position int, file_name string, page_num string, chunk_id string, content_type string, score double, survived boolean"
FEEDBACK = "id string, query_id string, created_at string, useful boolean, reasons_json string, comment string"

#: Fixed values that stand for null in the sources.
NULL_WORDS = ["", "nan", "none"]


def null_if_sentinel(column: Column) -> Column:
    """Null for an empty string, nan and none in any case, with blanks around them or not."""
    return F.when(~F.lower(F.trim(column)).isin(NULL_WORDS), column)


def cleaned(df: DataFrame) -> DataFrame:
    """df with sentinels of all string columns as null, and NaN of all floating columns too."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string":
            out[name] = null_if_sentinel(F.col(name))
        elif kind in ("double", "float"):
            out[name] = F.when(~F.isnan(name), F.col(name))
    return df.withColumns(out)
