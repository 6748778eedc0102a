"""Telemetry: a star of executions, contexts, stages, candidates and feedback; saved queries; guarded SQL (O-19 to O-21, O-69, O-76 to
O-79, O-96 to O-99, O-154)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words that a read-only query must not have.
BANNED = "insert update delete drop alter create replace attach detach pragma vacuum reindex truncate".split()
MOST_ROWS, MOST_CHARS = 500, 500

LATEST = "(SELECT max_by(query_id, struct(created_at, query_id)) FROM executions)"
#: The saved queries, on the views of register(). Each has a last key of its order, so that ties have an order too.
SAVED = {
    "funnel": f"SELECT ordinal, stage, n_in, n_out, n_in - n_out AS dropped, note FROM stages WHERE query_id = {LATEST} ORDER BY ordinal",
    "candidates": f"SELECT position, round(score, 1) AS score, content_type, file_name, page_num, survived FROM candidates WHERE query_id = {LATEST} ORDER BY position",
    "good_dropped": """SELECT round(c.score, 1) AS score, c.position, c.content_type, c.file_name, c.page_num, substr(e.question, 1, 42) AS question, c.query_id FROM candidates c JOIN executions e ON e.query_id = c.query_id
      WHERE NOT c.survived AND c.score >= 62 ORDER BY c.score DESC, c.query_id, c.position, c.page_num LIMIT 60""",
    "latest": """SELECT substr(created_at, 1, 19) AS at, question, n_contexts, round(max_score, 1) AS max_score, CASE WHEN from_cache THEN 'yes' ELSE '' END AS cache, query_id FROM executions
      ORDER BY created_at DESC, query_id LIMIT 50""",
    "without_context": """SELECT substr(created_at, 1, 19) AS at, question, rewritten_question, CASE WHEN is_followup THEN 'yes' ELSE '' END AS with_history, query_id FROM executions WHERE n_contexts = 0
      ORDER BY created_at DESC, query_id LIMIT 50""",
    "negative": """SELECT substr(f.created_at, 1, 19) AS at, e.question, f.reasons_json AS reasons, f.comment, e.n_contexts, f.query_id FROM feedback f LEFT JOIN executions e ON e.query_id = f.query_id
      WHERE NOT f.useful ORDER BY f.created_at DESC, f.id LIMIT 50""",
    "reasons": "SELECT reasons_json AS reasons, count(*) AS n FROM feedback WHERE NOT useful GROUP BY reasons_json ORDER BY n DESC, reasons_json",
    "documents": """SELECT file_name, count(*) AS retrieved, sum(CAST(shown AS INT)) AS shown, round(avg(score), 1) AS mean_score, round(avg(position), 1) AS mean_position FROM contexts
      GROUP BY file_name ORDER BY retrieved DESC, file_name""",
    "retrieved_not_shown": """SELECT c.position, round(c.score, 1) AS score, c.content_type, c.file_name, c.page_num, substr(e.question, 1, 40) AS question FROM contexts c JOIN executions e ON e.query_id = c.query_id
      WHERE NOT c.shown AND c.score > 60 ORDER BY c.score DESC, c.query_id, c.position, c.page_num LIMIT 50""",
    "satisfaction": """SELECT (SELECT count(*) FROM executions) AS queries, (SELECT count(*) FROM feedback) AS rated, (SELECT count(*) FROM feedback WHERE useful) AS useful, (SELECT count(*) FROM feedback WHERE NOT useful) AS useless,
      (SELECT round(avg(n_contexts), 1) FROM executions) AS mean_contexts, (SELECT round(avg(max_score), 1) FROM executions WHERE max_score IS NOT NULL) AS mean_score""",
    "slow": """SELECT substr(question, 1, 50) AS question, round(total, 2) AS total_s, round(CAST(get_json_object(timings_json, '$.context_time') AS DOUBLE), 2) AS retrieval_s,
      round(CAST(get_json_object(timings_json, '$.qna_time') AS DOUBLE), 2) AS generation_s, n_contexts FROM (SELECT *, CAST(get_json_object(timings_json, '$.total_time') AS DOUBLE) AS total FROM executions WHERE timings_json IS NOT NULL)
      ORDER BY total DESC, query_id LIMIT 30""",
}


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def saved(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(SAVED[name])


def guarded(sql: str) -> str:
    """The statement if it is one read-only SELECT or WITH; else an error that says why (O-69)."""
    clean = (sql or "").strip().rstrip(";").strip()
    low = clean.lower()
    if not clean:
        raise ValueError("empty query")
    if not low.startswith(("select", "with")):
        raise ValueError("only SELECT is allowed")
    if ";" in clean:
        raise ValueError("one query at a time")
    for word in BANNED:
        if re.search(rf"\b{word}\b", low):
            raise ValueError(f"{word} is not allowed: queries only read")
    return clean


def query(spark: SparkSession, sql: str, most: int = MOST_ROWS) -> DataFrame:
    """At most so many rows of a guarded query, strings cut to a length."""
    out = spark.sql(guarded(sql)).limit(most)
    return out.select(*[F.substring(c, 1, MOST_CHARS).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: insert-or-replace over an append-only table (O-14, O-21). Rows of a key are combined before they are
    shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def feedback_with_runs(feedback: DataFrame, executions: DataFrame, negative: bool, n: int) -> DataFrame:
    """Feedback with its execution, newest first (O-76)."""
    f = feedback.where("NOT useful") if negative else feedback
    return f.join(executions.select("query_id", "question", "n_contexts"), "query_id", "left").orderBy(F.desc("created_at"), "id").limit(n)


def feedback_export(feedback: DataFrame, executions: DataFrame) -> DataFrame:
    """Rows of the export with reasons joined by semicolons (O-19)."""
    reasons = F.array_join(F.from_json("reasons_json", "array<string>"), "; ")
    return feedback.join(executions.select("query_id", "question"), "query_id", "left").select("id", "query_id", "created_at", "useful", reasons.alias("reasons"), "comment", "question")


def execution_detail(executions: DataFrame, contexts: DataFrame, stages: DataFrame) -> DataFrame:
    """Each execution with its children as ordered lists (O-77)."""
    lst = lambda d, name, *cols: d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    return executions.select("query_id", "question").join(lst(contexts, "contexts", "position", "file_name"), "query_id", "left").join(lst(stages, "stages", "ordinal", "n_out"), "query_id", "left")


def with_survival(candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Whether a candidate's file and first page are among its query's contexts (O-78)."""
    start = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    final = contexts.select("query_id", "file_name", start(F.col("page_num")).alias("__p")).distinct().withColumn("__in", F.lit(True))
    return candidates.withColumn("__p", start(F.col("page_num"))).join(final, ["query_id", "file_name", "__p"], "left").withColumn("survived", F.coalesce("__in", F.lit(False))).drop("__p", "__in")


def flagged(contexts: DataFrame, marks: DataFrame, flag: str) -> DataFrame:
    """Whether a context's file and page are marked for its query (O-79)."""
    m = marks.select("query_id", "file_name", "page_num").distinct().withColumn(flag, F.lit(True))
    return contexts.drop(flag).join(m, ["query_id", "file_name", "page_num"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each stage and model: the price of the model's exact name, else of the longest prefix; models without a
    price have null cost and are counted apart (O-96). Prices are looked up once for each distinct model."""
    total = usage.groupBy("stage", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("calls"))
    models = total.select("model").distinct()
    hit = models.join(prices, F.col("model").startswith(F.col("prefix")))
    best = hit.groupBy("model").agg(F.max_by(F.struct("usd_in", "usd_out"), F.length("prefix")).alias("p")).select("model", "p.*")
    cost = (F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6
    return total.join(best, "model", "left").withColumn("usd", F.round(cost, 9)).withColumn("unpriced", F.when(F.col("usd_in").isNull(), F.col("tokens_in") + F.col("tokens_out")).otherwise(0)).drop("usd_in", "usd_out")


def reason_histogram(feedback: DataFrame) -> DataFrame:
    """Rows for each single reason (O-99)."""
    return feedback.select(F.explode(F.from_json("reasons_json", "array<string>")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def timings(executions: DataFrame) -> DataFrame:
    """Columns of the timings' file (O-20, O-154)."""
    t = lambda k: F.get_json_object("timings_json", f"$.{k}").try_cast("double").alias(k)
    return executions.select("query_id", "created_at", t("total_time"), t("context_time"), t("qna_time"))


def rank_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
