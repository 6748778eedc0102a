"""Queries of telemetry, entities, graphs, evaluation and review. orders are executions, lineitem their contexts, candidates and stages,
events the feedback and the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import entities as E
from granary.operators import evaluation as V
from granary.operators import telemetry as T

from .inputs import read
from .registry import Registry

query = Registry()


def star(spark, sf):
    """The five tables, registered as views as well."""
    o, li, e = (read(spark, sf, t) for t in ("orders", "lineitem", "events"))
    k = F.col("o_orderkey")
    executions = o.select(
        k.cast("string").alias("query_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.concat(F.lit("question "), F.col("o_orderpriority")).alias("question"),
        F.when(k % 3 == 0, F.concat(F.lit("again "), F.col("o_orderpriority"))).alias("rewritten_question"), (k % 3 == 0).alias("is_followup"), (k % 7 == 0).alias("from_cache"),
        (k % 5).cast("int").alias("n_contexts"), F.when(k % 11 != 0, F.col("o_totalprice") / 5000).alias("max_score"),
        F.when(k % 4 != 0, F.concat(F.lit('{"total_time":'), (k % 100).cast("string"), F.lit('.5,"context_time":'), (k % 10).cast("string"), F.lit(',"qna_time":'), (k % 7).cast("string"), F.lit("}"))).alias("timings_json"),
    )
    base = li.select(
        F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("doc_"), (F.col("l_suppkey") % 20).cast("string")).alias("file_name"), F.col("l_partkey").cast("string").alias("page_num"),
        F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("content_type"), (F.col("l_extendedprice") / 1000).alias("score"),
        (F.col("l_returnflag") == "R").alias("shown"), (F.col("l_linestatus") == "F").alias("survived"), F.col("l_quantity").cast("int").alias("n_in"), (F.col("l_quantity").cast("int") - (F.col("l_partkey") % 2).cast("int")).alias("n_out"),
    )
    feedback = e.select(
        F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 1000).cast("string").alias("query_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), (F.col("event_type") == "purchase").alias("useful"),
        F.concat(F.lit('["'), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, '","other"]').otherwise('"]')).alias("reasons_json"), F.when(F.col("event_id") % 5 == 0, F.lit("no")).alias("comment"),
    )
    tables = {
        "executions": executions,
        "contexts": base.select("query_id", "position", "file_name", "page_num", "content_type", "score", "shown"),
        "candidates": base.select("query_id", "position", "file_name", "page_num", "content_type", "score", "survived"),
        "stages": base.select("query_id", F.col("position").alias("ordinal"), F.concat(F.lit("stage "), F.col("page_num")).alias("stage"), "n_in", "n_out", F.lit("").alias("note")),
        "feedback": feedback,
    }
    T.register(tables)
    return tables


STAR = """executions AS (SELECT CAST(o_orderkey AS VARCHAR) AS query_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, 'question ' || o_orderpriority AS question,
  CASE WHEN o_orderkey % 3 = 0 THEN 'again ' || o_orderpriority END AS rewritten_question, o_orderkey % 3 = 0 AS is_followup, o_orderkey % 7 = 0 AS from_cache, CAST(o_orderkey % 5 AS INT) AS n_contexts,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 5000 END AS max_score, CASE WHEN o_orderkey % 4 <> 0 THEN '{"total_time":' || o_orderkey % 100 || '.5,"context_time":' || o_orderkey % 10 || ',"qna_time":' || o_orderkey % 7 || '}' END AS timings_json FROM orders),
 base AS (SELECT CAST(l_orderkey AS VARCHAR) AS query_id, l_linenumber AS position, 'doc_' || l_suppkey % 20 AS file_name, CAST(l_partkey AS VARCHAR) AS page_num, ['text','table','image'][CAST(l_partkey % 3 + 1 AS INT)] AS content_type, l_extendedprice / 1000 AS score,
  l_returnflag = 'R' AS shown, l_linestatus = 'F' AS survived, CAST(trunc(l_quantity) AS INT) AS n_in, CAST(trunc(l_quantity) - l_partkey % 2 AS INT) AS n_out FROM lineitem),
 contexts AS (SELECT query_id, position, file_name, page_num, content_type, score, shown FROM base), candidates AS (SELECT query_id, position, file_name, page_num, content_type, score, survived FROM base),
 stages AS (SELECT query_id, position AS ordinal, 'stage ' || page_num AS stage, n_in, n_out, '' AS note FROM base),
 feedback AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id % 1000 AS VARCHAR) AS query_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_type = 'purchase' AS useful,
  '["' || event_type || CASE WHEN event_id % 2 = 0 THEN '","other"]' ELSE '"]' END AS reasons_json, CASE WHEN event_id % 5 = 0 THEN 'no' END AS comment FROM events)"""


def duck(sql: str) -> str:
    """A saved query in DuckDB's words."""
    sql = sql.replace("max_by(query_id, struct(created_at, query_id))", "arg_max(query_id, {'a': created_at, 'b': query_id})").replace("sum(CAST(shown AS INT))", "CAST(sum(CAST(shown AS INT)) AS BIGINT)")
    sql = sql.replace("get_json_object(timings_json,", "json_extract_string(timings_json,")
    return f"WITH {STAR} {sql}"


def _saved(name: str):
    def run(spark, sf):
        star(spark, sf)
        return T.saved(spark, name)

    run.__name__ = f"telemetry_{name}"
    return query(duck(T.SAVED[name]))(run)


for _name in T.SAVED:
    _saved(_name)


@query(f"WITH {STAR} SELECT query_id, n_contexts FROM executions WHERE n_contexts > 3 ORDER BY query_id LIMIT 500")
def telemetry_guarded_sql(spark, sf):
    star(spark, sf)
    return T.query(spark, "SELECT query_id, n_contexts FROM executions WHERE n_contexts > 3 ORDER BY query_id; ")


@query(f"WITH {STAR} SELECT f.*, e.question, e.n_contexts FROM feedback f LEFT JOIN executions e USING (query_id) WHERE NOT useful ORDER BY f.created_at DESC, f.id LIMIT 100")
def feedback_left_join(spark, sf):
    t = star(spark, sf)
    return T.feedback_with_runs(t["feedback"], t["executions"], True, 100)


@query(f"WITH {STAR} SELECT f.id, f.query_id, f.created_at, useful, array_to_string(CAST(reasons_json::JSON AS VARCHAR[]), '; ') AS reasons, comment, e.question FROM feedback f LEFT JOIN executions e USING (query_id)")
def feedback_export(spark, sf):
    t = star(spark, sf)
    return T.feedback_export(t["feedback"], t["executions"])


@query(f"WITH {STAR} SELECT reason, count(*) AS n FROM (SELECT unnest(CAST(reasons_json::JSON AS VARCHAR[])) AS reason FROM feedback) GROUP BY 1")
def reason_histogram(spark, sf):
    return T.reason_histogram(star(spark, sf)["feedback"])


@query(f"WITH {STAR} SELECT query_id, created_at, TRY_CAST(json_extract_string(timings_json, '$.total_time') AS DOUBLE) AS total_time, TRY_CAST(json_extract_string(timings_json, '$.context_time') AS DOUBLE) AS context_time, TRY_CAST(json_extract_string(timings_json, '$.qna_time') AS DOUBLE) AS qna_time FROM executions")
def timings_columns(spark, sf):
    return T.timings(star(spark, sf)["executions"])


@query(f"""WITH {STAR}, c AS (SELECT query_id, list(file_name ORDER BY position, file_name) AS files FROM contexts GROUP BY 1), s AS (SELECT query_id, list(n_out ORDER BY ordinal, n_out) AS outs FROM stages GROUP BY 1)
 SELECT e.query_id, question, files, outs FROM executions e LEFT JOIN c USING (query_id) LEFT JOIN s USING (query_id)""")
def execution_detail(spark, sf):
    t = star(spark, sf)
    d = T.execution_detail(t["executions"], t["contexts"], t["stages"])
    return d.select("query_id", "question", F.transform("contexts", lambda x: x["file_name"]).alias("files"), F.transform("stages", lambda x: x["n_out"]).alias("outs"))


@query(f"WITH {STAR}, f AS (SELECT DISTINCT query_id, file_name, page_num FROM contexts WHERE shown) SELECT c.query_id, c.position, c.file_name, c.page_num, f.query_id IS NOT NULL AS survived FROM candidates c LEFT JOIN f USING (query_id, file_name, page_num)")
def survival_semi_join(spark, sf):
    t = star(spark, sf)
    return T.with_survival(t["candidates"].drop("survived"), t["contexts"].where("shown")).select("query_id", "position", "file_name", "page_num", "survived")


@query(f"WITH {STAR}, f AS (SELECT DISTINCT query_id, file_name, page_num FROM candidates WHERE position <= 2) SELECT c.query_id, c.position, c.file_name, c.page_num, f.query_id IS NOT NULL AS cited FROM contexts c LEFT JOIN f USING (query_id, file_name, page_num)")
def cited_flags(spark, sf):
    t = star(spark, sf)
    return T.flagged(t["contexts"], t["candidates"].where("position <= 2"), "cited").select("query_id", "position", "file_name", "page_num", "cited")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, sf):
    return T.latest_by_key(read(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


PRICES = "prices AS (SELECT * FROM (VALUES ('Brand#1', 2.5, 10.0), ('Brand#12', 0.15, 0.6), ('Brand#2', 1.1, 4.4), ('Brand#25', 3.0, 12.0)) t(prefix, usd_in, usd_out))"


@query(f"""WITH {PRICES}, u AS (SELECT p_type AS stage, p_brand AS model, CAST(sum(p_size) AS BIGINT) AS tokens_in, CAST(sum(p_partkey) AS BIGINT) AS tokens_out, count(*) AS calls FROM part GROUP BY 1, 2),
 b AS (SELECT model, usd_in, usd_out FROM (SELECT DISTINCT p_brand AS model FROM part), prices WHERE starts_with(model, prefix) QUALIFY row_number() OVER (PARTITION BY model ORDER BY length(prefix) DESC) = 1)
 SELECT stage, model, tokens_in, tokens_out, calls, round(tokens_in * usd_in::DOUBLE + tokens_out * usd_out::DOUBLE, 2) AS micro_usd, CASE WHEN usd_in IS NULL THEN tokens_in + tokens_out ELSE 0 END AS unpriced FROM u LEFT JOIN b USING (model)""")
def usage_cost(spark, sf):
    prices = spark.createDataFrame([("Brand#1", 2.5, 10.0), ("Brand#12", 0.15, 0.6), ("Brand#2", 1.1, 4.4), ("Brand#25", 3.0, 12.0)], "prefix string, usd_in double, usd_out double")
    u = read(spark, sf, "part").select(F.col("p_type").alias("stage"), F.col("p_brand").alias("model"), F.col("p_size").cast("long").alias("tokens_in"), F.col("p_partkey").alias("tokens_out"))
    return T.usage_cost(u, F.broadcast(prices)).withColumn("micro_usd", F.round(F.col("usd") * 1e6, 2)).drop("usd")


ALIASES = "aliases AS (SELECT * FROM (VALUES ('the', 'T01', 'code'), ('and', 'T02', 'specific'), ('of the', 'T03', 'specific'), ('le', 'T04', 'weak'), ('the', 'T02', 'code'), ('des la', 'T04', 'specific'), ('x', 'T05', 'code'), ('más', 'T06', 'weak')) t(term, code, level))"
RESOLVED = rf"""{ALIASES}, t AS (SELECT doc_id AS id, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS plain FROM documents), a AS (SELECT replace(term, 'á', 'a') AS term, code, level FROM aliases WHERE length(term) >= 2),
 h AS (SELECT id, code, level FROM t, a WHERE contains(plain, term) AND regexp_matches(plain, '(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])')),
 r AS (SELECT id, code, arg_min(level, CASE level WHEN 'code' THEN 1 WHEN 'specific' THEN 2 ELSE 3 END) AS level FROM h GROUP BY 1, 2)"""


def aliases(spark):
    rows = [("the", "T01", "code"), ("and", "T02", "specific"), ("of the", "T03", "specific"), ("le", "T04", "weak"), ("the", "T02", "code"), ("des la", "T04", "specific"), ("x", "T05", "code"), ("más", "T06", "weak")]
    return spark.createDataFrame(rows, "term string, code string, level string")


@query(f"WITH {RESOLVED} SELECT id, code, level FROM r")
def entity_levels(spark, sf):
    return E.resolved(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), aliases(spark))


@query(f"WITH {RESOLVED} SELECT id, list_sort(list(code)) AS codes FROM r JOIN documents d ON d.doc_id = r.id WHERE level <> 'weak' AND NOT (source = 'src3' AND code = 'T01') GROUP BY 1")
def entity_tag_terms(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("file_name"))
    return E.tags(d, aliases(spark), spark.createDataFrame([("src3", "T01")], "file_name string, code string"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'K' || p_size % 4 WHEN p_name LIKE '%widget%' THEN 'K1' WHEN p_name LIKE '%ring%' THEN 'K2' END AS code FROM part")
def code_normaliser(spark, sf):
    comps = spark.createDataFrame([("K0", "null object"), ("K1", "widgets"), ("K2", "ringers"), ("K3", "zeppelin")], "code string, name string")
    m = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("el k"), (F.col("p_size") % 4).cast("string"), F.lit(" ese"))).otherwise(F.concat(F.lit("un "), F.when(F.col("p_name").contains("ring"), "ringer").when(F.col("p_name").contains("widget"), "widget").otherwise("foo")))
    m = F.when((F.col("p_partkey") % 3 != 0) & F.col("p_name").contains("widget"), F.lit("un widget")).otherwise(m)
    return E.normalised_codes(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), m.alias("mention")), comps)


EDGES = "edges AS (SELECT DISTINCT s_nationkey AS a, CAST(s_suppkey % 25 AS INT) AS b, (s_nationkey + s_suppkey % 25) % 5 = 0 AS both_ways FROM supplier WHERE s_nationkey <> s_suppkey % 25)"


def edges(spark, sf):
    e = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("origin"), (F.col("s_suppkey") % 25).cast("int").alias("target")).where("origin <> target").distinct()
    return e.withColumn("both", (F.col("origin") + F.col("target")) % 5 == 0)


@query(f"WITH {EDGES} SELECT DISTINCT a AS node, b AS neighbour, 'out' AS direction FROM edges WHERE NOT both_ways UNION SELECT b, a, 'in' FROM edges WHERE NOT both_ways UNION SELECT a, b, 'both' FROM edges WHERE both_ways UNION SELECT b, a, 'both' FROM edges WHERE both_ways")
def graph_neighbourhood(spark, sf):
    return E.neighbourhood(edges(spark, sf))


@query(f"""WITH RECURSIVE {EDGES}, st AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges WHERE both_ways), q AS (SELECT x.n_nationkey AS origin, y.n_nationkey AS target FROM nation x, nation y WHERE x.n_nationkey < 5 AND y.n_nationkey BETWEEN 10 AND 14),
 p AS (SELECT origin, target, [origin] AS path FROM q UNION ALL SELECT origin, target, list_append(path, b) FROM p JOIN st ON path[-1] = a WHERE path[-1] <> target AND NOT list_contains(path, b) AND len(path) <= 4)
 SELECT origin, target, path, CAST(row_number() OVER (PARTITION BY origin, target ORDER BY len(path), path) AS INT) AS n FROM p WHERE path[-1] = target QUALIFY n <= 3""")
def graph_bounded_paths(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey")
    pairs = n.where("n_nationkey < 5").select(F.col("n_nationkey").alias("origin"), F.lit(1).alias("k")).join(n.where("n_nationkey BETWEEN 10 AND 14").select(F.col("n_nationkey").alias("target"), F.lit(1).alias("k")), "k").drop("k")
    return E.paths(edges(spark, sf), pairs)


@query("""WITH c AS (SELECT o_custkey % 50 AS query_id, o_orderpriority AS code FROM orders GROUP BY 1, 2) SELECT x.query_id, x.code AS origin, y.code AS target FROM c x JOIN c y USING (query_id) WHERE x.code <> y.code""")
def graph_path_pairs(spark, sf):
    return E.path_pairs(read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderpriority").alias("code")).distinct())


@query(f"WITH {EDGES}, d AS (SELECT DISTINCT c_nationkey AS a, CAST(c_custkey % 25 AS INT) AS b FROM customer) SELECT e.a AS origin, e.b AS target, CASE WHEN x.a IS NOT NULL THEN 'same' WHEN y.a IS NOT NULL THEN 'reversed' ELSE 'none' END AS conflict FROM edges e LEFT JOIN d x ON x.a = e.a AND x.b = e.b LEFT JOIN d y ON y.a = e.b AND y.b = e.a")
def edge_conflicts(spark, sf):
    d = read(spark, sf, "customer").select(F.col("c_nationkey").alias("origin"), (F.col("c_custkey") % 25).cast("int").alias("target"))
    return E.conflicts(edges(spark, sf).select("origin", "target"), d)


@query(f"""WITH {EDGES}, inv AS (SELECT DISTINCT c_nationkey AS a, CAST(c_custkey % 25 AS INT) AS b FROM customer WHERE c_custkey % 4 = 0), rev AS (SELECT a, b, CASE WHEN (a + b) % 2 = 0 THEN 'confirmed' ELSE 'discarded' END AS state FROM inv WHERE (a * b) % 3 = 0),
 dec AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM inv UNION SELECT least(a, b), greatest(a, b) FROM rev)
 SELECT a AS origin, b AS target, 'review' AS source FROM rev WHERE state = 'confirmed' UNION SELECT a, b, 'inventory' FROM inv WHERE (a, b) NOT IN (SELECT a, b FROM rev) UNION SELECT a, b, 'extracted' FROM edges WHERE (least(a, b), greatest(a, b)) NOT IN (SELECT x, y FROM dec)""")
def edge_precedence(spark, sf):
    inv = read(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_nationkey").alias("origin"), (F.col("c_custkey") % 25).cast("int").alias("target")).distinct()
    rev = inv.where("(origin * target) % 3 = 0").withColumn("state", F.when((F.col("origin") + F.col("target")) % 2 == 0, "confirmed").otherwise("discarded"))
    return E.merged_edges(rev, inv, edges(spark, sf))


@query("SELECT l_suppkey AS origin, l_linenumber AS target, arg_min(c, o) AS confidence FROM (SELECT *, ['alta','media','baja'][CAST(l_partkey % 3 + 1 AS INT)] AS c, l_partkey % 3 AS o FROM lineitem) GROUP BY 1, 2")
def edge_pair_dedup(spark, sf):
    c = F.element_at(F.array(F.lit("alta"), F.lit("media"), F.lit("baja")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return E.best_of_pairs(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("origin"), F.col("l_linenumber").alias("target"), c.alias("confidence")))


@query("SELECT p_brand AS code, list_sort(list(DISTINCT p_type)) AS records FROM part GROUP BY 1")
def inverted_codes(spark, sf):
    return E.inverted(read(spark, sf, "part").groupBy(F.col("p_type").alias("record")).agg(F.collect_set("p_brand").alias("codes")))


@query("SELECT n_name AS code, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS INT) AS n, s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0 QUALIFY n <= 2")
def open_discrepancies(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.array("n_name").alias("components"), F.when(F.col("s_suppkey") % 3 == 0, "resolved").otherwise("open").alias("state"))
    return E.open_discrepancies(rows).select("code", "n", "id")


@query("SELECT r_name AS system, string_agg('- ' || n_nationkey || ': ' || n_name, chr(10) ORDER BY '- ' || n_nationkey || ': ' || n_name) AS glossary FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def glossary_text(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return E.glossary(n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("system")))


@query("SELECT DISTINCT source AS file_name, CASE WHEN source IN ('src1', 'src2') THEN 'unknown' WHEN source IN ('src3', 'src4') THEN 'superseded' ELSE 'current' END AS state FROM documents")
def vigency_checks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("file_name"))
    m = d.distinct().where("file_name NOT IN ('src1', 'src2')").withColumn("current", ~F.col("file_name").isin("src3", "src4"))
    return E.current_files(d, m)


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 60 = 0) AND NOT (doc_id % 60 = 1)")
def blank_image_purge(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("file_name"), F.lit("1").alias("page_num"), F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 60 == 1, (F.col("doc_id") - 1).cast("string")).alias("parent_chunk_id"))
    d = d.withColumn("file_name", F.lit("f"))
    return E.purged(d, d.where("doc_id % 60 = 0").select("file_name", "page_num", "chunk_id")).select("doc_id")


@query(f"WITH {EDGES}, k AS (SELECT a, b, 'known' AS state FROM edges WHERE a < 10) SELECT a AS origin, b AS target, state FROM k UNION ALL SELECT DISTINCT a, b, 'new' FROM edges WHERE (a, b) NOT IN (SELECT a, b FROM k)")
def edge_proposals(spark, sf):
    e = edges(spark, sf).select("origin", "target")
    return E.proposals(e.where("origin < 10").withColumn("state", F.lit("known")), e.withColumn("state", F.lit("new")))


RANKS = "ranks AS (SELECT c_custkey AS item_id, c_mktsegment AS category, min(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '3-MEDIUM' THEN pos END) AS rank FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) o ON o_custkey = c_custkey AND pos <= 10 GROUP BY 1, 2)"


def ranks(spark, sf):
    from pyspark.sql import Window

    o = read(spark, sf, "orders").withColumn("position", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("position <= 10")
    results = o.select(F.col("o_custkey").alias("item_id"), "position", F.lit("f").alias("file_name"), F.substring("o_orderpriority", 1, 1).alias("page_num"))
    items = read(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("category"), F.lit("f").alias("gold_file"), F.array(F.lit("1"), F.lit("3")).alias("gold_pages"))
    return V.gold_rank(results, items)


@query(f"WITH {RANKS} SELECT item_id, category, CAST(rank AS INT) AS rank FROM ranks")
def gold_rank(spark, sf):
    return ranks(spark, sf).select("item_id", "category", "rank")


METRICS = "round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}"
ALL_METRICS = ", ".join(METRICS.format(k=k) for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) FILTER (rank IS NULL) AS never, CAST(median(rank) AS DOUBLE) AS median_rank, count(*) AS n"


@query(f"WITH {RANKS} SELECT {ALL_METRICS} FROM ranks")
def eval_recall_mrr(spark, sf):
    return V.metrics(ranks(spark, sf))


@query(f"WITH {RANKS} SELECT category, {ALL_METRICS} FROM ranks GROUP BY 1")
def eval_by_category(spark, sf):
    return V.metrics(ranks(spark, sf), ["category"])


@query(f"""WITH {RANKS}, a AS (SELECT category, {METRICS.format(k=3)} FROM ranks GROUP BY 1), b AS (SELECT category, {METRICS.format(k=3)} FROM ranks WHERE item_id % 2 = 0 GROUP BY 1)
 SELECT category, a.recall_3 AS recall_3_a, b.recall_3 AS recall_3_b, round(b.recall_3 - a.recall_3, 6) AS recall_3_delta FROM a FULL JOIN b USING (category)""")
def run_comparison(spark, sf):
    r = ranks(spark, sf)
    return V.compared(V.metrics(r, ["category"]), V.metrics(r.where("item_id % 2 = 0"), ["category"]), "category", ["recall_3"])


@query(f"WITH {RANKS} SELECT item_id, list_filter([CASE WHEN item_id % 9 = 0 THEN 'no_anchor' END, CASE WHEN rank IS NULL AND item_id % 4 <> 0 THEN 'fails' END, CASE WHEN rank > 5 THEN 'ambiguous' END], lambda x: x IS NOT NULL) AS flags FROM ranks")
def triage_flags(spark, sf):
    i = ranks(spark, sf).withColumn("has_anchor", F.col("item_id") % 9 != 0).withColumn("present", F.when(F.col("item_id") % 4 != 0, F.col("rank").isNotNull()))
    return V.triage(i).select("item_id", "flags")


GRAMS = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query(rf"""WITH i AS (SELECT item_id, list_distinct(list_transform(generate_series(1, length(t) - 4), lambda i: substr(t, i, 5))) AS g FROM (SELECT item_id, regexp_replace({GRAMS.format('text')}, '[^a-z0-9]+', '', 'g') AS t FROM benchmark)),
 c AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, length(t) - 4), lambda i: substr(t, i, 5))) AS g FROM (SELECT doc_id, regexp_replace({GRAMS.format('text')}, '[^a-z0-9]+', '', 'g') AS t FROM documents) WHERE length(t) >= 5),
 q AS (SELECT item_id, len(g) AS total, unnest(g) AS gram FROM i), d AS (SELECT doc_id, unnest(g) AS gram FROM c), s AS (SELECT item_id, doc_id, count(*) / any_value(total) AS share FROM q JOIN d USING (gram) GROUP BY 1, 2)
 SELECT item_id, doc_id AS chunk_id, round(share, 6) AS share FROM s WHERE share >= 0.6 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY share DESC, doc_id) = 1""")
def containment_remap(spark, sf):
    return V.best_containment(read(spark, sf, "benchmark"), read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@query("""WITH g AS (SELECT p_partkey AS item_id, p_size AS page FROM part WHERE p_partkey % 2 = 0), s AS (SELECT DISTINCT p_partkey - p_partkey % 2 AS item_id, p_size + p_partkey % 3 AS page, (p_partkey % 10) / 10 AS share FROM part)
 SELECT DISTINCT g.item_id, CAST(s.page AS INT) AS page FROM g JOIN s ON s.item_id = g.item_id AND abs(s.page - g.page) = 1 WHERE share >= 0.2""")
def adjacent_gold_pages(spark, sf):
    p = read(spark, sf, "part").withColumn("file_name", F.lit("f"))
    g = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"), "file_name", F.col("p_size").alias("page"))
    s = p.select((F.col("p_partkey") - F.col("p_partkey") % 2).alias("item_id"), "file_name", (F.col("p_size") + F.col("p_partkey") % 3).cast("int").alias("page"), ((F.col("p_partkey") % 10) / 10).alias("share"))
    return V.adjacent_gold(g, s).select("item_id", "page")


@query("""WITH e AS (SELECT user_id, event_id AS ts, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS verdict, CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN 'text ' || event_id END AS t FROM events)
 SELECT user_id, arg_max(verdict, ts) FILTER (verdict IS NOT NULL) AS verdict, nullif(arg_max(t, ts) FILTER (t IS NOT NULL), '') AS revised_text, max(ts) AS ts FROM e GROUP BY 1""")
def verdict_upsert(spark, sf):
    t = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "signup", F.concat(F.lit("text "), F.col("event_id").cast("string")))
    e = read(spark, sf, "events").select("user_id", F.col("event_id").alias("ts"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("verdict"), t.alias("revised_text"))
    return V.verdicts(e, ["user_id"]).select("user_id", "verdict", "revised_text", "ts")


@query("""WITH d AS (SELECT user_id, arg_max(CASE event_type WHEN 'click' THEN 'approved' ELSE 'rejected' END, event_id) AS state, max(event_id) AS t FROM events WHERE event_type IN ('click', 'error') GROUP BY 1), c AS (SELECT user_id, max(event_id) AS t FROM events WHERE event_type = 'view' GROUP BY 1)
 SELECT d.user_id, CASE WHEN state = 'approved' AND c.t > d.t THEN 'pending' ELSE state END AS state FROM d LEFT JOIN c USING (user_id)""")
def run_state_machine(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("ts"))
    d = e.where("event_type IN ('click', 'error')").withColumn("state", F.when(F.col("event_type") == "click", "approved").otherwise("rejected"))
    return V.run_states(d, e.where("event_type = 'view'"), ["user_id"])


@query("""WITH q AS (SELECT event_id AS query_id, event_type || '?' AS question FROM events WHERE event_id % 3 <> 0), c AS (SELECT event_type AS norm, arg_max('answer ' || user_id, event_id) AS answer FROM events WHERE event_id % 2 = 0 AND event_type <> 'signup' GROUP BY 1)
 SELECT query_id, answer FROM q JOIN c ON replace(question, '?', '') = norm""")
def response_cache(spark, sf):
    e = read(spark, sf, "events")
    q = e.select(F.col("event_id").alias("query_id"), F.concat("event_type", F.lit("?")).alias("question"), (F.col("event_id") % 3 == 0).alias("has_history"))
    c = e.where("event_type <> 'signup'").select(F.col("event_type").alias("norm"), F.when(F.col("event_id") % 2 == 0, "now").otherwise("old").alias("fingerprint"), F.concat(F.lit("answer "), F.col("user_id").cast("string")).alias("answer"), F.col("event_id").alias("stored_at"))
    return V.cached_answers(q, c, "now")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'followup' WHEN event_type = 'error' THEN 'reject' WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'followup' ELSE 'new' END WHEN event_type = 'click' THEN 'generic' ELSE 'new' END AS route FROM events""")
def intent_routing(spark, sf):
    kind = F.when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "view", "followup").when(F.col("event_type") == "click", "generic").otherwise("new")
    return V.routed(read(spark, sf, "events").select("event_id", kind.alias("intent"), (F.col("user_id") % 2 == 0).alias("has_history"))).select("event_id", "route")


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS position, event_type <> 'error' AND value > 20 AS valid FROM events), w AS (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY position) AS i FROM r)
 SELECT query_id, position, CASE WHEN n = 0 THEN 0 ELSE position END AS page FROM w WHERE valid OR n = 0 AND i = 1""")
def answer_filter(spark, sf):
    r = read(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("valid"), F.lit("f").alias("file_name"), F.col("event_id").alias("page"), F.lit(1.0).alias("score"))
    return V.valid_answers(r).select("query_id", "position", "page")


@query()
def refusal_similarity(spark, sf):
    """Indel ratio of answers to the refusals; SQL has no such function."""
    a = F.when(F.col("conv_id") % 3 == 0, F.lit("I don't know")).otherwise(F.col("text"))
    return read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", V.is_refusal(F.col("a")).alias("refusal"))
