"""Queries of scalar and table functions, and of the order and structure of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import tables as T
from granary.functions import text as X
from granary.operators import linking as L

from .inputs import CHUNKS, TABLES, chunks, order_tables, read
from .registry import Registry

query = Registry()
UNACCENT = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace({UNACCENT.format('text')}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def normalise_question(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.normalised_question(F.col("text")).alias("norm"))


MEASURES = "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey, 'P' || l_partkey % 400 || ' mide ' || replace(CAST(round(l_discount * 10, 1) AS VARCHAR), '.', ',') || ' m/s y ' || CAST(l_quantity AS INT) || ' A; ' || CAST(l_suppkey AS VARCHAR) || ' Hz' AS t FROM lineitem"


def measures(spark, sf):
    text = F.concat(
        F.lit("P"), (F.col("l_partkey") % 400).cast("string"), F.lit(" mide "), F.replace(F.round(F.col("l_discount") * 10, 1).cast("string"), F.lit("."), F.lit(",")),
        F.lit(" m/s y "), F.col("l_quantity").cast("int").cast("string"), F.lit(" A; "), F.col("l_suppkey").cast("string"), F.lit(" Hz"),
    )
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), "l_partkey", text.alias("t"))


@query(rf"WITH m AS ({MEASURES}) SELECT id, n, l_partkey, trim(regexp_replace(regexp_replace({UNACCENT.format('t')}, '(\d),(\d)', '\1.\2', 'g'), '\s+', ' ', 'g')) AS norm FROM m")
def eval_normalise(spark, sf):
    return measures(spark, sf).select("id", "n", "l_partkey", X.normalised_answer(F.col("t")).alias("norm"))


@query(rf"""WITH m AS ({MEASURES}), v AS (SELECT *, list_concat(regexp_extract_all(t, '\b\d+(?:[.,]\d+)?\s*(?:m/s|Hz)'), regexp_extract_all(t, '\b\d+(?:[.,]\d+)?\s*(?:A|m)\b')) AS vals,
 regexp_extract_all(t, '\b[A-Za-z]{{1,2}}\d{{1,3}}(?:\(\d+\))?\b') AS codes FROM m)
 SELECT id, n, l_partkey, list_sort(list_distinct(list_concat(list_transform(list_concat(codes, vals), lambda x: replace(lower(replace(x, ',', '.')), ' ', '')),
  list_filter(list_transform(vals, lambda x: replace(regexp_extract(x, '^\d+(?:[.,]\d+)?'), ',', '.')), lambda x: contains(x, '.') OR length(x) >= 3)))) AS anchors FROM v""")
def answer_anchors(spark, sf):
    return measures(spark, sf).select("id", "n", "l_partkey", X.anchors(F.col("t")).alias("anchors"))


@query(rf"""WITH b AS (SELECT item_id, trim(regexp_replace({UNACCENT.format('text')}, '\s+', ' ', 'g')) AS t FROM benchmark)
 SELECT item_id, list_filter(regexp_extract_all(t, '[a-z0-9áéíóúñ]{{3,}}'), lambda w: NOT list_contains({X.STOPWORDS!r}, w)) AS words FROM b""")
def content_words(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", X.content_words(F.col("text")).alias("words"))


@query(rf"""WITH b AS (SELECT item_id, trim(regexp_replace({UNACCENT.format('text')}, '\s+', ' ', 'g')) AS t FROM benchmark), w AS (SELECT item_id, list_filter(regexp_extract_all(t, '[a-z0-9áéíóúñ]{{3,}}'), lambda w: NOT list_contains({X.STOPWORDS!r}, w)) AS ws FROM b),
 d AS (SELECT doc_id, trim(regexp_replace({UNACCENT.format('text')}, '\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT max(item_id) + 1 AS n FROM benchmark)
 SELECT doc_id, item_id, CASE WHEN len(ws) >= 2 THEN len(list_filter(ws, lambda x: contains(t, x))) / len(ws) >= 0.6 END AS present FROM d, n JOIN w ON doc_id % n = item_id""")
def answer_presence(spark, sf):
    """Every document against one item, and every item against its share of the documents."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("key"))
    n = F.broadcast(b.agg((F.max("item_id") + 1).alias("n")))
    d = read(spark, sf, "documents").join(n).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), F.array("text").alias("texts"))
    return d.join(b, "item_id").select("doc_id", "item_id", X.answer_present(F.col("key"), F.col("texts")).alias("present"))


@query(rf"""WITH m AS ({MEASURES}), g AS (SELECT *, regexp_extract_all(t, '(\b(?:Hz|V|A))\s*(\d+(?:[.,]\d+)?)|(\d+(?:[.,]\d+)?)\s*((?:Hz|V|A)\b)', 0) AS hits FROM m)
 SELECT id, n, l_partkey, list_sort(list_distinct(list_transform(hits, lambda h: replace(regexp_extract(h, '\d+(?:[.,]\d+)?'), ',', '.') || regexp_extract(h, 'Hz|V|A')))) AS magnitudes FROM g""")
def figure_magnitudes(spark, sf):
    return measures(spark, sf).select("id", "n", "l_partkey", X.magnitudes(F.col("t")).alias("magnitudes"))


@query(rf"""WITH m AS ({MEASURES}), a AS (SELECT id, n, l_partkey, lag(t) OVER (PARTITION BY id ORDER BY n, l_partkey, t) AS p, t FROM m), f AS (SELECT *, list_transform(regexp_extract_all(t, '\d+(?:[.,]\d+)?\s*(?:Hz|A)\b'), lambda h: replace(replace(h, ',', '.'), ' ', '')) AS x,
 list_transform(regexp_extract_all(p, '\d+(?:[.,]\d+)?\s*(?:Hz|A)\b'), lambda h: replace(replace(h, ',', '.'), ' ', '')) AS y FROM a WHERE p IS NOT NULL)
 SELECT id, n, l_partkey, list_sort(list_distinct(list_concat(list_filter(x, lambda e: NOT list_contains(y, e)), list_filter(y, lambda e: NOT list_contains(x, e))))) AS disputed FROM f""")
def disputed_values(spark, sf):
    from pyspark.sql import Window

    m = measures(spark, sf).withColumn("p", F.lag("t").over(Window.partitionBy("id").orderBy("n", "l_partkey", "t"))).where("p IS NOT NULL")
    return m.select("id", "n", "l_partkey", X.disputed(F.col("t"), F.col("p")).alias("disputed"))


@query(r"""WITH e AS (SELECT event_id, CAST(value AS VARCHAR) AS v, props FROM events) SELECT event_id, len(list_filter(regexp_extract_all(v, '\d+(?:[.,]\d+)?'), lambda x: NOT contains(lower(regexp_replace(props, '\s+', '', 'g')), replace(x, ',', '.')))) > 0 AS unsupported
 FROM (SELECT event_id, CAST(CAST(floor(value) AS INT) AS VARCHAR) AS v, props FROM events)""")
def unsupported_values(spark, sf):
    return read(spark, sf, "events").select("event_id", X.unsupported(F.floor("value").cast("int").cast("string"), F.col("props")).alias("unsupported"))


@query(r"""SELECT p_partkey, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(lower(t), '(?i)\bmotor\b|\bm\d+\b'), lambda m: 'motor:' || m), list_transform(regexp_extract_all(lower(t), '(?i)\bk\d+\b'), lambda m: 'contactor:' || m),
 list_transform(regexp_extract_all(lower(t), '(?i)\bka?\d+\b'), lambda m: 'relay:' || m), list_transform(regexp_extract_all(lower(t), '(?i)\bf\d+\b'), lambda m: 'fuse:' || m)))) AS components
 FROM (SELECT p_partkey, p_name || ' M' || p_size || ' K' || p_size % 7 || ' y F' || p_partkey % 9 AS t FROM part)""")
def component_extraction(spark, sf):
    t = F.concat(F.col("p_name"), F.lit(" M"), F.col("p_size").cast("string"), F.lit(" K"), (F.col("p_size") % 7).cast("string"), F.lit(" y F"), (F.col("p_partkey") % 9).cast("string"))
    return read(spark, sf, "part").select("p_partkey", X.components(t).alias("components"))


@query(r"""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM pages""")
def sanitise_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.sanitised(F.col("html")).alias("safe"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k_number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events")
def json_and_time_fields(spark, sf):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf, "events").select("event_id", k.alias("k"), k.try_cast("double").alias("k_number"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("run_id"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS json FROM events""")
def salvaged_json(spark, sf):
    m, fence = F.col("event_id") % 4, F.lit("`" * 3)
    t = F.when(m == 0, F.col("props")).when(m == 1, F.concat(fence, F.lit("json\n"), F.col("props"), F.lit("\n"), fence)).when(m == 2, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).otherwise(F.lit("no answer"))
    return read(spark, sf, "events").select("event_id", X.salvaged_json(t).alias("json"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, coalesce(try_cast(substr(text, 1, 3) AS INT), 7) AS coerced FROM documents")
def estimated_tokens(spark, sf):
    tokens = F.when(F.col("text").isNotNull(), X.estimated_tokens(F.col("text")))  # the operator counts none in a missing text, the SQL says null
    return read(spark, sf, "documents").select("doc_id", tokens.alias("tokens"), F.coalesce(X.whole_number(F.substring("text", 1, 3)), F.lit(7)).alias("coerced"))


@query(rf"""WITH b AS (SELECT item_id, regexp_replace({UNACCENT.format('text')}, '[^a-z0-9]+', '', 'g') AS t FROM benchmark) SELECT item_id, len(list_distinct(list_transform(generate_series(1, length(t) - 4), lambda i: substr(t, i, 5)))) AS grams FROM b""")
def char_grams(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.size(X.char_grams(F.col("text"))).cast("long").alias("grams"))


@query(r"SELECT c_custkey, '[Www Example](https://www.example.com/' || c_custkey || ') of ' || c_name AS linked FROM customer")
def linked_urls(spark, sf):
    t = F.concat(F.lit("https://www.example.com/"), F.col("c_custkey").cast("string"), F.lit(" of "), F.col("c_name"))
    return read(spark, sf, "customer").select("c_custkey", X.linked_urls(t).alias("linked"))


@query("SELECT c_custkey, 'the answer ' || c_name AS answer FROM customer")
def cleaned_answers(spark, sf):
    t = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("Answer: ")).otherwise(F.lit("A1: ")), F.lit("the answer "), F.col("c_name"))
    return read(spark, sf, "customer").select("c_custkey", X.cleaned_answer(t).alias("answer"))


@query("SELECT p_partkey, least(0.5, 0.1 * (p_size % 7)) + CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0 END AS low, round(least(1.0, least(0.5, 0.1::DOUBLE * (p_size % 7)) + CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN p_size >= 15 THEN least(0.4, 0.2::DOUBLE + 0.005::DOUBLE * p_size) ELSE 0 END), 6)::DOUBLE AS complexity FROM part".replace("least(0.5, 0.1 * (p_size % 7)) + CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0 END AS low, ", ""))
def page_complexity(spark, sf):
    """Images, tables and drawings of a page as one number from 0 to 1 (O-66)."""
    score = F.least(F.lit(0.5), 0.1 * (F.col("p_size") % 7)) + F.when(F.col("p_partkey") % 3 == 0, 0.3).otherwise(0.0) + F.when(F.col("p_size") >= 15, F.least(F.lit(0.4), 0.2 + 0.005 * F.col("p_size"))).otherwise(0.0)
    return read(spark, sf, "part").select("p_partkey", F.round(F.least(F.lit(1.0), score), 6).alias("complexity"))


@query("SELECT count(*) FILTER (p_size >= 25) AS complex, count(*) FILTER (p_size < 25) AS simple, round(count(*) FILTER (p_size >= 25) * 0.03::DOUBLE, 6) AS usd, round(count(*) FILTER (p_size >= 25) * 5 + count(*) FILTER (p_size < 25) * 0.5::DOUBLE, 6) AS seconds FROM part")
def cost_estimate(spark, sf):
    """Cost and time of complex and simple pages (O-67)."""
    c = F.col("p_size") >= 25
    a = read(spark, sf, "part").agg(F.count_if(c).alias("complex"), F.count_if(~c).alias("simple"))
    return a.select("complex", "simple", F.round(F.col("complex") * 0.03, 6).alias("usd"), F.round(F.col("complex") * 5 + F.col("simple") * 0.5, 6).alias("seconds"))


@query("""SELECT s_suppkey, s_acctbal BETWEEN -100 AND 1100 AND s_acctbal + 500 > s_acctbal AS valid, greatest(s_acctbal / 10000 - 0.03, 0) AS x0, least(s_acctbal / 10000 + 0.2 + 0.03, 1) AS x1 FROM supplier""")
def bbox_margin(spark, sf):
    """Boxes with a margin, within the page (O-61)."""
    b = F.col("s_acctbal")
    return read(spark, sf, "supplier").select("s_suppkey", (b.between(-100, 1100) & (b + 500 > b)).alias("valid"), F.greatest(b / 10000 - 0.03, F.lit(0.0)).alias("x0"), F.least(b / 10000 + 0.2 + 0.03, F.lit(1.0)).alias("x1"))


PAIRS = r"""pairs AS (SELECT table_id, rows, flatten(list_transform(rows, lambda r: list_filter(list_transform(r, lambda c, i: {'name': list_filter(r[1:i-1], lambda y: y <> '' AND NOT regexp_full_match(y, '[A-Za-z]\d{3}(\(\d+\))?'))[-1], 'code': CASE WHEN regexp_full_match(c, '[A-Za-z]\d{3}(\(\d+\))?') THEN c END}),
 lambda p: p.name IS NOT NULL AND p.code IS NOT NULL))) AS pairs FROM order_tables)"""
RATIO = r"""coded AS (SELECT table_id, rows, len(list_filter(rows[2:], lambda r: regexp_full_match(list_filter(r, lambda c: c <> '')[1], '[A-Za-z]{1,2}\d{2,3}(\(\d+\))?'))) / len(rows[2:]) AS ratio FROM order_tables)"""
MARKDOWN = r"""md AS (SELECT table_id, rows, '| ' || array_to_string(rows[1], ' | ') || ' |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) AS markdown FROM order_tables)"""


@query(f"WITH {TABLES}, {PAIRS} SELECT table_id, list_transform(pairs, lambda p: p.name || '=' || p.code) AS pairs, len(pairs) >= 6 AS is_index FROM pairs")
def table_param_pairs(spark, sf):
    p = T.parameter_pairs(F.col("rows"))
    return order_tables(spark, sf).select("table_id", F.transform(p, lambda x: F.concat(x["name"], F.lit("="), x["code"])).alias("pairs"), T.is_index_table(F.col("rows")).alias("is_index"))


@query(f"""WITH {TABLES}, {PAIRS}, e AS (SELECT table_id, unnest(pairs) AS p, generate_subscripts(pairs, 1) AS i FROM pairs WHERE len(pairs) >= 6)
 SELECT table_id, CAST((i - 1) // 4 + 1 AS INT) AS part, list(p.code ORDER BY i) AS codes FROM e GROUP BY 1, 2""")
def table_split_by_parameter(spark, sf):
    t = order_tables(spark, sf).where(T.is_index_table(F.col("rows")))
    e = t.select("table_id", F.posexplode(T.parameter_pairs(F.col("rows"))).alias("i", "p"))
    g = e.groupBy("table_id", (F.floor(F.col("i") / T.PARAMETERS_A_PART) + 1).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "p.code"))).alias("c"))
    return g.select("table_id", "part", F.transform("c", lambda x: x["code"]).alias("codes"))


@query(f"WITH {TABLES}, {RATIO} SELECT table_id, round(ratio, 6) AS ratio, len(rows) - 1 >= 4 AND ratio >= 0.6 AS is_code FROM coded")
def table_coded_ratio(spark, sf):
    return order_tables(spark, sf).select("table_id", F.round(T.coded_row_ratio(F.col("rows")), 6).alias("ratio"), T.is_code_table(F.col("rows")).alias("is_code"))


@query(f"""WITH {TABLES}, {RATIO}, {PAIRS}, {MARKDOWN} SELECT c.table_id, len(p.pairs) >= 6 OR len(c.rows) - 1 >= 4 AND ratio >= 0.6 AND len(c.rows) - 1 > 3 OR len(c.rows) > 10 OR length(markdown) / 4 > 500 AS needs_split
 FROM coded c JOIN pairs p USING (table_id) JOIN md USING (table_id)""")
def table_needs_split(spark, sf):
    return order_tables(spark, sf).select("table_id", T.needs_split(F.col("rows"), T.markdown(F.col("rows"))).alias("needs_split"))


@query(f"""WITH {TABLES}, {RATIO}, s AS (SELECT table_id, rows, CASE WHEN len(rows) - 1 >= 4 AND ratio >= 0.6 THEN 3 ELSE 10 END AS k FROM coded), p AS (SELECT table_id, rows, k, unnest(generate_series(0, CAST(ceil((len(rows) - 1) / k) AS INT) - 1)) AS part FROM s)
 SELECT table_id, CAST(part + 1 AS INT) AS part, len(rows[2 + part * k : 1 + (part + 1) * k]) AS n_rows, rows[2 + part * k][2] AS first_code, 'filas ' || (part * k + 1) || '-' || least((part + 1) * k, len(rows) - 1) AS label FROM p""")
def table_split_rows(spark, sf):
    t = order_tables(spark, sf).withColumn("k", F.when(T.is_code_table(F.col("rows")), T.ROWS_A_CODE_PART).otherwise(T.ROWS_A_PART)).withColumn("data", T.data_rows(F.col("rows")))
    t = t.select("table_id", "data", "k", F.explode(F.sequence(F.lit(0), F.ceil(F.size("data") / F.col("k")).cast("int") - 1)).alias("i"))
    part = F.slice("data", F.col("i") * F.col("k") + 1, F.col("k"))
    label = F.concat(F.lit("filas "), (F.col("i") * F.col("k") + 1).cast("string"), F.lit("-"), F.least((F.col("i") + 1) * F.col("k"), F.size("data")).cast("string"))
    return t.select("table_id", (F.col("i") + 1).alias("part"), F.size(part).cast("long").alias("n_rows"), part[0][1].alias("first_code"), label.alias("label"))


@query(f"WITH {TABLES}, {MARKDOWN} SELECT table_id, markdown FROM md")
def table_markdown(spark, sf):
    return order_tables(spark, sf).select("table_id", T.markdown(F.col("rows")).alias("markdown"))


@query(rf"WITH {TABLES}, {MARKDOWN} SELECT table_id, trim(regexp_replace(replace(replace(markdown, '|', ' '), '-', ' ') || ' ' || array_to_string(flatten(rows), ' '), '\s+', ' ', 'g')) AS t FROM md")
def table_searchable_text(spark, sf):
    return order_tables(spark, sf).select("table_id", T.searchable(T.markdown(F.col("rows")), F.col("rows")).alias("t"))


@query(rf"""WITH {TABLES}, c AS (SELECT table_id, rows, regexp_replace(array_to_string(rows[1], ' '), '[^\p{{L}}]', '', 'g') AS a, array_to_string(rows[2], ' ') AS b FROM order_tables)
 SELECT table_id, length(a) > 0 AND (length(regexp_replace(b, '[^\d]', '', 'g')) > length(regexp_replace(b, '[^\p{{L}}]', '', 'g')) OR len(rows[1]) <= len(rows[2])) AS header FROM c""")
def table_header(spark, sf):
    return order_tables(spark, sf).select("table_id", T.has_header(F.col("rows")).alias("header"))


@query(f"WITH {TABLES}, {MARKDOWN} SELECT table_id, CASE WHEN table_id % 2 = 0 THEN rows ELSE list_concat([rows[1]], rows[2:]) END AS rows FROM md")
def table_header_reconcile(spark, sf):
    t = order_tables(spark, sf)
    given = F.when(F.col("table_id") % 2 == 0, F.col("rows")).otherwise(T.data_rows(F.col("rows")))
    return t.select("table_id", T.reconciled(T.markdown(F.col("rows")), given).alias("rows"))


LINKED = """g AS (SELECT *, CASE WHEN doc_id // 60 % 3 = 0 THEN 'fig' END AS fig FROM chunks), n AS (SELECT *, CASE WHEN fig = lag(fig) OVER w THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY file_name ORDER BY doc_id)),
 p AS (SELECT *, sum(new) OVER (PARTITION BY file_name ORDER BY doc_id) AS place FROM n), e AS (SELECT file_name, place, min_by(chunk_id, doc_id) AS f, max_by(chunk_id, doc_id) AS l FROM p GROUP BY 1, 2),
 k AS (SELECT file_name, place, coalesce(lag(l) OVER w, '') AS prev_id, coalesce(lead(f) OVER w, '') AS next_id FROM e WINDOW w AS (PARTITION BY file_name ORDER BY place))"""


@query(f"WITH {CHUNKS}, {LINKED} SELECT doc_id, prev_id, next_id FROM p JOIN k USING (file_name, place)")
def prev_next_links(spark, sf):
    c = chunks(spark, sf).withColumn("id", F.col("chunk_id")).withColumn("fig", F.when(F.expr("doc_id DIV 60 % 3 = 0"), "fig"))
    return L.linked_neighbours(c, "file_name", "doc_id", "fig").select("doc_id", "prev_id", "next_id")


@query(f"WITH {CHUNKS}, s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'section ' || doc_id END AS section FROM chunks) SELECT doc_id, last_value(section IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS filled_section FROM s")
def hierarchy_asof_fill(spark, sf):
    c = chunks(spark, sf).withColumn("section", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("section "), F.col("doc_id").cast("string"))))
    return L.filled_hierarchy(c, "file_name", "doc_id", "section").select("doc_id", "filled_section")


@query(f"""WITH {CHUNKS}, c AS (SELECT * FROM chunks WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 3), n AS (SELECT *, CASE WHEN doc_id - lag(doc_id) OVER (PARTITION BY file_name ORDER BY doc_id) > 20 THEN 1 ELSE 0 END AS new FROM c)
 SELECT doc_id, CAST(sum(new) OVER (PARTITION BY file_name ORDER BY doc_id) AS BIGINT) AS island FROM n""")
def page_groups_islands(spark, sf):
    return L.islands(chunks(spark, sf).where("doc_id % 7 <> 0 AND doc_id % 11 <> 3"), "file_name", "doc_id", 20).select("doc_id", "island")


@query("""WITH b AS (SELECT user_id, event_id, CAST(event_id AS VARCHAR) AS block_id FROM events WHERE event_type = 'view'), i AS (SELECT user_id, event_id, CAST(event_id AS VARCHAR) AS image_id FROM events WHERE event_type = 'click')
 SELECT i.image_id, b.block_id FROM i ASOF LEFT JOIN b ON i.user_id = b.user_id AND i.event_id >= b.event_id""")
def attach_image_to_block(spark, sf):
    e = read(spark, sf, "events")
    b = e.where("event_type = 'view'").select("user_id", "event_id", F.col("event_id").cast("string").alias("block_id"))
    i = e.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").cast("string").alias("image_id"))
    return L.attached_above(i, b, "user_id", "event_id").select("image_id", "block_id")


@query("""WITH n AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT user_id, event_id, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n WHERE p)
 SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) >= 2""")
def procedure_runs(spark, sf):
    e = read(spark, sf, "events").withColumn("t", F.when(F.col("event_type").isin("click", "view"), "paso 1").otherwise("other"))
    return L.procedure_runs(e, "user_id", "event_id", "t")


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY file_name, content_type ORDER BY md5('5-' || doc_id), doc_id) AS INT) AS pick FROM chunks QUALIFY pick <= 2")
def stratified_sample(spark, sf):
    return L.stratified(chunks(spark, sf).withColumn("id", F.col("doc_id")), ["file_name", "content_type"], 2, 5).select("doc_id", "pick")


@query("SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id LIMIT 500")
def newest_500(spark, sf):
    return L.newest(read(spark, sf, "events").select(F.col("event_id").alias("id"), "ts"), "ts", 500)


@query(rf"""WITH c AS (SELECT doc_id AS id, unnest([split_part(text, ' ', 1) || '?', split_part(text, ' ', 2)]) AS question, unnest([0, 1]) AS pos, doc_id FROM documents WHERE doc_id % 5 <> 2),
 n AS (SELECT *, trim(regexp_replace(regexp_replace({UNACCENT.format('question')}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM c) SELECT id, question, norm FROM n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) = 1""")
def question_explosion(spark, sf):
    d = read(spark, sf, "documents")
    w = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    c = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("order"), F.array(F.concat(w(1), F.lit("?")), w(2)).alias("questions"), (F.col("doc_id") % 5 == 2).alias("flagged"))
    return L.exploded_questions(c, X.normalised_question(F.col("question")))


@query("SELECT s_suppkey, list_transform(generate_series(s_suppkey % 5, s_suppkey % 5 + s_suppkey % 3), lambda n: 'SSR' || lpad(CAST(n AS VARCHAR), 2, '0')) AS codes FROM supplier")
def code_range_expansion(spark, sf):
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    a = F.col("s_suppkey") % 5
    return read(spark, sf, "supplier").select("s_suppkey", L.code_range(F.concat(F.lit("SSR"), pad(a), F.lit("–SSR"), pad(a + F.col("s_suppkey") % 3))).alias("codes"))


@query("""SELECT n_nationkey, unnest([n_name, 'hub']) AS origin, unnest(['hub', 'R' || n_regionkey]) AS target, unnest([false, true]) AS "both" FROM nation""")
def chain_to_edges(spark, sf):
    t = F.concat(F.col("n_name"), F.lit(" → hub ↔ R"), F.col("n_regionkey").cast("string"))
    return read(spark, sf, "nation").select("n_nationkey", F.explode(L.chain_edges(t)).alias("e")).select("n_nationkey", "e.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN generate_series(p_size, p_size + p_partkey % 4)::INT[] ELSE [p_size] END AS pages FROM part")
def page_range_expansion(spark, sf):
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + F.col("p_partkey") % 4).cast("string")
    t = F.when(F.col("p_partkey") % 4 == 0, F.concat(b, F.lit("-"), a)).when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit("-"), b)).otherwise(a)
    return read(spark, sf, "part").select("p_partkey", L.page_numbers(t).alias("pages"))


@query("""WITH f AS (SELECT conv_id, split_part(text, ' ', 1) AS s, min(turn) AS t FROM conversations WHERE split_part(text, ' ', 1) <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, s) AS n FROM f QUALIFY n <= 40)
 SELECT conv_id, string_agg(s, chr(10) ORDER BY n) AS outline FROM n GROUP BY 1""")
def document_outline(spark, sf):
    return L.outline(read(spark, sf, "conversations").withColumn("s", F.split_part("text", F.lit(" "), F.lit(1))), "conv_id", "turn", "s")


@query("SELECT doc_id AS id, 0 AS part FROM documents UNION ALL SELECT item_id, 1 FROM benchmark UNION ALL SELECT page_id, 2 FROM pages")
def corpus_union(spark, sf):
    one = lambda t, c: read(spark, sf, t).select(F.col(c).alias("id"))
    return L.corpus_union(one("documents", "doc_id"), one("benchmark", "item_id"), one("pages", "page_id"))


@query("""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'lost' WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (doc_id)""")
def run_diff(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    b = d.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("text")))
    return L.differences(d.where("doc_id % 5 <> 0"), b, ["doc_id"], "text").select("doc_id", "state")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'revised' ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0")
def review_filters(spark, sf):
    v = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "discard").otherwise("keep").alias("verdict"), F.when(F.col("toxic") == 1, "revised").alias("revised_text"))
    return L.reviewed(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), v).select(F.col("id").alias("doc_id"), "text")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size, p_partkey % 10 * 0 + p_partkey) AS INT) AS place FROM part")
def natural_order(spark, sf):
    from pyspark.sql import Window

    k = L.natural_key(F.concat(F.col("p_size").cast("string"), F.lit("-99")), F.concat(F.lit("chunk_"), F.col("p_partkey").cast("string")))
    return read(spark, sf, "part").select("p_partkey", F.row_number().over(Window.orderBy(k)).alias("place"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Tabla de ' || text ELSE text END AS t FROM conversations)
 SELECT conv_id, turn, list_filter(coalesce(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), lambda x: length(x) < 200 AND regexp_matches(lower(x), 'tabla|especificaciones')) AS context FROM c""")
def table_context(spark, sf):
    from pyspark.sql import Window

    c = read(spark, sf, "conversations").withColumn("t", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Tabla de "), "text")).otherwise(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return c.select("conv_id", "turn", T.nearby_table_names(F.collect_list("t").over(w)).alias("context"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' || chr(10) || 'INTERPRETADAS: a' || chr(10) || 'CONEXIONES: b' ELSE 'INTERPRETADAS: c' END AS text FROM documents")
def rubric_migration(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, "x\nCONEXIONES: a\nCONEXIONES: b").otherwise("INTERPRETADAS: c")
    return read(spark, sf, "documents").select("doc_id", X.relabelled(t, "CONEXIONES:", "INTERPRETADAS:").alias("text"))
