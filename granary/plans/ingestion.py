"""Queries of sources, splitting, grouping and external functions. Those that SQL can't express are tested on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import chunking as C
from granary.operators import retrieval as R
from granary.sources import models as M
from granary.sources import readers as S

from .inputs import CHUNKS, chunks, read
from .registry import Registry

query = Registry()


@query("SELECT p_partkey, p_type AS stem FROM part WHERE NOT (p_partkey % 3 = 0 AND p_size % 2 = 0)")
def incremental_skip(spark, sf):
    p = read(spark, sf, "part")
    files = p.select("p_partkey", F.col("p_type").alias("stem"), F.concat_ws("-", F.col("p_partkey").cast("string"), (F.col("p_size") % 2).cast("string")).alias("sha256"))
    m = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("stem"), F.concat_ws("-", F.col("p_partkey").cast("string"), F.lit("0")).alias("sha256"), F.lit("success").alias("status"))
    return S.unprocessed(files, m).select("p_partkey", "stem")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red')")
def name_filter(spark, sf):
    return S.named(read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("name")), ["Ring", "RED"]).select("p_partkey")


@query("SELECT p_partkey, p_name AS logical, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS revision FROM part")
def logical_revisions(spark, sf):
    stem = F.concat(F.lit("12_"), F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" rev"), F.col("p_size").cast("string"))).otherwise(F.lit("")))
    logical, revision = S.logical_name(stem)
    return read(spark, sf, "part").select("p_partkey", logical.alias("logical"), revision.alias("revision"))


@query("""WITH f AS (SELECT p_partkey AS stem, p_name AS logical, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS revision FROM part), b AS (SELECT logical, max(revision) AS best, arg_max(stem, revision) AS by_ FROM f GROUP BY 1)
 SELECT stem, CASE WHEN best IS NOT NULL AND (revision IS NULL OR revision < best) THEN by_ END AS superseded_by FROM f JOIN b USING (logical)""")
def superseded_revisions(spark, sf):
    f = read(spark, sf, "part").select(F.col("p_partkey").alias("stem"), F.col("p_name").alias("logical"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")).alias("revision"))
    return S.superseded(f).select("stem", "superseded_by")


@query("SELECT user_id AS document, strftime(max(ts), '%Y%m%d_%H%M%S') AS run FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def latest_nonempty_run(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("document"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("run"), (F.col("event_id") % 3).alias("n_chunks"))
    return S.latest_runs(e)


@query("SELECT doc_id, source || '/page_' || lpad(CAST(doc_id // 60 AS VARCHAR), CAST(greatest(3, length(CAST(doc_id // 60 AS VARCHAR))) AS INT), '0') || '/' || substr(md5(text), 1, 12) || '.png' AS path FROM documents")
def media_paths(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", S.media_path(F.col("source"), F.expr("doc_id DIV 60"), F.col("text")).alias("path"))


@query(f"""WITH {CHUNKS}, c AS (SELECT *, file_name || '_' || page_num || '_' || chunk_id AS k FROM chunks WHERE doc_id % 13 <> 0)
 SELECT doc_id, 'text' AS index_name, CASE WHEN content_type = 'image' THEN k || '_desc' ELSE k END AS id FROM c UNION ALL SELECT doc_id, 'visual', k || '_visual' FROM c WHERE content_type = 'image'""")
def dual_routing(spark, sf):
    return S.routed(chunks(spark, sf).withColumn("has_vector", F.col("doc_id") % 13 != 0)).select("doc_id", "index_name", "id")


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) || '_visual' AS facet_id FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) || '_ocr' FROM documents WHERE doc_id % 4 = 0 AND doc_id % 8 = 0")
def diagram_facets(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "a wiring diagram").otherwise("a photo").alias("notes"), F.when(F.col("doc_id") % 8 == 0, "motor control panel").otherwise("x1 ~ 2").alias("ocr_text"))
    return S.facets(d).select(F.col("id").alias("doc_id"), "facet_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'revised' WHEN doc_id % 5 = 1 THEN '| a |' WHEN doc_id % 5 = 2 THEN 'x' || chr(9) || 'y' || chr(10) || 'z' ELSE text END AS readable,
 CASE WHEN doc_id % 7 = 0 THEN 'given' ELSE source || chr(10) || lang END AS embed FROM documents""")
def readable_and_embed_text(spark, sf):
    d, m = read(spark, sf, "documents"), F.col("doc_id") % 5
    text = S.readable(F.when(m == 0, "revised"), F.when(m == 1, "| a |"), F.when(m == 2, F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z")))), F.when(m == 3, F.lit(" ")), F.col("text"))
    return d.select("doc_id", text.alias("readable"), S.embed_text(F.when(F.col("doc_id") % 7 == 0, "given"), [F.col("source"), F.lit(" "), F.col("lang"), F.lit(None).cast("string")]).alias("embed"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'image' WHEN doc_id % 5 = 2 THEN 'table' ELSE 'text' END AS kind, CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS media FROM documents WHERE doc_id % 5 IN (2, 3) OR length(text) >= 5")
def media_references(spark, sf):
    c = chunks(spark, sf).select(F.col("doc_id").alias("id"), "content_type", F.col("original_chunk").alias("text"), F.when(F.col("content_type") == "image", "m.png").alias("media_path"))
    return S.media_references(c).select(F.col("id").alias("doc_id"), "kind", F.size("media").alias("media"))


@query("""SELECT conv_id * 1000 + turn AS id, right(lag(text) OVER w, 600) AS before, left(lead(text) OVER w, 600) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def enrichment_prompts(spark, sf):
    return S.prompts(read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("file_name"), F.col("turn").alias("ordinal"), "text"))


@query("""WITH p AS (SELECT doc_id % 50 AS f, length(trim(text)) >= 400 AS has, substr(text, 1, 4) AS sha FROM documents) SELECT f AS file_name, count(*) AS pages, count(*) FILTER (has) AS with_text, count(*) FILTER (NOT has) AS to_recognise, count(DISTINCT sha) AS images FROM p GROUP BY 1""")
def page_counters(spark, sf):
    d = read(spark, sf, "documents").select((F.col("doc_id") % 50).alias("file_name"), "text", F.array(F.substring("text", 1, 4)).alias("image_sha"))
    return S.page_counters(d, 400)


@query("""WITH RECURSIVE r AS (SELECT doc_id AS id, source AS file_name, doc_id // 60 AS page, length(text) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 g AS (SELECT file_name, id, page, n, 0 AS grp, len AS size FROM r WHERE n = 1 UNION ALL SELECT r.file_name, r.id, r.page, r.n, CASE WHEN r.page - g.page > 2 OR g.size + r.len > 8000 THEN g.grp + 1 ELSE g.grp END,
  CASE WHEN r.page - g.page > 2 OR g.size + r.len > 8000 THEN r.len ELSE g.size + r.len END FROM g JOIN r ON r.file_name = g.file_name AND r.n = g.n + 1) SELECT id, grp AS "group" FROM g""")
def page_proximity_groups(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), F.col("doc_id").alias("ordinal"), F.expr("CAST(doc_id DIV 60 AS INT)").alias("page"), F.length("text").cast("long").alias("length"))
    return C.page_groups(d, largest=8000).select("id", "group")


@query("SELECT p_partkey, CASE WHEN n <= 420 THEN [0]::INT[] ELSE list_distinct(list_transform(generate_series(0, least(CAST(ceil((n - 420) / 357) AS INT) + 1, 12) - 1), lambda i: CAST(least(i * 357, n - 420) AS INT))) END AS begins FROM (SELECT p_partkey, p_size * 60 AS n FROM part)".replace("list_distinct(", "list_sort(list_distinct(").replace("n - 420) AS INT))) END", "n - 420) AS INT)))) END"))
def tile_boxes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", C.tiles((F.col("p_size") * 60).cast("int")).alias("begins"))


@query("SELECT doc_id, bool_and(NOT (doc_id % 5 IN (0, 1)) OR doc_id < 500 OR doc_id % 2 = 0) OVER (PARTITION BY source) AS usable FROM documents")
def vector_alignment(spark, sf):
    c = chunks(spark, sf)
    v = c.where("doc_id < 500 OR doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.array(F.lit(1.0)).alias("vector"))
    return C.aligned_vectors(c.withColumn("id", F.col("doc_id")), v).select("doc_id", "usable")


@query()
def recursive_split(spark, sf):
    return C.split_chunks(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def fuzzy_dedup(spark, sf):
    """Greedy and exact within a document of fifty chunks."""
    c = chunks(spark, sf)
    return C.fuzzy_dedup(c.select(F.col("doc_id").alias("id"), F.expr("doc_id DIV 50").alias("file_name"), F.col("doc_id").alias("ordinal"), "content_type", F.col("original_chunk").alias("text")))


@query()
def semantic_groups(spark, sf):
    e = read(spark, sf, "embeddings")
    return C.semantic_groups(e.select(F.col("vec_id").alias("id"), F.expr("vec_id DIV 100").alias("file_name"), F.col("vec_id").alias("ordinal"), F.expr("CAST(vec_id DIV 4 AS INT)").alias("page"), F.col("embedding").alias("vector")), 0.4)


@query()
def superchunk_build(spark, sf):
    c = read(spark, sf, "conversations")
    m = c.select(F.col("conv_id").cast("string").alias("file_name"), F.expr("CAST(turn DIV 4 AS INT)").alias("group"), F.col("turn").alias("ordinal"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("chunk_id"), F.col("turn").alias("page"), "text")
    return C.superchunks(m)


@query()
def sheet_reader(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_custkey") % 40).cast("string").alias("file_name"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row"), F.array(F.col("o_orderpriority"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus")).alias("cells"))
    return S.sheet_chunks(o)


@query()
def file_name_match(spark, sf):
    n = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_brand"), F.lit("x")).alias("name"))
    return C.matched_names(n, read(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct())


@query()
def embedding_stub(spark, sf):
    return M.embedded(read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query()
def rerank_stub(spark, sf):
    from .retrieval import lexical

    hits = lexical(spark, sf).join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    r = M.reranked(hits)
    return R.ranked(r, [F.desc("rerank_score"), F.asc("doc_id")], 5, "position")


@query()
def completion_stub(spark, sf):
    return M.completed(read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt")))


@query(r"""WITH c AS (SELECT doc_id, 'chunk_' || doc_id AS cid, text AS t, lag('chunk_' || doc_id) OVER w AS p, lead('chunk_' || doc_id) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
 r AS (SELECT doc_id % 7 AS query_id, c.* FROM c), h AS (SELECT query_id, cid FROM r), u AS (SELECT cid, t FROM c WHERE doc_id % 11 <> 0),
 j AS (SELECT r.*, a.t AS pt, b.t AS nt FROM r LEFT JOIN u a ON a.cid = r.p AND (r.query_id, r.p) NOT IN (SELECT query_id, cid FROM h) LEFT JOIN u b ON b.cid = r.n AND (r.query_id, r.n) NOT IN (SELECT query_id, cid FROM h))
 SELECT query_id, doc_id, CASE WHEN coalesce(pt, nt) IS NULL THEN t ELSE concat_ws(chr(10) || chr(10), '[CONTEXTO PREVIO]' || chr(10) || pt, '[CHUNK RELEVANTE]' || chr(10) || t, '[CONTEXTO SIGUIENTE]' || chr(10) || nt) END AS expanded FROM j""")
def context_expand(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    c = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", "source")
    c = c.withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))
    rows = c.select((F.col("doc_id") % 7).alias("query_id"), "doc_id", "chunk_id", "text")
    out = R.expanded(rows, c.select("chunk_id", "prev_chunk_id", "next_chunk_id"), c.select("chunk_id", "text"), c.where("doc_id % 11 = 0").select("chunk_id"))
    return out.select("query_id", "doc_id", F.col("expanded_text").alias("expanded"))


@query("""WITH a AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS answers, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, CAST(len(coalesce(answers, [])) AS INT) AS answers, n AS turns, list_contains(list_transform(answers, lambda x: length(x) > 400), true) AS any_long FROM a""")
def conversation_history(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("a"), F.count("*").alias("turns"))
    return c.select("conv_id", F.size("a").alias("answers"), "turns", F.when(F.size("a") > 0, F.exists("a", lambda x: F.length(x["text"]) > 400)).alias("any_long"))


@query("""WITH g AS (SELECT source AS file_name, list_distinct(list(doc_id // 60)) AS pages FROM documents GROUP BY 1) SELECT file_name, list_sort(pages) AS pages FROM g""")
def files_and_pages(spark, sf):
    """Distinct pages of each file from aligned lists of files and pages (O-95)."""
    d = read(spark, sf, "documents").select(F.array("source", "source").alias("files"), F.array(F.expr("doc_id DIV 60"), F.expr("doc_id DIV 60")).alias("pages"))
    e = d.select(F.explode(F.arrays_zip("files", "pages")).alias("z"))
    return e.groupBy(F.col("z.files").alias("file_name")).agg(F.array_sort(F.collect_set("z.pages")).alias("pages"))


@query("SELECT DISTINCT vec_id - vec_id % 4 AS content_id, max(vec_id) OVER (PARTITION BY vec_id - vec_id % 4) AS media_id FROM embeddings")
def content_media_match(spark, sf):
    """Text hits with their figure by the base of the id (O-75): an equality join."""
    e = read(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") - F.col("vec_id") % 4).alias("base"))
    return e.select(F.col("base").alias("content_id")).distinct().join(e.groupBy(F.col("base").alias("content_id")).agg(F.max("vec_id").alias("media_id")), "content_id")


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 2) UNION SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0")
def detection_union(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.where("label IN (1, 2)").select("vec_id").union(e.where("vec_id % 5 = 0").select("vec_id")).distinct()
