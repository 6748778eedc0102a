"""Queries of ranked retrieval. Every fiftieth vector is a question; the vectors are the store, their labels the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import retrieval as R

from .inputs import read
from .registry import Registry

query = Registry()
KINDS = ("text", "synthetic_question", "table", "image")


def vectors(spark, sf):
    e = read(spark, sf, "embeddings")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.concat(F.lit("file_"), F.col("label").cast("string")).alias("file_name"), (F.col("vec_id") - F.col("vec_id") % 4).alias("parent"), kind.alias("content_type"))


def questions(spark, sf):
    return vectors(spark, sf).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector", "file_name")


def candidates(spark, sf, k: int = 40):
    """Nearest vectors with what the later stages want: the whole text of their parent, a rank of a text search for some."""
    c = R.knn(questions(spark, sf), vectors(spark, sf), k)
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("parent"), "text")
    c = c.join(docs, "parent", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return c.select(
        "query_id", "doc_id", "parent", "file_name", "content_type", "dense_similarity", "dense_rank", "text", F.col("dense_rank").alias("arrival"),
        F.when(F.col("doc_id") % 6 == 0, F.col("dense_rank")).alias("bm25_rank"), (F.col("content_type") == "image").alias("has_media"), F.col("dense_similarity").alias("quality"),
        F.when(F.col("content_type") == "synthetic_question", F.concat(F.lit("question "), F.col("doc_id").cast("string"))).alias("question"),
    )


VECTORS = """vectors AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, 'file_' || label AS file_name, vec_id - vec_id % 4 AS parent,
  ['text','synthetic_question','table','image'][CAST(vec_id % 4 + 1 AS INT)] AS content_type FROM embeddings)"""
SIMS = """sims AS (SELECT q.doc_id AS query_id, q.file_name AS query_file, d.doc_id, d.file_name, d.parent, d.content_type, round(list_cosine_similarity(q.v, d.v), 6) AS dense_similarity
  FROM vectors q, vectors d WHERE q.doc_id % 50 = 0)"""


def knn_sql(k: int, where: str = "true", name: str = "knn") -> str:
    return f"{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, doc_id) AS INT) AS dense_rank FROM sims WHERE {where} QUALIFY dense_rank <= {k})"


CANDIDATES = f"""{VECTORS}, {SIMS}, {knn_sql(40)}, cands AS (SELECT query_id, k.doc_id, parent, file_name, content_type, dense_similarity, dense_rank, coalesce(text, '') AS text,
  dense_rank AS arrival, CASE WHEN k.doc_id % 6 = 0 THEN dense_rank END AS bm25_rank, content_type = 'image' AS has_media, dense_similarity AS quality,
  CASE WHEN content_type = 'synthetic_question' THEN 'question ' || k.doc_id END AS question FROM knn k LEFT JOIN documents d ON d.doc_id = k.parent)"""
KEYS = ("query_id", "doc_id", "dense_similarity")


@query(f"WITH {VECTORS}, {SIMS}, {knn_sql(10)} SELECT query_id, doc_id, dense_similarity, dense_rank FROM knn")
def knn_top10(spark, sf):
    return R.knn(questions(spark, sf), vectors(spark, sf), 10).select("query_id", "doc_id", "dense_similarity", "dense_rank")


@query(f"WITH {VECTORS}, {SIMS}, {knn_sql(10, 'content_type <> ' + chr(39) + 'synthetic_question' + chr(39))} SELECT query_id, doc_id, dense_similarity, dense_rank FROM knn")
def knn_filtered(spark, sf):
    return R.knn(questions(spark, sf), vectors(spark, sf), 10, F.col("content_type") != "synthetic_question").select("query_id", "doc_id", "dense_similarity", "dense_rank")


@query(f"WITH {VECTORS}, {SIMS}, {knn_sql(10, 'content_type = ' + chr(39) + 'image' + chr(39))} SELECT query_id, doc_id, dense_similarity AS similarity, 0.0::DOUBLE AS dense_similarity, dense_rank AS visual_rank FROM knn")
def knn_visual(spark, sf):
    hits = R.knn(questions(spark, sf), vectors(spark, sf), 10, F.col("content_type") == "image")
    return hits.select("query_id", "doc_id", F.col("dense_similarity").alias("similarity"), F.lit(0.0).alias("dense_similarity"), F.col("dense_rank").alias("visual_rank"))


@query(f"""WITH {VECTORS}, {SIMS}, {knn_sql(10)}, e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, doc_id) AS n FROM sims WHERE file_name = query_file QUALIFY n <= 15)
 SELECT query_id, doc_id, dense_similarity, dense_rank FROM knn UNION ALL SELECT query_id, doc_id, dense_similarity, NULL FROM e WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM knn)""")
def knn_entity_bounded(spark, sf):
    q, v = questions(spark, sf), vectors(spark, sf)
    return R.with_entity_hits(R.knn(q, v, 10), q, v, 15, "file_name").select("query_id", "doc_id", "dense_similarity", "dense_rank")


BM25 = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w),
 p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM w) GROUP BY 1, 2),
 df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, st GROUP BY term, n), fl AS (SELECT 0.25 * avg(idf) AS f FROM df),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY 1, 2),
 sc AS (SELECT query_id, doc_id, round(sum(qtf * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS bm25_score FROM p JOIN qt USING (term) JOIN df USING (term), st, fl GROUP BY 1, 2),
 bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS INT) AS bm25_rank FROM sc QUALIFY bm25_rank <= 10)"""


def lexical(spark, sf, k: int = 10):
    return R.bm25(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), read(spark, sf, "documents").select("doc_id", "text"), k)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(bm25_score, 2) AS bm25_score, bm25_rank FROM bm")
def bm25_top10(spark, sf):
    return lexical(spark, sf).select("query_id", "doc_id", F.round("bm25_score", 2).alias("bm25_score"), "bm25_rank")


LISTS = f"""{VECTORS}, {SIMS}, {knn_sql(40)}, {knn_sql(20, 'doc_id % 3 = 0', 'lex')}, {knn_sql(15, 'content_type = ' + chr(39) + 'image' + chr(39), 'vis')},
 f AS (SELECT coalesce(k.query_id, l.query_id, v.query_id) AS query_id, coalesce(k.doc_id, l.doc_id, v.doc_id) AS doc_id, k.dense_rank, l.dense_rank AS bm25_rank, v.dense_rank AS visual_rank
  FROM knn k FULL JOIN lex l ON k.query_id = l.query_id AND k.doc_id = l.doc_id FULL JOIN vis v ON v.query_id = coalesce(k.query_id, l.query_id) AND v.doc_id = coalesce(k.doc_id, l.doc_id))"""


def lists(spark, sf):
    q, v = questions(spark, sf), vectors(spark, sf)
    other = lambda k, where, name: R.knn(q, v, k, where).withColumnRenamed("dense_rank", name)
    return {"dense": R.knn(q, v, 40), "bm25": other(20, F.col("doc_id") % 3 == 0, "bm25_rank"), "visual": other(15, F.col("content_type") == "image", "visual_rank")}


@query(f"""WITH {LISTS}, s AS (SELECT *, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + visual_rank), 0), 9) AS fused_score FROM f)
 SELECT query_id, doc_id, dense_rank, bm25_rank, visual_rank, fused_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, doc_id) AS INT) AS arrival FROM s""")
def rrf_fuse(spark, sf):
    return R.fused(lists(spark, sf))


@query(f"""WITH {LISTS}, s AS (SELECT *, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(0.3 / (60 + bm25_rank), 0) + coalesce(1.2 / (60 + visual_rank), 0), 9) AS fused_score FROM f)
 SELECT query_id, doc_id, fused_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, doc_id) AS INT) AS arrival FROM s""")
def rrf_weighted(spark, sf):
    return R.fused(lists(spark, sf), R.WEIGHTS).select("query_id", "doc_id", "fused_score", "arrival")


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id FROM cands WHERE file_name IN ('file_1', 'file_3') AND content_type = 'text'")
def metadata_filter(spark, sf):
    return candidates(spark, sf).where(R.metadata_filter({"file_name": ["file_1", "file_3"], "content_type": "text"})).select("query_id", "doc_id")


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id FROM cands QUALIFY substr(text, 1, 150) = '' OR row_number() OVER (PARTITION BY query_id, substr(text, 1, 150) ORDER BY dense_similarity DESC, doc_id) = 1")
def prefix150_dedup(spark, sf):
    return R.prefix_dedup(candidates(spark, sf), "dense_similarity").select("query_id", "doc_id")


@query(f"""WITH {CANDIDATES} SELECT query_id, doc_id, round(CASE WHEN doc_id % 5 = 0 THEN dense_similarity * 100 WHEN doc_id % 5 = 1 THEN 100 / (1 + exp(-(doc_id % 7 - 3 + 1.5) / 4)) WHEN dense_similarity > 0 THEN dense_similarity * 100 ELSE 1.0 / (60 + dense_rank) * 100 END, 6) AS score
 FROM (SELECT * FROM cands) WHERE doc_id % 5 <> 1 OR (doc_id % 7 - 1.5) NOT BETWEEN 0 AND 1""")
def display_score(spark, sf):
    c = candidates(spark, sf).withColumn("rerank", F.when(F.col("doc_id") % 5 == 0, F.col("dense_similarity")).when(F.col("doc_id") % 5 == 1, F.col("doc_id") % 7 - F.lit(1.5)))
    c = c.where("doc_id % 5 <> 1 OR rerank NOT BETWEEN 0 AND 1")
    c = c.withColumn("rerank", F.when(F.col("rerank").between(0, 1) | (F.col("doc_id") % 5 == 1), F.col("rerank")))
    return c.select("query_id", "doc_id", F.round(R.display_score(F.col("rerank").cast("double"), F.col("dense_similarity"), 1.0 / (60 + F.col("dense_rank"))), 6).alias("score"))


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id FROM cands WHERE NOT (content_type = 'synthetic_question' AND parent % 8 = 0)")
def drop_ungrounded(spark, sf):
    c = candidates(spark, sf).withColumn("parent_chunk_id", F.concat(F.lit("chunk_"), F.col("parent").cast("string"), F.when(F.col("parent") % 8 == 0, "_ocr").otherwise("")))
    return R.without_ungrounded(c).select("query_id", "doc_id")


COLLAPSED = """coll AS (SELECT query_id, parent, arg_max(doc_id, {'m': CAST(has_media AS INT), 'q': quality, 'a': -arrival}) AS doc_id, max(dense_similarity) AS dense_similarity, min(bm25_rank) AS bm25_rank, min(arrival) AS arrival,
  list_distinct(list(question ORDER BY arrival) FILTER (question IS NOT NULL)) AS questions FROM cands GROUP BY 1, 2)"""


@query(f"WITH {CANDIDATES}, {COLLAPSED} SELECT query_id, doc_id, dense_similarity, bm25_rank, arrival, coalesce(list_sort(questions), []) AS questions FROM coll")
def knn_overfetch_collapse(spark, sf):
    return R.collapsed(candidates(spark, sf), F.col("parent")).select("query_id", "doc_id", "dense_similarity", "bm25_rank", "arrival", F.array_sort("questions").alias("questions"))


CORE = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(rf"""WITH {CANDIDATES}, c AS (SELECT *, {CORE} AS core FROM cands), h AS (SELECT a.query_id, a.doc_id AS big, b.doc_id AS small, -CAST(a.has_media AS INT) AS m, -length(a.core) AS l, a.arrival AS ar, b.dense_similarity AS s FROM c a JOIN c b ON a.query_id = b.query_id AND a.file_name = b.file_name
  WHERE NOT b.has_media AND b.core <> '' AND contains(a.core, b.core) AND (-CAST(a.has_media AS INT), -length(a.core), a.arrival) < (-CAST(b.has_media AS INT), -length(b.core), b.arrival)),
 k AS (SELECT * FROM c WHERE (query_id, doc_id) NOT IN (SELECT query_id, small FROM h)), g AS (SELECT query_id, small, s, arg_min(big, {{'m': m, 'l': l, 'a': ar}}) AS doc_id FROM h WHERE (query_id, big) IN (SELECT query_id, doc_id FROM k) GROUP BY 1, 2, 3),
 gg AS (SELECT query_id, doc_id, max(s) AS s FROM g GROUP BY 1, 2) SELECT query_id, doc_id, greatest(dense_similarity, coalesce(s, dense_similarity)) AS dense_similarity FROM k LEFT JOIN gg USING (query_id, doc_id)""")
def contained_duplicates(spark, sf):
    return R.without_contained(candidates(spark, sf)).select(*KEYS)


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id, dense_similarity FROM cands QUALIFY max(dense_similarity) OVER (PARTITION BY query_id) >= 0.5 AND dense_similarity >= 0.5")
def gate_absolute(spark, sf):
    return R.gate_absolute(candidates(spark, sf)).select(*KEYS)


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id, dense_similarity FROM cands QUALIFY max(dense_similarity) OVER (PARTITION BY query_id) >= 0.5 AND (dense_similarity >= 0.5 OR bm25_rank IS NOT NULL)")
def gate_absolute_sparse(spark, sf):
    return R.gate_absolute(candidates(spark, sf), sparse=True).select(*KEYS)


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, dense_similarity >= max(dense_similarity) OVER w - 0.15 OR bm25_rank IS NOT NULL AS ok, row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, arrival, doc_id) AS n, count(*) OVER w AS t FROM cands WINDOW w AS (PARTITION BY query_id)),
 e AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) >= least(3, t) AS enough FROM r) SELECT query_id, doc_id, dense_similarity FROM e WHERE enough AND ok OR NOT enough AND n <= 3""")
def gate_relative_floor(spark, sf):
    return R.gate_relative(candidates(spark, sf)).select(*KEYS)


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, max(dense_similarity) OVER w AS best, first_value(file_name) OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, arrival) AS f FROM cands WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, doc_id, dense_similarity FROM r WHERE file_name IS NOT DISTINCT FROM f OR dense_similarity >= best - 0.1 OR bm25_rank IS NOT NULL""")
def gate_cross_doc(spark, sf):
    return R.gate_cross_document(candidates(spark, sf)).select(*KEYS)


@query(f"""WITH {CANDIDATES}, g AS (SELECT query_id, file_name, count(*) AS n, min(arrival) AS f FROM cands GROUP BY 1, 2) SELECT query_id, file_name AS dominant FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) = 1""")
def dominant_document(spark, sf):
    return R.dominant_file(candidates(spark, sf))


@query(f"""WITH {CANDIDATES}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, arrival, doc_id) AS place FROM cands),
 d AS (SELECT query_id, file_name AS dom FROM (SELECT query_id, file_name, count(*) AS n, min(place) AS f FROM p WHERE place <= 10 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) = 1),
 x AS (SELECT p.*, place <= 10 AS inn, file_name = dom AS own FROM p JOIN d USING (query_id)), m AS (SELECT *, greatest(2 - count(*) FILTER (inn AND NOT own) OVER (PARTITION BY query_id), 0) AS miss,
  row_number() OVER (PARTITION BY query_id, inn, own ORDER BY place) AS up, row_number() OVER (PARTITION BY query_id, inn, own ORDER BY place DESC) AS down FROM x),
 c AS (SELECT *, least(miss, count(*) FILTER (NOT inn AND NOT own) OVER (PARTITION BY query_id)) AS come FROM m)
 SELECT query_id, doc_id, dense_similarity FROM c WHERE inn AND NOT (own AND down <= come) OR NOT inn AND NOT own AND up <= come""")
def other_docs_quota(spark, sf):
    return R.other_document_quota(candidates(spark, sf)).select(*KEYS)


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id, dense_similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, arrival, doc_id) AS INT) AS position FROM cands QUALIFY position <= 5")
def final_top5(spark, sf):
    return R.top(candidates(spark, sf), 5).select(*KEYS, "position")


FUNNEL = f"""{CANDIDATES}, {COLLAPSED}, g AS (SELECT * FROM coll QUALIFY max(dense_similarity) OVER (PARTITION BY query_id) >= 0.5 AND dense_similarity >= 0.5),
 t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, arrival, doc_id) AS INT) AS position FROM g QUALIFY position <= 5)"""


def stages(spark, sf):
    c = candidates(spark, sf)
    one = R.collapsed(c, F.col("parent"))
    gated = R.gate_absolute(one)
    return [("dense", c), ("collapsed", one), ("gated", gated), ("final", R.top(gated, 5))]


@query(f"""WITH {FUNNEL}, n AS (SELECT query_id, (SELECT count(*) FROM cands x WHERE x.query_id = q.query_id) AS a, (SELECT count(*) FROM coll x WHERE x.query_id = q.query_id) AS b, (SELECT count(*) FROM g x WHERE x.query_id = q.query_id) AS c,
  (SELECT count(*) FROM t x WHERE x.query_id = q.query_id) AS d FROM (SELECT DISTINCT query_id FROM cands) q)
 SELECT query_id, 0 AS ordinal, 'dense' AS stage, a AS n_out, a AS n_in FROM n UNION ALL SELECT query_id, 1, 'collapsed', b, a FROM n UNION ALL SELECT query_id, 2, 'gated', c, b FROM n UNION ALL SELECT query_id, 3, 'final', d, c FROM n""")
def funnel_counts(spark, sf):
    return R.funnel(stages(spark, sf)).select("query_id", "ordinal", "stage", "n_out", "n_in")


@query(f"WITH {FUNNEL} SELECT query_id, doc_id, dense_similarity, position FROM t")
def retrieval_funnel(spark, sf):
    """The flagship: search, collapse, gate, top."""
    return stages(spark, sf)[-1][1].select(*KEYS, "position")


@query(f"""WITH {CANDIDATES} SELECT query_id, file_name, CAST(doc_id % 5 AS VARCHAR) AS page_num, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY arrival) AS chunk_ids, max(dense_similarity) AS dense_similarity,
 CAST(count(*) FILTER (has_media) AS INT) AS media FROM cands GROUP BY 1, 2, 3""")
def page_mode_group(spark, sf):
    c = candidates(spark, sf).withColumn("page_num", (F.col("doc_id") % 5).cast("string")).withColumn("chunk_id", F.col("doc_id")).withColumn("media_path", F.when(F.col("has_media"), F.lit("m.png")))
    return R.by_page(c).select("query_id", "file_name", "page_num", "chunk_ids", "dense_similarity", F.size("media").alias("media"))


@query(f"""WITH {CANDIDATES}, v AS (SELECT doc_id, file_name, doc_id % 9 AS page_num FROM vectors) SELECT query_id, c.doc_id AS hit_id, v.doc_id, CAST(row_number() OVER (PARTITION BY query_id, c.doc_id ORDER BY v.doc_id) AS INT) AS n
 FROM cands c JOIN v ON v.file_name = c.file_name AND v.page_num = c.doc_id % 9 WHERE c.dense_rank <= 5 AND v.doc_id <> c.doc_id QUALIFY n <= 10""")
def per_page_related(spark, sf):
    hits = candidates(spark, sf).where("dense_rank <= 5").withColumn("page_num", F.col("doc_id") % 9)
    return R.related_chunks(hits, vectors(spark, sf).withColumn("page_num", F.col("doc_id") % 9)).select("query_id", "hit_id", "doc_id", "n")


@query(f"""WITH {CANDIDATES}, c AS (SELECT query_id, doc_id, dense_similarity, arrival FROM cands WHERE arrival IN (1, 3, 4)) SELECT query_id, doc_id, CAST(arrival AS INT) AS position, round(avg(dense_similarity) OVER (PARTITION BY query_id), 6) AS mean_similarity FROM c""")
def source_assembly(spark, sf):
    c = candidates(spark, sf).withColumn("position", F.col("arrival"))
    cites = c.select("query_id").distinct().withColumn("cited", F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(999)))
    return R.cited_sources(cites, c).select("query_id", "doc_id", "position", "mean_similarity")


@query(f"""WITH {CANDIDATES}, r AS (SELECT query_id, doc_id, dense_similarity, query_id % 100 = 0 AND doc_id % 4 = 1 AS cited, CASE WHEN has_media THEN 'm' || doc_id % 3 ELSE CAST(doc_id AS VARCHAR) END AS mk FROM cands),
 a AS (SELECT *, bool_or(cited) OVER (PARTITION BY query_id) AS anyc FROM r), d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, mk ORDER BY cited DESC, dense_similarity DESC, doc_id) = 1),
 p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, dense_similarity DESC, doc_id) AS INT) AS place FROM d) SELECT query_id, doc_id, place FROM p WHERE anyc OR place <= 3""")
def source_order(spark, sf):
    c = candidates(spark, sf).withColumn("cited", (F.col("query_id") % 100 == 0) & (F.col("doc_id") % 4 == 1)).withColumn("media_key", F.when(F.col("has_media"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))))
    return R.ordered_sources(c).select("query_id", "doc_id", "place")


@query(f"""WITH {CANDIDATES}, c AS (SELECT query_id, doc_id, parent, question FROM cands WHERE content_type = 'synthetic_question') SELECT c.query_id, c.doc_id, v.doc_id AS parent_id, v.file_name, question FROM c JOIN vectors v ON v.doc_id = c.parent""")
def parent_restore(spark, sf):
    c = candidates(spark, sf).where("content_type = 'synthetic_question'").select("query_id", "doc_id", "file_name", F.lit("1").alias("page_num"), F.col("parent").cast("string").alias("parent_chunk_id"), F.col("doc_id").cast("string").alias("chunk_id"), "question", "text")
    v = vectors(spark, sf)
    content = v.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("1").alias("page_num"), F.col("file_name").alias("parent_file"), F.lit(None).cast("string").alias("text"))
    files = v.select(F.col("doc_id").cast("string").alias("parent_chunk_id"), F.col("file_name").alias("f2"))
    c = c.join(files, "parent_chunk_id").drop("file_name").withColumnRenamed("f2", "file_name")
    return R.restored(c, content.withColumnRenamed("parent_file", "file_name")).select("query_id", "doc_id", F.col("chunk_id").cast("long").alias("parent_id"), "file_name", "question")
