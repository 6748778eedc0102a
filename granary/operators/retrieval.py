"""Ranked retrieval for many questions at once: searches, fusion, collapse, gates, quota, traces (O-50, O-51, O-70 to O-75, O-94,
O-104 to O-122, O-165). Candidate frames have query_id, doc_id and arrival, the place in the list at that stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import vectors as V

RRF_K = 60
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Weights of the lists in the weighted fusion.
WEIGHTS = {"dense": 1.0, "bm25": 0.3, "visual": 1.2}
#: Bound of a broadcast query set in rows; larger sets are joined in so many blocks.
QUERY_BLOCK = 10_000


def metadata_filter(conditions: dict) -> Column:
    """A scalar is equality, a list any of its values, several conditions all of them (O-50, O-51). A missing value is no match."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k).eqNullSafe(F.lit(v)) for k, v in conditions.items()]
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def ranked(df: DataFrame, order: list[Column], k: int | None, name: str) -> DataFrame:
    """Numbers the rows of each query from 1; the first k if given, which Spark takes before the shuffle as well."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The query set in parts small enough to broadcast."""
    n = -(-queries.count() // QUERY_BLOCK)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def knn(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k nearest vectors of each query by cosine, exactly (O-105, O-108). queries: query_id, vector; vectors: doc_id, vector and
    more. The filter is below the distances. Each block of the query set is broadcast, the vectors are read where they are,
    and each task keeps k rows a query."""
    v = vectors if where is None else vectors.where(where)
    v = v.withColumn("vector", V.as_doubles(F.col("vector"))).withColumn("__norm", V.norm(F.col("vector")))
    out = []
    for part in query_blocks(queries):
        q = part.select("query_id", V.as_doubles(F.col("vector")).alias("__q")).withColumn("__qn", V.norm(F.col("__q")))
        sim = F.round(F.try_divide(V.dot(F.col("__q"), F.col("vector")), F.col("__qn") * F.col("__norm")), 6)
        rows = v.join(F.broadcast(q), F.lit(True)).withColumn("dense_similarity", sim).drop("vector", "__q", "__qn", "__norm")
        out.append(ranked(rows, [F.desc("dense_similarity"), F.asc("doc_id")], k, "dense_rank"))
    return reduce(DataFrame.unionByName, out)


def with_entity_hits(first: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, tag: str) -> DataFrame:
    """first, and the k nearest vectors that share a query's tag and are not in it yet (O-106). They keep their similarity, so
    that gates can let them in."""
    sim = F.round(V.cosine(V.as_doubles(F.col("vector")), V.as_doubles(F.col("__q"))), 6)
    q = queries.select("query_id", F.col(tag).alias("__tag"), F.col("vector").alias("__q"))
    rows = vectors.join(q, F.col(tag) == F.col("__tag")).withColumn("dense_similarity", sim).drop("vector", "__q", "__tag")
    hits = ranked(rows, [F.desc("dense_similarity"), F.asc("doc_id")], k, "entity_rank")
    fresh = hits.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return first.unionByName(fresh, allowMissingColumns=True)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query by Okapi BM25 (O-107); terms that a query repeats count as often. Only
    the query set's terms, broadcast in blocks, are kept of the texts before anything is shuffled; the terms' document counts are cached."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    n, avg = words.agg(F.count("*"), F.avg(F.size("t"))).first()
    df = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = df.withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).persist()
    floor = EPSILON * (df.agg(F.avg("idf")).first()[0] or 0.0)
    idf = df.select("term", F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")).alias("idf"))
    out = []
    for part in query_blocks(queries):
        q = part.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(idf, "term")
        asked = F.broadcast(q.select("term").distinct())
        postings = words.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        hits = postings.join(F.broadcast(q), "term")
        score = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (avg or 1.0)))
        scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("bm25_score"))
        out.append(ranked(scored, [F.desc("bm25_score"), F.asc("doc_id")], k, "bm25_rank"))
    return reduce(DataFrame.unionByName, out)


def fused(lists: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of lists by name, each with query_id, doc_id and <name>_rank (O-109, O-110). A rank is null where a list
    does not have the document."""
    out = reduce(lambda a, b: a.join(b, ["query_id", "doc_id"], "full"), [d.select("query_id", "doc_id", f"{n}_rank") for n, d in lists.items()])
    parts = [F.coalesce(F.lit((weights or {}).get(n, 1.0)) / (RRF_K + F.col(f"{n}_rank")), F.lit(0.0)) for n in lists]
    out = out.withColumn("fused_score", F.round(reduce(lambda a, b: a + b, parts), 9))
    return ranked(out, [F.desc("fused_score"), F.asc("doc_id")], None, "arrival")


def prefix_dedup(rows: DataFrame, score: str, n: int = 150) -> DataFrame:
    """Of rows of one query with equal first n characters the best; rows without text all stay (O-111)."""
    keyed = rows.withColumn("__p", F.substring("text", 1, n)).withColumn("__p", F.when(F.length("__p") > 0, F.col("__p")).otherwise(F.concat(F.lit("\0"), F.col("doc_id").cast("string"))))
    w = Window.partitionBy("query_id", "__p").orderBy(F.desc(score), F.asc("doc_id"))
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__p")


def display_score(rerank: Column, dense: Column, fused_score: Column) -> Column:
    """Score from 0 to 100 (O-113): of a reranker in 0 to 1 as it is, else its logistic; else the similarity, else the fused score."""
    r = F.when(rerank.between(0, 1), rerank * 100).when(rerank.isNotNull(), 100 / (1 + F.exp(-rerank / 4)))
    return F.coalesce(r, F.when(dense > 0, dense * 100), fused_score * 100)


def without_ungrounded(rows: DataFrame) -> DataFrame:
    """Without questions whose parent is recognised text of a figure (O-114)."""
    bad = (F.col("content_type") == "synthetic_question") & F.coalesce(F.col("parent_chunk_id"), F.lit("")).endswith("_ocr")
    return rows.where(~F.coalesce(bad, F.lit(False)))


def facet_base(chunk_id: Column) -> Column:
    """chunk_3 of chunk_3_visual and the like; null where an id is not a facet."""
    base = F.regexp_extract(chunk_id, r"^(.*)_(?:visual|ocr|desc)$", 1)
    return F.when(base != "", base)


def restored(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Questions with their parent's row, and facets with their figure's visual one where it stands (O-70, O-71). content: file_name,
    page_num, chunk_id, text. Keeps the question; text and chunk_id become those of the row that was found."""
    r = rows.withColumn("__id", F.coalesce("parent_chunk_id", "chunk_id"))
    side = lambda n: content.select(F.col("file_name").alias(f"__f{n}"), F.col("page_num").alias(f"__p{n}"), F.col("chunk_id").alias(f"__c{n}"), F.col("text").alias(f"__t{n}"))
    on = lambda n, key: (F.col("file_name") == F.col(f"__f{n}")) & (F.col("page_num") == F.col(f"__p{n}")) & (key == F.col(f"__c{n}"))
    visual = F.when(~F.col("__id").endswith("_visual"), F.concat(facet_base(F.col("__id")), F.lit("_visual")))
    r = r.join(side(1), on(1, F.col("__id")), "left").join(side(2), on(2, visual), "left")
    out = r.withColumn("chunk_id", F.coalesce("__c2", F.when(F.col("parent_chunk_id").isNotNull(), F.col("__c1")), "chunk_id")).withColumn("text", F.coalesce("__t2", "text", "__t1"))
    return out.drop("__id", *(f"__{c}{n}" for c in "fpct" for n in (1, 2)))


def expanded(rows: DataFrame, links: DataFrame, texts: DataFrame, shunned: DataFrame) -> DataFrame:
    """Rows with the text of the chunks before and after, marked; without those that the query's rows have themselves and those of
    shunned (chunk_id), such as repeated page heads (O-72, O-73). links: chunk_id, prev_chunk_id, next_chunk_id; texts: chunk_id, text."""
    r = rows.join(links, "chunk_id", "left")
    here = rows.select("query_id", F.col("chunk_id").alias("__n")).distinct()
    usable = texts.join(shunned, "chunk_id", "left_anti")
    for side in ("prev", "next"):
        key = f"{side}_chunk_id"
        others = r.select("query_id", F.col(key).alias("__n")).where("__n IS NOT NULL").distinct().join(here, ["query_id", "__n"], "left_anti")
        found = others.join(usable.select(F.col("chunk_id").alias("__n"), F.col("text").alias(f"__{side}")), "__n").withColumnRenamed("__n", key).withColumnRenamed("query_id", "__q")
        r = r.join(found, (r["query_id"] == found["__q"]) & (r[key] == found[key]), "left").drop("__q", found[key])
    mark = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label + "\n"), F.col(c)))
    body = F.concat_ws("\n\n", mark("[CONTEXTO PREVIO]", "__prev"), mark("[CHUNK RELEVANTE]", "text"), mark("[CONTEXTO SIGUIENTE]", "__next"))
    return r.withColumn("expanded_text", F.when(F.coalesce("__prev", "__next").isNotNull(), body).otherwise(F.col("text"))).drop("__prev", "__next")


def collapsed(rows: DataFrame, key: Column) -> DataFrame:
    """One row of each group: the best by media and quality, the earliest of ties; the group's best similarity and ranks, and its
    questions in order of arrival (O-115). rows: doc_id, has_media, quality, dense_similarity, bm25_rank, question, arrival."""
    order = F.struct(F.col("has_media").cast("int"), F.coalesce("quality", F.lit(0.0)), -F.col("arrival"))
    g = rows.withColumn("__key", key).groupBy("query_id", "__key").agg(
        F.max_by("doc_id", order).alias("doc_id"),
        F.max(F.coalesce("dense_similarity", F.lit(0.0))).alias("dense_similarity"),
        F.min("bm25_rank").alias("bm25_rank"),
        F.min("arrival").alias("arrival"),
        F.array_sort(F.collect_list(F.when(F.col("question").isNotNull(), F.struct("arrival", "question")))).alias("__q"),
    )
    return g.withColumn("questions", F.array_distinct(F.transform("__q", lambda x: x["question"]))).drop("__q", "__key")


def core_text(text: Column) -> Column:
    """What stands between the marker of the relevant chunk and the next one, in lower case with single spaces."""
    inner = F.regexp_extract(text, r"(?s)\[CHUNK RELEVANTE\](.*?)(?:\[CONTEXTO SIGUIENTE\]|$)", 1)
    return F.trim(F.regexp_replace(F.lower(F.when(F.contains(text, F.lit("[CHUNK RELEVANTE]")), inner).otherwise(F.coalesce(text, F.lit("")))), r"\s+", " "))


def without_contained(rows: DataFrame) -> DataFrame:
    """Without rows whose core is part of a kept row's of the same query and file; media and empty ones stay (O-116). A row has the best
    similarity of those that it holds first. Containment is transitive, so what is in a dropped row is in a kept one, too."""
    r = rows.withColumn("__core", core_text(F.col("text"))).withColumn("__order", F.struct((-F.col("has_media").cast("int")).alias("m"), (-F.length("__core")).alias("l"), F.col("arrival").alias("a")))
    small = r.where("NOT has_media AND __core <> ''").select("query_id", "file_name", F.col("doc_id").alias("__d"), F.col("__core").alias("__c"), F.col("__order").alias("__o"), F.col("dense_similarity").alias("__s"))
    holds = r.join(small, ["query_id", "file_name"]).where(F.col("__order") < F.col("__o")).where(F.contains("__core", "__c"))
    dropped = holds.select("query_id", F.col("__d").alias("doc_id")).distinct()
    kept = r.join(dropped, ["query_id", "doc_id"], "left_anti")
    heirs = holds.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id", "__d").agg(F.min_by("doc_id", "__order").alias("doc_id"), F.first("__s").alias("__s"))
    gain = heirs.groupBy("query_id", "doc_id").agg(F.max("__s").alias("__gain"))
    out = kept.join(gain, ["query_id", "doc_id"], "left").withColumn("dense_similarity", F.greatest("dense_similarity", F.coalesce("__gain", "dense_similarity")))
    return out.drop("__core", "__order", "__gain")


def gate_absolute(rows: DataFrame, least: float = 0.5, sparse: bool = False) -> DataFrame:
    """Rows of at least the similarity; with sparse also those that a text search found, where any row passes (O-117)."""
    d = F.coalesce(F.col("dense_similarity"), F.lit(0.0))
    best = F.max(d).over(Window.partitionBy("query_id"))
    ok = (d >= least) | (F.col("bm25_rank").isNotNull() if sparse else F.lit(False))
    return rows.withColumn("__ok", ok & (best >= least)).where("__ok").drop("__ok")


def gate_relative(rows: DataFrame, margin: float = 0.15, floor: int = 3) -> DataFrame:
    """Rows within a margin of the best, and those of a text search; where fewer than floor are left, the floor best (O-118)."""
    w = Window.partitionBy("query_id")
    d = F.coalesce(F.col("dense_similarity"), F.lit(0.0))
    r = rows.withColumn("__ok", (d >= F.max(d).over(w) - margin) | F.col("bm25_rank").isNotNull())
    r = r.withColumn("__n", F.count_if("__ok").over(w)).withColumn("__all", F.count(F.lit(1)).over(w)).withColumn("__rank", F.row_number().over(w.orderBy(d.desc(), F.asc("arrival"), F.asc("doc_id"))))
    enough = F.col("__n") >= F.least(F.lit(floor), F.col("__all"))
    return r.where((enough & F.col("__ok")) | (~enough & (F.col("__rank") <= floor))).drop("__ok", "__n", "__all", "__rank")


def gate_cross_document(rows: DataFrame, margin: float = 0.10) -> DataFrame:
    """Rows of the file of the first best row, those within a margin of it, and those of a text search (O-119)."""
    w = Window.partitionBy("query_id")
    d = F.coalesce(F.col("dense_similarity"), F.lit(0.0))
    r = rows.withColumn("__best", F.max(d).over(w)).withColumn("__file", F.max_by("file_name", F.struct(d, -F.col("arrival"))).over(w))
    return r.where(F.col("file_name").eqNullSafe(F.col("__file")) | (d >= F.col("__best") - margin) | F.col("bm25_rank").isNotNull()).drop("__best", "__file")


def dominant_file(rows: DataFrame) -> DataFrame:
    """query_id, file_name of the most frequent file; of ties the one that came first (O-104)."""
    g = rows.groupBy("query_id", "file_name").agg(F.count("*").alias("n"), F.min("arrival").alias("first"))
    return g.groupBy("query_id").agg(F.max_by("file_name", F.struct("n", -F.col("first"))).alias("dominant"))


def other_document_quota(rows: DataFrame, top_k: int = 10, quota: int = 2) -> DataFrame:
    """The top_k rows, with seats for rows of other files than the dominant one: as many of these as are missing come in from the
    tail, and as many of the dominant file's lowest go (O-120)."""
    d = F.coalesce(F.col("dense_similarity"), F.lit(0.0))
    w = Window.partitionBy("query_id")
    r = rows.withColumn("__place", F.row_number().over(w.orderBy(d.desc(), F.asc("arrival"), F.asc("doc_id"))))
    top = r.where(F.col("__place") <= top_k)
    r = r.join(dominant_file(top.withColumn("arrival", F.col("__place"))), "query_id", "left")
    r = r.withColumn("__in", F.col("__place") <= top_k).withColumn("__own", F.col("file_name").eqNullSafe(F.col("dominant")))
    r = r.withColumn("__missing", F.greatest(F.lit(quota) - F.count_if(F.col("__in") & ~F.col("__own")).over(w), F.lit(0)))
    side = Window.partitionBy("query_id", "__in", "__own")
    r = r.withColumn("__up", F.row_number().over(side.orderBy("__place"))).withColumn("__down", F.row_number().over(side.orderBy(F.desc("__place"))))
    tail = F.col("__in") == False  # noqa: E712
    r = r.withColumn("__come", F.least("__missing", F.coalesce(F.max(F.when(tail & ~F.col("__own"), F.col("__up"))).over(w), F.lit(0))))
    stays = F.col("__in") & ~(F.col("__own") & (F.col("__down") <= F.col("__come")))
    comes = tail & ~F.col("__own") & (F.col("__up") <= F.col("__come"))
    return r.where(stays | comes).drop("dominant", *(c for c in r.columns if c.startswith("__")))


def top(rows: DataFrame, k: int, by: str = "dense_similarity") -> DataFrame:
    """The k best rows of each query in order; ties by arrival and id (O-121)."""
    return ranked(rows, [F.desc_nulls_last(by), F.asc("arrival"), F.asc("doc_id")], k, "position")


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows that go in and out of each stage for each query (O-122)."""
    counts = [d.groupBy("query_id").agg(F.count("*").alias("n_out")).withColumn("ordinal", F.lit(i)).withColumn("stage", F.lit(n)) for i, (n, d) in enumerate(stages)]
    queries = stages[0][1].select("query_id").distinct()
    grid = queries.select("query_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("stage")) for i, (n, _) in enumerate(stages)])).alias("s")).select("query_id", "s.*")
    out = grid.join(reduce(DataFrame.unionByName, counts), ["query_id", "ordinal", "stage"], "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)).cast("long"))
    return out.withColumn("n_in", F.coalesce(F.lag("n_out").over(Window.partitionBy("query_id").orderBy("ordinal")), F.col("n_out")))


def by_page(rows: DataFrame) -> DataFrame:
    """One row for each file and page of a query: ids and texts in order of arrival, the best similarity, media (O-94)."""
    item = F.struct("arrival", "chunk_id", "text", "media_path")
    g = rows.groupBy("query_id", "file_name", "page_num").agg(F.array_sort(F.collect_list(item)).alias("i"), F.max("dense_similarity").alias("dense_similarity"))
    join = lambda f, sep: F.array_join(F.transform("i", lambda x: x[f].cast("string")), sep)
    media = F.filter(F.transform("i", lambda x: x["media_path"]), lambda m: m.isNotNull())
    return g.select("query_id", "file_name", "page_num", join("chunk_id", ",").alias("chunk_ids"), join("text", "\n\n").alias("text"), "dense_similarity", media.alias("media"))


def related_chunks(hits: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """For each hit the first chunks of its file and page (O-136)."""
    rows = hits.select("query_id", F.col("doc_id").alias("hit_id"), "file_name", "page_num").join(chunks.select("file_name", "page_num", "doc_id"), ["file_name", "page_num"]).where("doc_id <> hit_id")
    w = Window.partitionBy("query_id", "hit_id").orderBy("doc_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def cited_sources(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context rows that an answer cites by place from 1, and the answer's mean similarity (O-165). citations: query_id, cited (array)."""
    c = citations.select("query_id", F.posexplode("cited").alias("at", "position"))
    hit = c.join(contexts, ["query_id", "position"])
    return hit.withColumn("mean_similarity", F.round(F.avg("dense_similarity").over(Window.partitionBy("query_id")), 6))


def ordered_sources(rows: DataFrame, fallback: int = 3) -> DataFrame:
    """Cited rows first, then by similarity, one of each media key; without a citation the first rows (O-135). rows: cited, media_key."""
    w = Window.partitionBy("query_id")
    r = rows.withColumn("__any", F.max(F.col("cited").cast("int")).over(w) == 1)
    order = [F.desc("cited"), F.desc("dense_similarity"), F.asc("doc_id")]
    r = r.withColumn("__m", F.row_number().over(Window.partitionBy("query_id", F.coalesce("media_key", F.col("doc_id").cast("string"))).orderBy(*order))).where("__m = 1")
    r = r.withColumn("place", F.row_number().over(w.orderBy(*order)))
    return r.where(F.col("__any") | (F.col("place") <= fallback)).drop("__any", "__m")
