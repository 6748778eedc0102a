"""Language identification by Bayesian evidence fusion (operator 3).

Four kinds of evidence are fused for each page: the likelihood of its text under a byte-gram model of each language, the
language that its markup declares, the suffix of its address, and a prior of its host. How far declarations and suffixes can
be trusted and what a host's priors are is computed by grouped aggregation over all pages of the texts' posteriors:
P(declared | language), and P(language | host) smoothed towards P(language | address suffix) and that towards P(language),
with STRENGTH pages' weight each. The text model is fitted on a bounded sample, PER_LANGUAGE documents of each language that occurs.

Edge cases: null or empty html leaves the other evidence to decide; no declaration and no suffix are values of their own; a
null url has the host and suffix of no name; without labelled documents the language is null with confidence 0; repeated
rows are identified each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, in_arrow, texts
from .exact_dedup import attach
from .html_main import with_host

#: Documents of each language in the training sample.
PER_LANGUAGE = 200
GRAMS = 1 << 15
STRENGTH, FLOOR, TEMPER, CONTEXT = 10.0, 0.5, 0.25, 200.0
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|nav|footer|template)\b.*?</\1\s*>", re.S | re.I)
TAGS = re.compile(r"<[^>]*>")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte grams of three and four letters at every place, and the bounds of each text in places."""
    low, word = K.letters(data)
    low = np.where(word, low, 32).astype(np.uint8)
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))[: len(low)]
    half = np.uint64(GRAMS // 2)
    g = [(K.mix((eight & K.MASKS[k]) * K.GOLD + np.uint64(k)) % half).astype(np.int32) + int(half) * (k == 4) for k in (3, 4)]
    return np.stack(g, axis=1), offsets


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and the log probability of each gram in each."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND lang <> ''")
    names = sorted(r["lang"] for r in known.groupBy("lang").count().collect())
    counts = np.full((max(len(names), 1), GRAMS), 0.2)
    if names:
        picked = reduce(DataFrame.unionByName, [known.where(F.col("lang") == n).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LANGUAGE) for n in names])
        rows = texts(docs).join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").where("text IS NOT NULL").select("text", "lang").toArrow()
        for k, n in enumerate(names):
            mine = rows.filter(pa.compute.equal(rows["lang"], n))
            if mine.num_rows:
                g, _ = grams(*K.flat(mine["text"]))
                counts[k] += np.bincount(g.ravel(), minlength=GRAMS)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)


def visible(source: str) -> str:
    return entities.unescape(TAGS.sub(" ", HIDDEN.sub(" ", source)))


def evidence(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, suffix, declared, and the log likelihoods of the text in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, off = grams(*K.flat(pa.array([visible(s) for s in b["html"].to_pylist()], pa.string())))
            total = np.concatenate([np.zeros((1, len(names))), np.cumsum(model[g[:, 0]].astype(np.float64) + model[g[:, 1]], axis=0)])
            n = np.diff(off)
            ll = (total[off[1:]] - total[off[:-1]]) / np.maximum(n, 1)[:, None] * (TEMPER * np.minimum(n, CONTEXT))[:, None]
            ll -= ll.max(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["suffix"], b["declared"], pa.array(list(ll), pa.list_(pa.float64()))], ["page_id", "host", "suffix", "declared", "text_ll"])

    rows = with_host(pages)
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", 1))
    suffix = F.regexp_extract("host", r"\.([a-z0-9-]+)$", 1)
    return in_arrow(rows.select("page_id", "host", suffix.alias("suffix"), declared.alias("declared"), "html"), run, "page_id long, host string, suffix string, declared string, text_ll array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host of every page."""
    names, model = fit(docs)
    if not names:
        return with_host(pages).select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), "host")
    k = len(names)
    e = evidence(pages, names, model)
    e = e.withColumn("p", F.expr("transform(text_ll, x -> exp(x))")).withColumn("p", F.expr("transform(p, x -> x / aggregate(p, 0D, (a, y) -> a + y))"))
    e = cut(e, "evidence")
    sums = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(k)]
    columns = [F.col(f"p{i}") for i in range(k)]
    hosts = cut(e.groupBy("host", "suffix").agg(*sums, F.count("*").alias("pages")), "hosts")
    # One number for each language, so it is a literal; codes of two or three letters bound the table of declarations.
    sums_of_all = hosts.agg(*[F.sum(c) for c in columns]).first()
    all_p = F.array(*[F.lit(float(x or 0)) for x in sums_of_all])
    by_suffix = hosts.groupBy("suffix").agg(F.array(*[F.sum(c) for c in columns]).alias("suffix_p"))
    by_declared = F.broadcast(e.groupBy("declared").agg(F.array(*sums).alias("declared_p")))
    total = "aggregate({0}, 0D, (a, y) -> a + y)"
    prior = hosts.select("host", "suffix", "pages", F.array(*columns).alias("host_p")).join(by_suffix, "suffix").withColumn("all_p", all_p)
    prior = prior.withColumn("global_prior", F.expr(f"transform(all_p, x -> (x + 1) / ({total.format('all_p')} + {k}))"))
    prior = prior.withColumn("suffix_prior", F.expr(f"transform(suffix_p, (x, i) -> (x + {STRENGTH} * global_prior[i]) / ({total.format('suffix_p')} + {STRENGTH}))"))
    prior = prior.withColumn("host_prior", F.expr(f"transform(host_p, (x, i) -> ln((x + {STRENGTH} * suffix_prior[i]) / ({total.format('host_p')} + {STRENGTH})))")).select("host", "pages", "host_prior")
    out = attach(e, cut(prior, "priors"), "host", "pages").join(by_declared, "declared", "left").withColumn("all_p", all_p)
    out = out.withColumn("declared_ll", F.expr(f"transform(declared_p, (x, i) -> ln((x + {FLOOR}) / (all_p[i] + {FLOOR} * {k})))"))
    out = out.withColumn("score", F.expr("transform(text_ll, (x, i) -> x + host_prior[i] + declared_ll[i])"))
    best = "array_position(score, array_max(score))"
    lang = lambda at: F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    out = out.withColumn("confidence", F.expr("1 / aggregate(transform(score, x -> exp(x - array_max(score))), 0D, (a, y) -> a + y)"))
    return out.select("page_id", lang(F.expr(best)).alias("lang"), "confidence", lang(F.expr("array_position(text_ll, array_max(text_ll))")).alias("text_lang"), "declared", "host")
