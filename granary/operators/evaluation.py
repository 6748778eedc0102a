"""Evaluation and review: ranks of gold pages, metrics, remapping, triage, verdicts and run states (O-103, O-132 to O-134, O-146, O-147,
O-160, O-161, O-163, O-164, O-168, O-169)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X

# Answers that are refusals, and the similarity from which an answer is one.
REFUSALS = ["I don't know.", "None"]
REFUSAL = 60
#: Characters of all items up to which their grams are broadcast.
MOST_BROADCAST = 4 << 20


def gold_rank(results: DataFrame, items: DataFrame) -> DataFrame:
    """First position of a row of the gold file whose page, or either end of its range, is a gold page; null where none is (O-132).
    results: item_id, position, file_name, page_num; items: item_id, gold_file, gold_pages."""
    p = F.col("page_num").cast("string")
    ends = F.array_distinct(F.filter(F.array(p, F.split_part(p, F.lit("-"), F.lit(1)), F.split_part(p, F.lit("-"), F.lit(2))), lambda x: x != ""))
    hit = results.join(items, "item_id").where((F.col("file_name") == F.col("gold_file")) & F.arrays_overlap(ends, "gold_pages"))
    first = hit.groupBy("item_id").agg(F.min("position").alias("rank"))
    return items.join(first, "item_id", "left")


def metrics(ranks: DataFrame, by: list[str] | None = None, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at cutoffs, mean reciprocal rank, items never found and the median rank (O-103). No items give no row for a group."""
    recall = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in cutoffs]
    rest = [F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("never"), F.median("rank").alias("median_rank"), F.count("*").alias("n")]
    return ranks.groupBy(*(by or [])).agg(*recall, *rest)


def compared(a: DataFrame, b: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Two variants' metrics and their differences (O-168)."""
    j = a.select(key, *[F.col(n).alias(f"{n}_a") for n in names]).join(b.select(key, *[F.col(n).alias(f"{n}_b") for n in names]), key, "full")
    return j.select(key, *[c for n in names for c in (f"{n}_a", f"{n}_b")], *[F.round(F.col(f"{n}_b") - F.col(f"{n}_a"), 6).alias(f"{n}_delta") for n in names])


def best_containment(items: DataFrame, chunks: DataFrame, least: float = 0.6, n: int = 5) -> DataFrame:
    """The chunk that has most of an item's character n-grams, if at least a share of them (O-133). An equality join on grams; counts
    are combined before the shuffle. The items' grams are broadcast if their texts are small. items: item_id, text; chunks: chunk_id, text."""
    g = items.select("item_id", X.char_grams(F.col("text"), n).alias("g"))
    q = g.select("item_id", F.size("g").alias("total"), F.explode("g").alias("gram"))
    c = chunks.select("chunk_id", F.explode(X.char_grams(F.col("text"), n)).alias("gram"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    share = c.join(F.broadcast(q) if size <= MOST_BROADCAST else q, "gram").groupBy("item_id", "chunk_id").agg((F.count("*") / F.first("total")).alias("share"))
    w = Window.partitionBy("item_id").orderBy(F.desc("share"), F.asc("chunk_id"))
    return share.where(F.col("share") >= least).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("item_id", "chunk_id", F.round("share", 6).alias("share"))


def adjacent_gold(gold: DataFrame, shares: DataFrame, least: float = 0.2) -> DataFrame:
    """Pages next to a gold page that hold at least a share of the item as well (O-134). gold, shares: item_id, file_name, page, share."""
    near = gold.select("item_id", "file_name", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    return near.join(shares.where(F.col("share") >= least), ["item_id", "file_name", "page"]).select("item_id", "file_name", "page").distinct()


def triage(items: DataFrame) -> DataFrame:
    """Flags of items: without an anchor, failing, ambiguous (O-169). items: has_anchor, rank, present."""
    flags = F.array_compact(F.array(F.when(~F.col("has_anchor"), "no_anchor"), F.when(F.coalesce(~F.col("present"), F.lit(False)), "fails"), F.when(F.col("rank") > 5, "ambiguous")))
    return items.withColumn("flags", flags)


def is_refusal(answer: Column) -> Column:
    """Whether an answer is blank or nearly one of the refusals (O-146)."""
    near = [X.indel_ratio(X.cleaned_answer(answer), F.lit(r)) >= REFUSAL for r in REFUSALS]
    return (F.trim(answer) == "") | near[0] | near[1]


def valid_answers(rows: DataFrame) -> DataFrame:
    """Valid answers of each query; where none is, the first one without its citation (O-147). rows: query_id, position, answer, valid,
    file_name, page, score."""
    w = Window.partitionBy("query_id")
    r = rows.withColumn("__n", F.count_if("valid").over(w)).withColumn("__i", F.row_number().over(w.orderBy("position")))
    blank = F.col("__n") == 0
    kept = r.where("valid OR (__n = 0 AND __i = 1)")
    return kept.withColumns({"file_name": F.when(blank, "").otherwise(F.col("file_name")), "page": F.when(blank, 0).otherwise(F.col("page")), "score": F.when(blank, 0.0).otherwise(F.col("score"))}).drop("__n", "__i")


def verdicts(events: DataFrame, keys: list[str]) -> DataFrame:
    """State of each key after its events in order (O-160): a null text leaves the text as it is, "" clears it, another replaces it.
    events: keys, ts, verdict, revised_text."""
    text = F.max_by(F.struct("revised_text"), F.when(F.col("revised_text").isNotNull(), F.col("ts")))
    out = events.groupBy(*keys).agg(F.max_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("ts"))).alias("verdict"), text.alias("__t"), F.max("ts").alias("ts"))
    return out.withColumn("revised_text", F.when(F.col("__t.revised_text") != "", F.col("__t.revised_text"))).drop("__t")


def run_states(decisions: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State of each run: its last decision; an approved one is pending again after a later change of a verdict or a text, a rejected one
    is not (O-161). decisions: keys, ts, state; changes: keys, ts."""
    last = decisions.groupBy(*keys).agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("__d"))
    change = changes.groupBy(*keys).agg(F.max("ts").alias("__c"))
    flip = (F.col("state") == "approved") & (F.col("__c") > F.col("__d"))
    return last.join(change, keys, "left").withColumn("state", F.when(F.coalesce(flip, F.lit(False)), "pending").otherwise(F.col("state"))).drop("__d", "__c")


def cached_answers(questions: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Answers of questions without history that the cache has for the index's fingerprint (O-163). questions: query_id, question,
    has_history; cache: norm, fingerprint, answer, stored_at."""
    q = questions.where("NOT has_history").withColumn("norm", X.normalised_question(F.col("question")))
    held = cache.where(F.col("fingerprint") == fingerprint).groupBy("norm").agg(F.max_by("answer", "stored_at").alias("answer"))
    return q.join(held, "norm").select("query_id", "answer")


def routed(rows: DataFrame) -> DataFrame:
    """Where a question goes by its intent and history: an invalid one with history is a follow-up (O-164)."""
    r = F.when((F.col("intent") == "invalid") & F.col("has_history"), "followup").when(F.col("intent") == "invalid", "reject").when(F.col("intent") == "followup", F.when(F.col("has_history"), "followup").otherwise("new")).otherwise(F.col("intent"))
    return rows.withColumn("route", r)


def overrides(spec: str) -> dict:
    """Typed settings of a text such as a=false,b=.35,c=x (O-170)."""
    out: dict = {}
    for part in filter(None, (p.strip() for p in (spec or "").split(","))):
        name, sign, value = part.partition("=")
        if not sign:
            raise ValueError(f"{part} has no value")
        low = value.strip().lower()
        if low in ("true", "false"):
            out[name.strip()] = low == "true"
        else:
            try:
                out[name.strip()] = int(low) if low.lstrip("-").isdigit() else float(low)
            except ValueError:
                out[name.strip()] = value.strip()
    return out
