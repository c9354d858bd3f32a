"""Hybrid recall: vector top-20 and BM25 top-20 fused by reciprocal rank, re-scored by recency x importance.

All queries of a batch run in one plan. Late materialisation: both branches produce ids only; the wide
columns (content, tags) are joined once, for at most 40 candidates per query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.functions.columns import recency_importance, split_tags
from hybridctx.operators.fts import TextIndex, fts_topk
from hybridctx.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS, row_count_at_most
from hybridctx.operators.store import filter_types_per_row, live_memories, top_n_per, validate_queries
from hybridctx.operators.vectors import embed_corpus, vector_topk
from hybridctx.session import collect_references, reliable_checkpoint, written

WS, KEY = "workspace_id", "memory_id"


def rrf_fuse(lists: list[DataFrame], c: int = K.RRF_C) -> DataFrame:
    """Each list: (qid, workspace_id, memory_id, rank from 1). Output: (qid, workspace_id, memory_id, rrf)."""
    u = reduce(lambda a, b: a.unionByName(b),
               [d.select("qid", WS, KEY, F.col("rank").cast("int").alias("rank")) for d in lists])
    return u.groupBy("qid", WS, KEY).agg(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("rrf"))


def fetch_candidates(fused: DataFrame, memories: DataFrame, queries: DataFrame | None = None,
                     broadcast_fused: bool | None = None,
                     max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Join fused ids to live rows of the same workspace; per-query type filter applied here (after the cuts).

    The fused side holds at most 2 x 20 rows per query, so its size is bounded by the query count: it is
    broadcast when the queries are (checked on the cheap query table, not on the fused plan). It is written first, as it is
    then read twice: its ids leave out the other memories before these go through the joins and shuffles of their own plan.
    """
    cols = [WS, KEY, "type", "content", "tags", "importance", "created_at"]
    live = live_memories(memories).select(*cols)
    fused = written(fused, "fused")
    f = fused
    if queries is not None and "types" in queries.columns:
        f = f.join(queries.select("qid", "types"), "qid")
    if broadcast_fused is None:
        broadcast_fused = row_count_at_most(queries.select("qid"), max_broadcast_rows) if queries is not None \
            else row_count_at_most(f, max_broadcast_rows * 2 * K.BRANCH_TOPK)
    if broadcast_fused:
        collect_references(memories.sparkSession)
        # a condition, and not a join, as it comes down to the scan through other joins
        live = live.where(F.struct(WS, KEY).isin(F.broadcast(fused.select(WS, KEY).distinct())))
    side = F.broadcast(f) if broadcast_fused else f
    j = live.join(side, [WS, KEY])
    return filter_types_per_row(j) if "types" in j.columns else j


def recall(queries: DataFrame, memories: DataFrame, now_ms: int, index: TextIndex | None = None,
           branch_k: int = K.BRANCH_TOPK, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """queries: (qid, workspace_id, query_text, query_vec, k, types). memories: live and archived rows with
    an optional embedding. Output: (qid, rank, memory_id, type, content, tags, created_at, score).

    The query table feeds both branches, the candidate fetch, the per-query k and the size checks, so it
    is materialised once (reliable checkpoint) instead of being re-planned and recomputed by each.
    """
    queries = reliable_checkpoint(queries)
    vec = vector_topk(queries, memories, branch_k, max_broadcast_rows).select(
        "qid", WS, KEY, F.col("vec_rank").alias("rank"))
    txt = fts_topk(queries, memories, branch_k, index, max_broadcast_rows=max_broadcast_rows).select(
        "qid", WS, KEY, F.col("fts_rank").alias("rank"))
    fused = rrf_fuse([vec, txt])
    small = row_count_at_most(queries.select("qid"), max_broadcast_rows)
    cands = fetch_candidates(fused, memories, queries, broadcast_fused=small)
    scored = cands.withColumn("score", F.col("rrf") * recency_importance("created_at", "importance", now_ms))
    k = queries.select("qid", "k")
    ranked = top_n_per(scored.join(F.broadcast(k) if small else k, "qid"),
                       ["qid"], [F.col("score").desc(), F.col(KEY).asc()], "k", "rank")
    return ranked.select("qid", "rank", KEY, "type", "content", split_tags("tags").alias("tags"),
                         "created_at", "score")


def recall_requests(queries: DataFrame, memories: DataFrame, now_ms: int, embedder=None,
                    **options) -> tuple[DataFrame, DataFrame]:
    """Recall as a service answers it: (results of the good requests, rejected requests with reject_reason).

    Blank texts and k outside 1..20 are refused. With an embedder (see embed_corpus) the query vector comes from
    the query text; otherwise the requests bring query_vec."""
    checked = validate_queries(queries)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    if embedder is not None:
        good = good.drop("query_vec").join(
            embed_corpus(good, "qid", "query_text", embedder).withColumnRenamed("embedding", "query_vec"), "qid")
    return recall(good, memories, now_ms, **options), checked.where(F.col("reject_reason").isNotNull())


def recall_to_json(results: DataFrame) -> DataFrame:
    """One JSON array per query, ordered by score (rank): [{id, type, content, tags, created_at, score}]."""
    item = F.struct(F.col("rank"), F.col(KEY).alias("id"), "type", "content", "tags", "created_at", "score")
    agg = results.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return agg.select("qid", F.to_json(F.transform("_items", lambda s: s.dropFields("rank"))).alias("json"))


def recall_eval(results: DataFrame, relevant: DataFrame, k: int | None = None) -> DataFrame:
    """Per query: hit@k (any relevant row in the results) and reciprocal rank of the first relevant row.

    relevant: (qid, memory_id). Queries without any result still appear (hit 0, rr 0) when they have
    relevant rows.
    """
    r = results if k is None else results.where(F.col("rank") <= k)
    marked = r.join(relevant.select("qid", KEY).distinct().withColumn("_rel", F.lit(1)), ["qid", KEY], "left")
    per_q = marked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.sum(F.coalesce("_rel", F.lit(0))).alias("n_relevant_found"),
        F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first_relevant_rank"))
    qs = relevant.select("qid").distinct()
    out = qs.join(per_q, "qid", "full_outer")
    return out.select(
        "qid",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("n_relevant_found", F.lit(0)).alias("n_relevant_found"),
        F.when(F.col("first_relevant_rank").isNotNull(), 1).otherwise(0).alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0)).alias("rr"),
    )


def pair_order(results: DataFrame, values: list[str]) -> DataFrame:
    """How far the order of the results follows some values: per query and value, the pairs of results whose order agrees
    (the one ranked before has the larger value), disagrees or says nothing (equal values).

    results: (qid, rank, *values). Output: (qid, value, agree, disagree, equal). Pairs are counted by merging, not made: the
    ranks of a query are halved again and again, and on each level every row of a right half counts the rows of
    its left half with a larger, an equal and a smaller value, from running sums over the distinct values of both halves. A
    row takes part once per level. Null values take no part; results of equal rank are no pair."""
    long = results.select("qid", F.col("rank").cast("long").alias("rank"), F.explode(F.map_from_arrays(
        F.array(*[F.lit(v) for v in values]), F.array(*[F.col(v).cast("double") for v in values]))).alias("value", "x")) \
        .where(F.col("x").isNotNull())
    # levels up to the largest rank: one number of the whole table
    top = results.agg(F.max("rank")).first()[0] or 0
    levels = long.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(int(top).bit_length()))))
    half = F.expr("shiftright(rank, level)")
    # rows of one block that share a value are one row from here on
    counts = levels.groupBy("qid", "value", "level", F.expr("shiftright(rank, level + 1)").alias("block"), "x").agg(
        F.sum(F.when(half % 2 == 0, 1).otherwise(0)).alias("left"), F.sum(F.when(half % 2 == 1, 1).otherwise(0)).alias("right"))
    block = Window.partitionBy("qid", "value", "level", "block")
    below = F.coalesce(F.sum("left").over(block.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("qid", "value", "right", "left", below.alias("below"), F.sum("left").over(block).alias("all"))
    sums = counts.groupBy("qid", "value").agg(
        F.sum(F.col("right") * (F.col("all") - F.col("below") - F.col("left"))).alias("agree"),
        F.sum(F.col("right") * F.col("below")).alias("disagree"),
        F.sum(F.col("right") * F.col("left")).alias("equal"))
    return sums
