"""BM25 top-k that scores few blocks of documents: blocks whose bound stays below the running k-th score are skipped.

A block holds documents of about one length (see with_blocks). For every term the index keeps the largest number of
occurrences and the smallest length in each block, so a block's largest possible score for a query is known before a document
is looked at. Per query, the blocks that may hold all phrases are ordered by that bound; the first ones are scored, their k-th
score is the threshold, and of the others only those whose bound reaches it are scored. Results equal fts_topk's.

Hit counts (the idf) are exact and cover every row: for phrases of one term they are sums of the blocks' numbers of rows,
longer phrases are matched everywhere, as their count is not known otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.operators.fts import (KEY, WS, TextIndex, _lists_of, _only_terms, contribution, inverse_document_frequency,
                                     parse_fts_query, phrase_hits, term_key)
from hybridctx.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_small
from hybridctx.operators.store import top_n_per
from hybridctx.session import reliable_checkpoint, written

#: Blocks of a query that are scored before there is a threshold.
FIRST_BLOCKS = 4
#: A bound is a sum of the same numbers as a score, in another order.
ROUNDING = 1e-9


def _within(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    return hits.join(broadcast_if_small(blocks.select("qid", "block"), 1_000_000), ["qid", "block"], "left_semi")


def fts_topk_bounded(queries: DataFrame, index: TextIndex, k: int = K.BRANCH_TOPK, text: str = "query_text",
                     first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(results as fts_topk gives them, report: qid, blocks, scored). The index must hold blocks."""
    qterms = reliable_checkpoint(parse_fts_query(queries, text))
    single, longer = qterms.where("n_terms = 1"), qterms.where("n_terms > 1")
    stats = index.stats.select(WS, "n_docs", "avgdl")
    lists = _lists_of(_only_terms(index.lists, single), single, DEFAULT_MAX_BROADCAST_ROWS)
    lists = lists if index.ended is None else lists.join(index.ended, [KEY, "epoch"], "left_anti")
    # the stored lists are read once, those of the query's terms alone are kept: (query, block) pairs grow with the corpus, and
    # beyond a broadcast their join shuffles the lists
    lists = written(lists.select(WS, "term", "block", KEY, "dl", "live", F.col("tf").cast("long").alias("tf")),
                    "term-lists")
    named = broadcast_if_small(single.select(WS, "term", "qid", "phrase_no"))
    found = reliable_checkpoint(phrase_hits(longer, index))
    # exact hit counts: blocks know how many rows they hold of a term; versions that ended are taken off
    counted = index.blocks.select(WS, "term", F.col("n_rows").alias("n"))
    if index.ended is not None and not index.ended.isEmpty():
        gone = index.lists.select(WS, "term", KEY, "epoch").join(index.ended, [KEY, "epoch"], "left_semi")
        counted = counted.unionByName(gone.select(WS, "term", F.lit(-1).cast("long").alias("n")))
    n_hit = counted.join(named, [WS, "term"]).groupBy("qid", "phrase_no").agg(F.sum("n").alias("n_hit")).where("n_hit > 0") \
        .unionByName(found.groupBy("qid", "phrase_no").agg(F.count(F.lit(1)).alias("n_hit")))
    phrases = qterms.select("qid", WS, "phrase_no", "n_phrases").distinct().join(n_hit, ["qid", "phrase_no"]) \
        .join(broadcast_if_small(stats, 2_000_000), WS)
    phrases = reliable_checkpoint(phrases.withColumn("idf", inverse_document_frequency(F.col("n_docs"), F.col("n_hit"))))
    weights = broadcast_if_small(phrases.drop(WS, "n_hit", "n_docs"), 1_000_000)
    # the largest contribution of every phrase in every block
    keyed = single.select(term_key().alias("h"), WS, "term", "qid", "phrase_no")
    of_terms = index.blocks.join(broadcast_if_small(keyed), ["h", WS, "term"]).groupBy("qid", "phrase_no", "block") \
        .agg(F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
    of_found = found.groupBy("qid", "phrase_no", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    best = contribution(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    bounds = of_terms.unionByName(of_found).join(weights, ["qid", "phrase_no"]).groupBy("qid", "block").agg(
        F.sum(best).alias("bound"), F.count(F.lit(1)).alias("n"), F.first("n_phrases").alias("n_phrases"))
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "block")
    bounds = reliable_checkpoint(bounds.where("n = n_phrases").select("qid", "block", "bound", F.row_number().over(order).alias("nth")))

    def scored(blocks: DataFrame) -> DataFrame:
        pairs = broadcast_if_small(single.select(WS, "term", "qid", "phrase_no").join(blocks.select("qid", "block"), "qid"), 2_000_000)
        one = lists.join(pairs, [WS, "term", "block"]).select("qid", WS, "phrase_no", KEY, "dl", "live", "tf")
        hits = one.unionByName(_within(found, blocks).select(one.columns)).join(weights, ["qid", "phrase_no"])
        return hits.groupBy("qid", WS, KEY, "live").agg(
            F.sum(contribution(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"),
            F.count(F.lit(1)).alias("n"), F.first("n_phrases").alias("n_phrases")) \
            .where("live AND n = n_phrases").select("qid", WS, KEY, "score")

    rank = [F.round("score", 12).desc(), F.col(KEY).asc()]
    early = reliable_checkpoint(top_n_per(scored(bounds.where(F.col("nth") <= first_blocks)), ["qid"], rank, k, "fts_rank"))
    threshold = early.where(F.col("fts_rank") == k).select("qid", F.col("score").alias("threshold"))
    later = bounds.where(F.col("nth") > first_blocks).join(threshold, "qid", "left") \
        .where(F.col("threshold").isNull() | (F.col("bound") * (1 + ROUNDING) + ROUNDING >= F.col("threshold")))
    later = reliable_checkpoint(later.select("qid", "block"))
    out = top_n_per(early.drop("fts_rank").unionByName(scored(later)), ["qid"], rank, k, "fts_rank")
    report = bounds.groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("nth") <= first_blocks).cast("long")).alias("early")) \
        .join(later.groupBy("qid").agg(F.count(F.lit(1)).alias("late")), "qid", "left") \
        .select("qid", "blocks", (F.col("early") + F.coalesce("late", F.lit(0))).alias("scored"))
    return out, report
