"""Catalog entries: vector branch, text branch, fusion and recall over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.functions.columns import recency_importance, split_tags
from hybridctx.operators import fts, fts_bounded, recall as rc, vectors
from hybridctx.operators.store import live_memories
from hybridctx.plans import fixtures as fx
from hybridctx.plans.oracle_fixtures import with_fixtures
from hybridctx.plans.registry import register
from hybridctx.plans.sqlparts import FTS_ALL, ctes, dot, recency, split_tags as sql_split_tags
from hybridctx.session import scratch_dir, written
from hybridctx.streaming import store

NOW = K.FIXTURE_NOW_MS
FX = ("fx_memories", "fx_vectors", "fx_queries")

MEM_SQL = """SELECT m.*, v.embedding FROM fx_memories m LEFT JOIN fx_vectors v ON v.memory_id = m.memory_id"""
Q_SQL = """SELECT qid, workspace_id, query_text, query_vec, k,
  CASE WHEN only_type IS NULL THEN NULL ELSE [only_type] END AS types FROM fx_queries"""
VEC_SQL = f"""SELECT qid, workspace_id, memory_id, vec_rank FROM (
  SELECT q.qid, q.workspace_id, mem.memory_id,
    row_number() OVER (PARTITION BY q.qid ORDER BY {dot('q.query_vec', 'mem.embedding')} DESC, mem.memory_id ASC) AS vec_rank
  FROM q JOIN mem ON mem.workspace_id = q.workspace_id
  WHERE mem.archived_at IS NULL AND mem.embedding IS NOT NULL) WHERE vec_rank <= 20"""
FUSED_SQL = """SELECT qid, workspace_id, memory_id, sum(1.0::DOUBLE / (60 + rank)::DOUBLE) AS rrf FROM (
  SELECT qid, workspace_id, memory_id, vec_rank AS rank FROM vec_top
  UNION ALL SELECT qid, workspace_id, memory_id, fts_rank AS rank FROM fts_top) GROUP BY ALL"""
CAND_SQL = """SELECT f.qid, m.workspace_id, m.memory_id, m.type, m.content, m.tags, m.importance, m.created_at, f.rrf
FROM fused f JOIN q ON q.qid = f.qid
JOIN mem m ON m.workspace_id = f.workspace_id AND m.memory_id = f.memory_id
WHERE m.archived_at IS NULL AND (q.types IS NULL OR len(q.types) = 0 OR list_contains(q.types, m.type))"""


def _search_sql(body: str, upto: list[str], mem_where: str | None = None) -> str:
    extra = {"mem": MEM_SQL + (f" WHERE {mem_where}" if mem_where else ""), "q": Q_SQL}
    extra.update(ctes(upto))
    return with_fixtures(body, *FX, extra=extra)


_indexes: dict[tuple, str] = {}


def stored_index(spark, sf_dir):
    """The stored index of the fixture rows: written once per session and table folder, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = scratch_dir(spark, f"memories-{uuid.uuid4().hex[:12]}")
        store.commit(spark, path, fx.fx_memories(spark, sf_dir))
        _indexes[key] = path
    return store.open_store(spark, _indexes[key])


def _inputs(spark, sf_dir):
    return fx.fx_queries(spark, sf_dir), fx.fx_memories_with_vectors(spark, sf_dir)


@register("vector_topk", _search_sql(
    f"""SELECT qid, workspace_id, memory_id, vec_rank, round(sim, 9) AS sim FROM (
  SELECT q.qid, q.workspace_id, mem.memory_id, {dot('q.query_vec', 'mem.embedding')} AS sim,
    row_number() OVER (PARTITION BY q.qid ORDER BY {dot('q.query_vec', 'mem.embedding')} DESC, mem.memory_id ASC) AS vec_rank
  FROM q JOIN mem ON mem.workspace_id = q.workspace_id
  WHERE mem.archived_at IS NULL AND mem.embedding IS NOT NULL) WHERE vec_rank <= 20""", []))
def q_vector_topk(spark, sf_dir):
    q, m = _inputs(spark, sf_dir)
    r = vectors.vector_topk(q, m, 20)
    return r.select("qid", "workspace_id", "memory_id", F.col("vec_rank").cast("long").alias("vec_rank"),
                    F.round("sim", 9).alias("sim"))


@register("build_postings", _search_sql(
    "SELECT workspace_id, memory_id, col, pos, term FROM postings", ["toks", "postings"]))
def q_build_postings(spark, sf_dir):
    p = fts.build_postings(fx.fx_memories(spark, sf_dir))
    return p.select("workspace_id", "memory_id", F.col("col").cast("int").alias("col"),
                    F.col("pos").cast("long").alias("pos"), "term")


@register("corpus_stats", _search_sql(
    """SELECT d.workspace_id, d.memory_id, d.dl, d.live, s.n_docs, s.total_tokens, round(s.avgdl, 9) AS avgdl
FROM doc_stats d JOIN ws_stats s USING (workspace_id)""", ["toks", "doc_stats", "ws_stats"]))
def q_corpus_stats(spark, sf_dir):
    ws, docs = fts.corpus_stats(fx.fx_memories(spark, sf_dir))
    return docs.join(ws, "workspace_id").select(
        "workspace_id", "memory_id", F.col("dl").cast("long").alias("dl"), "live",
        F.col("n_docs").cast("long").alias("n_docs"), F.col("total_tokens").cast("long").alias("total_tokens"),
        F.round("avgdl", 9).alias("avgdl"))


@register("parse_fts_query", _search_sql(
    """SELECT qid, workspace_id, phrase_no, "offset", term, n_terms, n_phrases FROM qterms""",
    ["pieces", "phr", "phr2", "qterms"]))
def q_parse_fts_query(spark, sf_dir):
    t = fts.parse_fts_query(fx.fx_queries(spark, sf_dir))
    return t.select("qid", "workspace_id", F.col("phrase_no").cast("long").alias("phrase_no"),
                    F.col("offset").cast("long").alias("offset"), "term",
                    F.col("n_terms").cast("long").alias("n_terms"), F.col("n_phrases").cast("long").alias("n_phrases"))


@register("phrase_hits", _search_sql(
    "SELECT qid, workspace_id, phrase_no, memory_id, tf FROM hits",
    ["toks", "postings", "pieces", "phr", "phr2", "qterms", "occ", "hits"]))
def q_phrase_hits(spark, sf_dir):
    m = fx.fx_memories(spark, sf_dir)
    qt = fts.parse_fts_query(fx.fx_queries(spark, sf_dir))
    h = fts.phrase_hits(qt, fts.build_index(m))
    return h.select("qid", "workspace_id", F.col("phrase_no").cast("long").alias("phrase_no"), "memory_id",
                    F.col("tf").cast("long").alias("tf"))


@register("bm25_scores", _search_sql(
    "SELECT qid, workspace_id, memory_id, live, round(score, 9) AS score FROM bm25",
    FTS_ALL[:-1]))
def q_bm25_scores(spark, sf_dir):
    m = fx.fx_memories(spark, sf_dir)
    qt = fts.parse_fts_query(fx.fx_queries(spark, sf_dir))
    index = fts.build_index(m)
    s = fts.bm25_scores(written(fts.phrase_hits(qt, index), "hits"), qt, index.stats)
    return s.select("qid", "workspace_id", "memory_id", "live", F.round("score", 9).alias("score"))


@register("fts_topk", _search_sql(
    "SELECT qid, workspace_id, memory_id, fts_rank, round(score, 9) AS score FROM fts_top", FTS_ALL))
def q_fts_topk(spark, sf_dir):
    q, m = _inputs(spark, sf_dir)
    r = fts.fts_topk(q, None, 20, stored_index(spark, sf_dir))
    return r.select("qid", "workspace_id", "memory_id", F.col("fts_rank").cast("long").alias("fts_rank"),
                    F.round("score", 9).alias("score"))


@register("fts_topk_bounded", _search_sql(
    "SELECT qid, workspace_id, memory_id, fts_rank, round(score, 9) AS score FROM fts_top", FTS_ALL))
def q_fts_topk_bounded(spark, sf_dir):
    """fts_topk from blocks with score bounds."""
    q, _ = _inputs(spark, sf_dir)
    r, _ = fts_bounded.fts_topk_bounded(q, stored_index(spark, sf_dir))
    return r.select("qid", "workspace_id", "memory_id", F.col("fts_rank").cast("long").alias("fts_rank"),
                    F.round("score", 9).alias("score"))


_FUSE_EXTRA = FTS_ALL + ["vec_top", "fused"]


def _fusion_sql(body: str, with_cands: bool = False, more: dict | None = None, first: dict | None = None) -> str:
    extra = {**(first or {}), "mem": MEM_SQL, "q": Q_SQL if not first else Q_SQL.replace("fx_queries", next(iter(first)))}
    extra.update(ctes(FTS_ALL))
    extra["vec_top"] = VEC_SQL
    extra["fused"] = FUSED_SQL
    if with_cands:
        extra["cands"] = CAND_SQL
    extra.update(more or {})
    return with_fixtures(body, *FX, extra=extra)


@register("rrf_fuse", _fusion_sql("SELECT qid, workspace_id, memory_id, round(rrf, 12) AS rrf FROM fused"))
def q_rrf_fuse(spark, sf_dir):
    q, m = _inputs(spark, sf_dir)
    v = vectors.vector_topk(q, m).withColumnRenamed("vec_rank", "rank")
    t = fts.fts_topk(q, None, index=stored_index(spark, sf_dir)).withColumnRenamed("fts_rank", "rank")
    return rc.rrf_fuse([v, t]).select("qid", "workspace_id", "memory_id", F.round("rrf", 12).alias("rrf"))


@register("fetch_candidates", _fusion_sql(
    "SELECT qid, workspace_id, memory_id, type, round(rrf, 12) AS rrf FROM cands", True))
def q_fetch_candidates(spark, sf_dir):
    q, m = _inputs(spark, sf_dir)
    v = vectors.vector_topk(q, m).withColumnRenamed("vec_rank", "rank")
    t = fts.fts_topk(q, None, index=stored_index(spark, sf_dir)).withColumnRenamed("fts_rank", "rank")
    c = rc.fetch_candidates(rc.rrf_fuse([v, t]), m, q)
    return c.select("qid", "workspace_id", "memory_id", "type", F.round("rrf", 12).alias("rrf"))


RECALL_BODY = f"""SELECT qid, rank, memory_id, type, content, tags, created_at, round(score, 9) AS score FROM (
  SELECT c.qid, c.memory_id, c.type, c.content, {sql_split_tags('c.tags')} AS tags, c.created_at, s.score,
    row_number() OVER (PARTITION BY c.qid ORDER BY s.score DESC, c.memory_id ASC) AS rank, q.k
  FROM cands c JOIN q ON q.qid = c.qid,
  LATERAL (SELECT c.rrf * {recency('c.created_at', 'c.importance')} AS score) s
) WHERE rank <= k"""


@register("recall", _fusion_sql(RECALL_BODY, True))
def q_recall(spark, sf_dir):
    q, m = _inputs(spark, sf_dir)
    r = rc.recall(q, m, NOW, stored_index(spark, sf_dir))
    return r.select("qid", F.col("rank").cast("long").alias("rank"), "memory_id", "type", "content", "tags",
                    "created_at", F.round("score", 9).alias("score"))


JSON_ITEMS = "array<struct<id: bigint, type: string, content: string, tags: array<string>, created_at: bigint, score: double>>"


@register("recall_to_json", _fusion_sql(f"""SELECT qid, rank - 1 AS pos, memory_id AS id, type, content, tags, created_at, score
FROM ({RECALL_BODY})""", True))
def q_recall_to_json(spark, sf_dir):
    """The JSON arrays, parsed again: their order and every field must be those of the ranked rows."""
    q, m = _inputs(spark, sf_dir)
    j = rc.recall_to_json(rc.recall(q, m, NOW, stored_index(spark, sf_dir)))
    items = j.select("qid", F.posexplode(F.from_json("json", JSON_ITEMS)).alias("pos", "r")).select("qid", "pos", "r.*")
    return items.withColumn("pos", F.col("pos").cast("long")).withColumn("score", F.round("score", 9))


CHECKED_SQL = """SELECT *, CASE
  WHEN query_text IS NULL OR regexp_replace(query_text, '\\s', '', 'g') = '' THEN 'blank_query'
  WHEN k < 1 OR k > 20 THEN 'k_out_of_range' END AS reject_reason
FROM (SELECT * REPLACE (CAST(qid % 23 - 1 AS INTEGER) AS k) FROM fx_queries)"""


@register("recall_requests", _fusion_sql(f"""
SELECT c.qid, c.reject_reason, CASE WHEN c.reject_reason IS NULL THEN coalesce(r.n, 0) ELSE 0 END AS n_results
FROM checked c LEFT JOIN (SELECT qid, count(*) AS n FROM ({RECALL_BODY}) GROUP BY qid) r ON r.qid = c.qid""", True,
                                         first={"checked": CHECKED_SQL}))
def q_recall_requests(spark, sf_dir):
    """Requests with k from -1 to 21: the bad ones come back with their reason, the others are answered."""
    q, m = _inputs(spark, sf_dir)
    found, rejected = rc.recall_requests(q.withColumn("k", ((F.col("qid") % 23) - 1).cast("int")), m, NOW,
                                         index=stored_index(spark, sf_dir))
    n = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n_results"))
    good = q.select("qid").join(rejected.select("qid"), "qid", "left_anti")
    return good.join(n, "qid", "left").select("qid", F.lit(None).cast("string").alias("reject_reason"),
                                              F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results")) \
        .unionByName(rejected.select("qid", "reject_reason", F.lit(0).cast("long").alias("n_results")))


@register("recency_importance", with_fixtures(
    f"""SELECT memory_id, round({recency('created_at', 'importance')}, 9) AS recency_importance FROM fx_memories""",
    "fx_memories"))
def q_recency_importance(spark, sf_dir):
    m = fx.fx_memories(spark, sf_dir)
    return m.select("memory_id", F.round(recency_importance("created_at", "importance", NOW), 9)
                    .alias("recency_importance"))


@register("split_tags", with_fixtures(
    f"SELECT memory_id, {sql_split_tags('tags')} AS tags FROM fx_memories", "fx_memories"))
def q_split_tags(spark, sf_dir):
    m = fx.fx_memories(spark, sf_dir)
    return m.select("memory_id", split_tags("tags").alias("tags"))


RELEVANT_SQL = """SELECT q.qid, m.memory_id FROM fx_queries q JOIN fx_vectors qv ON qv.memory_id = q.item_id
JOIN fx_vectors v ON v.label = qv.label JOIN fx_memories m ON m.memory_id = v.memory_id
WHERE m.workspace_id = q.workspace_id AND m.archived_at IS NULL"""


@register("recall_eval", _fusion_sql("""
SELECT coalesce(qs.qid, per_q.qid) AS qid, coalesce(n_results, 0) AS n_results,
  coalesce(n_found, 0) AS n_relevant_found, CASE WHEN first_rank IS NOT NULL THEN 1 ELSE 0 END AS hit,
  round(coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE), 9) AS rr
FROM qs FULL OUTER JOIN per_q ON per_q.qid = qs.qid""", True, {
    "results": RECALL_BODY,
    "rel": RELEVANT_SQL,
    "per_q": """SELECT r.qid, count(*) AS n_results,
  CAST(sum(CASE WHEN rel.memory_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_found,
  min(CASE WHEN rel.memory_id IS NOT NULL THEN r.rank END) AS first_rank
  FROM results r LEFT JOIN rel ON rel.qid = r.qid AND rel.memory_id = r.memory_id GROUP BY r.qid""",
    "qs": "SELECT DISTINCT qid FROM rel"}))
def q_recall_eval(spark, sf_dir):
    q, m = _inputs(spark, sf_dir)
    v = fx.fx_vectors(spark, sf_dir)
    qv = v.select(F.col("memory_id").alias("item_id"), "label")
    # rows meet their labels first, so queries are joined on (workspace, label) and never on the label alone
    labelled = live_memories(m).select("memory_id", "workspace_id").join(v.select("memory_id", "label"), "memory_id")
    rel = (q.select("qid", "item_id", "workspace_id").join(qv, "item_id").join(labelled, ["workspace_id", "label"])
           .select("qid", "memory_id"))
    e = rc.recall_eval(rc.recall(q, m, NOW, stored_index(spark, sf_dir)), rel)
    return e.select("qid", F.col("n_results").cast("long").alias("n_results"),
                    F.col("n_relevant_found").cast("long").alias("n_relevant_found"),
                    F.col("hit").cast("int").alias("hit"), F.round("rr", 9).alias("rr"))


@register("recall_pair_order", _fusion_sql("""
SELECT a.qid, v.value, sum(CASE WHEN v.x > v.y THEN 1 ELSE 0 END)::BIGINT AS agree,
  sum(CASE WHEN v.x < v.y THEN 1 ELSE 0 END)::BIGINT AS disagree, sum(CASE WHEN v.x = v.y THEN 1 ELSE 0 END)::BIGINT AS equal
FROM found a JOIN found b ON a.qid = b.qid AND a.rank < b.rank,
  LATERAL (SELECT unnest(['created_at', 'importance']) AS value, unnest([a.created_at::DOUBLE, a.importance]) AS x,
                  unnest([b.created_at::DOUBLE, b.importance]) AS y) v
GROUP BY a.qid, v.value""", True, {
    "results": RECALL_BODY.replace("WHERE rank <= k", "WHERE rank <= 20"),
    "found": "SELECT r.*, m.importance FROM results r JOIN mem m ON m.memory_id = r.memory_id"}))
def q_recall_pair_order(spark, sf_dir):
    """Up to 20 results of every query: does their order follow age (newer first) and importance?"""
    q, m = _inputs(spark, sf_dir)
    r = rc.recall(q.withColumn("k", F.lit(20)), m, NOW, stored_index(spark, sf_dir))
    found = r.join(m.select("memory_id", "importance"), "memory_id")
    return rc.pair_order(found, ["created_at", "importance"]).where("agree + disagree + equal > 0")


@register("refresh_index", _search_sql("SELECT workspace_id, memory_id, col, pos, term FROM postings",
                                      ["toks", "postings"], mem_where="m.memory_id % 13 <> 0"))
def q_refreshstored_index(spark, sf_dir):
    """Index of (rows with id % 3 <> 0) refreshed with the other rows inserted and ids % 13 = 0 deleted."""
    m = fx.fx_memories(spark, sf_dir)
    base = fts.build_postings(m.where(F.col("memory_id") % 3 != 0))
    ins = m.where(F.col("memory_id") % 3 == 0)
    dele = m.where(F.col("memory_id") % 13 == 0).select("memory_id")
    p = fts.refresh_index(base, inserted=ins, deleted_ids=dele)
    return p.select("workspace_id", "memory_id", F.col("col").cast("int").alias("col"),
                    F.col("pos").cast("long").alias("pos"), "term")
