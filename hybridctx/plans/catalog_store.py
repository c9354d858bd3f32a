"""Catalog entries: store operators (lists, lookups, validation, upserts, deletes, log) and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.operators import store as st
from hybridctx.plans import fixtures as fx
from hybridctx.plans.catalog_ids import _H, _crockford_sql
from hybridctx.plans.oracle_fixtures import with_fixtures
from hybridctx.plans.registry import register
from hybridctx.plans.sqlparts import has_active
from hybridctx.sources import io
from hybridctx.schemas import COMMIT_SCHEMA, conform
from hybridctx.session import scratch_dir

NOW = K.FIXTURE_NOW_MS


@register("list_memories", with_fixtures("""SELECT workspace_id, memory_id, type, created_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, memory_id DESC) AS rank
  FROM fx_memories WHERE archived_at IS NULL) WHERE rank <= 50""", "fx_memories"))
def q_list_memories(spark, sf_dir):
    r = st.list_memories(fx.fx_memories(spark, sf_dir), limit=50)
    return r.select("workspace_id", "memory_id", "type", "created_at", F.col("rank").cast("long").alias("rank"))


@register("live_memories", with_fixtures(
    "SELECT memory_id, workspace_id FROM fx_memories WHERE archived_at IS NULL", "fx_memories"))
def q_live_memories(spark, sf_dir):
    return st.live_memories(fx.fx_memories(spark, sf_dir)).select("memory_id", "workspace_id")


@register("filter_types", with_fixtures(
    "SELECT memory_id, type FROM fx_memories WHERE type IN ('decision', 'todo')", "fx_memories"))
def q_filter_types(spark, sf_dir):
    return st.filter_types(fx.fx_memories(spark, sf_dir), ["decision", "todo"]).select("memory_id", "type")


@register("active_tasks_filter", with_fixtures(
    f"SELECT memory_id, type, tags FROM fx_memories WHERE type = 'todo' OR {has_active('tags')}", "fx_memories"))
def q_active_tasks_filter(spark, sf_dir):
    return st.active_tasks_filter(fx.fx_memories(spark, sf_dir)).select("memory_id", "type", "tags")


@register("recent_days", with_fixtures(
    f"SELECT memory_id, created_at FROM fx_memories WHERE created_at >= {NOW - 7 * 86400000}", "fx_memories"))
def q_recent_days(spark, sf_dir):
    return st.recent_days(fx.fx_memories(spark, sf_dir), NOW, 7).select("memory_id", "created_at")


_IDS_SQL = "SELECT memory_id FROM fx_memories WHERE memory_id % 13 = 0 UNION ALL SELECT CAST(-1 AS BIGINT)"


def _ids(spark, sf_dir):
    m = fx.fx_memories(spark, sf_dir)
    return m.where(F.col("memory_id") % 13 == 0).select("memory_id").unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("memory_id")))


@register("get_memories", with_fixtures(f"""SELECT i.memory_id, m.workspace_id, m.type, m.created_at
FROM ({_IDS_SQL}) i LEFT JOIN fx_memories m ON m.memory_id = i.memory_id""", "fx_memories"))
def q_get_memories(spark, sf_dir):
    r = st.get_memories(fx.fx_memories(spark, sf_dir), _ids(spark, sf_dir))
    return r.select("memory_id", "workspace_id", "type", "created_at")


@register("get_workspaces", with_fixtures("""SELECT u.id, b.root_path, b.name, b.created_at
FROM fx_workspaces_updates u LEFT JOIN fx_workspaces_base b ON b.id = u.id""",
                                          "fx_workspaces_base", "fx_workspaces_updates"))
def q_get_workspaces(spark, sf_dir):
    r = st.get_workspaces(fx.fx_workspaces_base(spark, sf_dir), fx.fx_workspaces_updates(spark, sf_dir).select("id"))
    return r.select("id", "root_path", "name", "created_at")


VALIDATE_SQL = """CASE WHEN content IS NULL OR regexp_replace(content, '\\s', '', 'g') = '' THEN 'blank_content'
  WHEN type IS NULL OR type NOT IN ('note', 'decision', 'gotcha', 'todo') THEN 'unknown_type'
  WHEN importance IS NULL OR isnan(importance) OR importance < 0.0 OR importance > 1.0
    THEN 'importance_out_of_range' END"""


@register("validate_memories", with_fixtures(
    f"SELECT conv_id, turn, {VALIDATE_SQL} AS reject_reason FROM fx_candidates", "fx_candidates"))
def q_validate_memories(spark, sf_dir):
    return st.validate_memories(fx.fx_candidates(spark, sf_dir)).select("conv_id", "turn", "reject_reason")


def _vq(spark, sf_dir):
    q = fx.fx_queries(spark, sf_dir)
    return q.withColumn("k", ((F.col("qid") % 23) - 1).cast("int"))


@register("validate_queries", with_fixtures("""SELECT qid, CASE
  WHEN query_text IS NULL OR regexp_replace(query_text, '\\s', '', 'g') = '' THEN 'blank_query'
  WHEN k IS NULL OR k < 1 OR k > 20 THEN 'k_out_of_range' END AS reject_reason
FROM (SELECT qid, query_text, CAST(qid % 23 - 1 AS INTEGER) AS k FROM fx_queries)""", "fx_queries"))
def q_validate_queries(spark, sf_dir):
    return st.validate_queries(_vq(spark, sf_dir)).select("qid", "reject_reason")


@register("orphan_memories", with_fixtures(
    "SELECT conv_id, turn, workspace_id FROM fx_candidates WHERE workspace_id NOT IN (SELECT id FROM fx_known_workspaces)",
    "fx_candidates", "fx_known_workspaces"))
def q_orphan_memories(spark, sf_dir):
    o = st.orphan_memories(fx.fx_candidates(spark, sf_dir), fx.fx_known_workspaces(spark, sf_dir))
    return o.select("conv_id", "turn", "workspace_id")


@register("upsert_workspaces", with_fixtures("""
SELECT coalesce(u.id, b.id) AS id,
  CASE WHEN u.id IS NOT NULL THEN u.root_path ELSE b.root_path END AS root_path,
  CASE WHEN u.id IS NOT NULL THEN u.name ELSE b.name END AS name,
  CASE WHEN u.id IS NOT NULL THEN u.repo_url ELSE b.repo_url END AS repo_url,
  coalesce(b.created_at, u.created_at) AS created_at
FROM fx_workspaces_base b FULL OUTER JOIN fx_workspaces_updates u ON u.id = b.id""",
    "fx_workspaces_base", "fx_workspaces_updates"))
def q_upsert_workspaces(spark, sf_dir):
    return st.upsert_workspaces(fx.fx_workspaces_base(spark, sf_dir), fx.fx_workspaces_updates(spark, sf_dir))


LOG_SQL = """SELECT workspace_id, session_id, hydrated_at, context_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, session_id ORDER BY src DESC, seq DESC, hydrated_at DESC) AS rn
  FROM (SELECT workspace_id, session_id, hydrated_at, context_hash, 0 AS seq, 0 AS src FROM fx_hydration_events WHERE seq = 0
        UNION ALL SELECT workspace_id, session_id, hydrated_at, context_hash, seq, 1 AS src FROM fx_hydration_events WHERE seq > 0))
WHERE rn = 1"""


def _log(spark, sf_dir):
    ev = fx.fx_hydration_events(spark, sf_dir)
    initial = st.log_hydration(None, ev.where("seq = 0"))
    return st.log_hydration(initial, ev.where("seq > 0"))


@register("log_hydration", with_fixtures(LOG_SQL, "fx_hydration_events"))
def q_log_hydration(spark, sf_dir):
    return _log(spark, sf_dir)


@register("hydration_changes", with_fixtures(f"""SELECT workspace_id, session_id, prev_hash,
  prev_hash IS NULL OR prev_hash <> context_hash AS changed FROM (
  SELECT *, lag(context_hash) OVER (PARTITION BY workspace_id ORDER BY hydrated_at, session_id) AS prev_hash
  FROM ({LOG_SQL}))""", "fx_hydration_events"))
def q_hydration_changes(spark, sf_dir):
    return st.hydration_changes(_log(spark, sf_dir)).select("workspace_id", "session_id", "prev_hash", "changed")


@register("delete_memories", with_fixtures(f"""
SELECT memory_id, 'kept' AS status FROM fx_memories WHERE memory_id NOT IN ({_IDS_SQL})
UNION ALL
SELECT i.memory_id, CASE WHEN m.memory_id IS NULL THEN 'missing' ELSE 'removed' END
FROM ({_IDS_SQL}) i LEFT JOIN fx_memories m ON m.memory_id = i.memory_id""", "fx_memories"))
def q_delete_memories(spark, sf_dir):
    kept, report = st.delete_memories(fx.fx_memories(spark, sf_dir), _ids(spark, sf_dir))
    return kept.select("memory_id", F.lit("kept").alias("status")).unionByName(
        report.select("memory_id", F.when(F.col("removed"), "removed").otherwise("missing").alias("status")))


@register("read_memories", with_fixtures("""SELECT CAST(memory_id AS VARCHAR) AS memory_id, workspace_id, type, content,
  tags, importance, created_at, archived_at FROM fx_memories""", "fx_memories"))
def q_read_memories(spark, sf_dir):
    """The fixture goes through the sink (one folder per workspace) and comes back through the reader."""
    path = scratch_dir(spark, f"memories-{uuid.uuid4().hex[:12]}")
    io.append_memories(fx.fx_memories(spark, sf_dir), path)
    return io.read_memories(spark, path).select("memory_id", "workspace_id", "type", "content", "tags", "importance",
                                                "created_at", "archived_at")


@register("read_commits", with_fixtures(
    "SELECT workspace_id, sha, author, message, committed_at FROM fx_commits", "fx_commits"))
def q_read_commits(spark, sf_dir):
    path = scratch_dir(spark, f"commits-{uuid.uuid4().hex[:12]}")
    conform(fx.fx_commits(spark, sf_dir), COMMIT_SCHEMA).write.parquet(path)
    return io.read_commits(spark, path)


_REM_TS = K.FIXTURE_NOW_MS
_ULID_SQL = (f"{_crockford_sql(str(_REM_TS), 10)} || {_crockford_sql(chr(40) + chr(39) + '0x' + chr(39) + ' || substr(' + _H + ', 1, 10))::BIGINT', 8)}"
             f" || {_crockford_sql(chr(40) + chr(39) + '0x' + chr(39) + ' || substr(' + _H + ', 11, 10))::BIGINT', 8)}")


ACCEPTED_SQL = f"""SELECT conv_id, turn, workspace_id, {_ULID_SQL} AS id, {_REM_TS} AS created_at FROM fx_candidates
WHERE ({VALIDATE_SQL}) IS NULL AND workspace_id IN (SELECT id FROM fx_known_workspaces)"""


@register("remember_batch", with_fixtures(f"""
SELECT conv_id, turn, id, created_at, 'accepted' AS status FROM ({ACCEPTED_SQL})
UNION ALL
SELECT conv_id, turn, NULL, NULL, coalesce({VALIDATE_SQL}, 'unknown_workspace') FROM fx_candidates
WHERE ({VALIDATE_SQL}) IS NOT NULL OR workspace_id NOT IN (SELECT id FROM fx_known_workspaces)""",
    "fx_candidates", "fx_known_workspaces"))
def q_remember_batch(spark, sf_dir):
    ok, rej = io.remember_batch(fx.fx_candidates(spark, sf_dir), fx.fx_known_workspaces(spark, sf_dir), _REM_TS,
                                key_cols=["conv_id", "turn"])
    return ok.select("conv_id", "turn", "id", "created_at", F.lit("accepted").alias("status")).unionByName(
        rej.select("conv_id", "turn", F.lit(None).cast("string").alias("id"),
                   F.lit(None).cast("long").alias("created_at"), F.col("reject_reason").alias("status")))


_VERBS = ", ".join(f"'{w}'" for w in K.GEN_VERBS)
_NOUNS = ", ".join(f"'{w}'" for w in K.GEN_NOUNS)
_OBJS = ", ".join(f"'{w}'" for w in K.GEN_OBJECTS)
_TYPES = ", ".join(f"'{w}'" for w in K.GEN_TYPES)


@register("generate_memories", f"""SELECT doc_id AS memory_id, [{_TYPES}][doc_id % 4 + 1] AS type,
  [{_VERBS}][doc_id % 6 + 1] || ' ' || [{_NOUNS}][doc_id % 8 + 1] || ' ' || [{_OBJS}][doc_id % 5 + 1]
    || '. Memory #' || CAST(doc_id AS VARCHAR) || '.' || coalesce(chr(10) || text, '') AS content, source AS workspace_id,
  CAST(doc_id % 10 AS DOUBLE) / 10.0::DOUBLE AS importance, {K.FIXTURE_NOW_MS} - doc_id * 1000 AS created_at
FROM documents""")
def q_generate_memories(spark, sf_dir):
    """A load corpus over the documents' own texts and sources."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    g = io.generate_memories_for(docs, id_col="doc_id", text_col="text", workspace_col="source")
    return g.select("memory_id", "workspace_id", "type", "content", "importance", "created_at")
