"""Catalog entries: context pool, ranked rows, lines, packing, digests, hydration and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.functions.columns import context_hash, format_age, hard_truncate_utf8
from hybridctx.operators import digest as dg
from hybridctx.plans import fixtures as fx
from hybridctx.plans.oracle_fixtures import with_fixtures
from hybridctx.plans.registry import register
from hybridctx.session import reliable_checkpoint
from hybridctx.plans.sqlparts import age, has_active, recency

NOW = K.FIXTURE_NOW_MS
FX = ("fx_memories", "fx_digest_workspaces", "fx_repos", "fx_commits")
NL = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lit(s: str) -> str:
    """A DuckDB string expression for a Python string that may contain newlines."""
    parts = s.split("\n")
    out = []
    for i, p in enumerate(parts):
        if p:
            out.append(_q(p))
        if i < len(parts) - 1:
            out.append(NL)
    return "(" + " || ".join(out or ["''"]) + ")"


NEWEST = "created_at DESC, memory_id DESC"
BASE = {
    "dmem": """SELECT memory_id, workspace_id, type, content, tags, importance, created_at, archived_at
FROM fx_memories""",
    "pool": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY {NEWEST}) AS pool_rank
  FROM dmem WHERE archived_at IS NULL) WHERE pool_rank <= 1000""",
    "tasks": f"""SELECT * FROM (SELECT *, CASE WHEN type = 'todo' THEN 'todo' ELSE 'active' END AS label,
  row_number() OVER (PARTITION BY workspace_id ORDER BY {NEWEST}) AS rank
  FROM pool WHERE type = 'todo' OR {has_active('tags')}) WHERE rank <= 10""",
    "decs": f"""SELECT * FROM (SELECT *, {recency('created_at', 'importance')} AS score,
  row_number() OVER (PARTITION BY workspace_id ORDER BY {recency('created_at', 'importance')} DESC, {NEWEST}) AS rank
  FROM pool WHERE type = 'decision') WHERE rank <= 3""",
    "week_rows": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY {NEWEST}) AS rank
  FROM pool WHERE created_at >= {NOW - 7 * 86400000}) WHERE rank <= 20""",
    "all_rows": f"""SELECT * FROM (SELECT *, {recency('created_at', 'importance')} AS score,
  row_number() OVER (PARTITION BY workspace_id ORDER BY {recency('created_at', 'importance')} DESC, {NEWEST}) AS rank
  FROM pool) WHERE rank <= 50""",
    "lines_current": f"""
SELECT workspace_id, 0 AS section, rank AS ord,
  '- [' || label || '] ' || content || ' (created ' || {age('created_at')} || ')' AS line FROM tasks
UNION ALL
SELECT d.workspace_id, 1 AS section, d.rank + coalesce(nt.n, 0) AS ord,
  '- ' || d.content || ' (importance ' || printf('%.1f', d.importance) || ')' AS line
FROM decs d LEFT JOIN (SELECT workspace_id, count(*) AS n FROM tasks GROUP BY workspace_id) nt
  ON nt.workspace_id = d.workspace_id""",
    "lines_week": f"""SELECT workspace_id, 0 AS section, rank AS ord,
  '- [' || type || '] ' || content || ' (created ' || {age('created_at')} || ')' AS line FROM week_rows""",
    "lines_all": f"""SELECT workspace_id, 0 AS section, rank AS ord,
  '- [' || type || '] ' || content || ' (importance ' || printf('%.1f', importance) || ', created '
  || {age('created_at')} || ')' AS line FROM all_rows""",
    "rc": f"""SELECT * FROM (SELECT workspace_id, sha, committed_at, substr(sha, 1, 7) AS short_sha,
  substr(regexp_replace(split_part(message, chr(10), 1), '^\\s+|\\s+$', '', 'g'), 1, 80) AS msg,
  row_number() OVER (PARTITION BY workspace_id ORDER BY committed_at DESC, sha ASC) AS rank FROM fx_commits)
  WHERE rank <= 3""",
    "rcl": f"""SELECT workspace_id, string_agg('- ' || short_sha || ' (' || {age('committed_at * 1000')} || ') ' || msg
  || chr(10), '' ORDER BY rank) AS lines FROM rc GROUP BY workspace_id""",
    "ws": "SELECT id AS workspace_id, name FROM fx_digest_workspaces",
    "branch": f"""SELECT w.workspace_id, r.workspace_id IS NOT NULL AS has_repo,
  CASE WHEN r.workspace_id IS NULL THEN {_lit(K.NO_REPO + chr(10))}
       WHEN r.branch IS NULL THEN {_lit(K.DETACHED + chr(10))}
       ELSE r.branch || CASE WHEN r.uncommitted > 0 THEN ' (' || CAST(r.uncommitted AS VARCHAR) || ' uncommitted file'
              || CASE WHEN r.uncommitted = 1 THEN '' ELSE 's' END || ')' ELSE '' END || chr(10)
            || CASE WHEN rcl.lines IS NOT NULL THEN chr(10) || {_q(K.RECENT_COMMITS)} || chr(10) || rcl.lines ELSE '' END
  END AS branch_block
FROM ws w LEFT JOIN fx_repos r ON r.workspace_id = w.workspace_id LEFT JOIN rcl ON rcl.workspace_id = w.workspace_id""",
}


def hard_cut(text: str, max_bytes) -> str:
    """DuckDB: the longest prefix of whole characters within max_bytes - note, and the note."""
    room = f"greatest({max_bytes} - {len(K.TRUNCATION_NOTE.encode('utf-8'))}, 0)"
    fits = f"list_max(list_filter(range(0, {room} + 1), lambda k: strlen(substr({text}, 1, k)) <= {room}))"
    return f"(substr({text}, 1, {fits}) || {_lit(K.TRUNCATION_NOTE)})"


def _digest_ctes(scope: str, max_bytes: int, title_prefix: str = K.TITLE_PREFIX, tag: str = "") -> dict[str, str]:
    """CTEs ending in `digest_<scope><tag>` (workspace_id, digest, n_lines, truncated)."""
    t = scope + tag
    title = f"({_q(title_prefix)} || w.name || chr(10))"
    none = _lit(K.NONE_LINE + "\n")

    def sec(j: int) -> str:
        return (f"coalesce((SELECT string_agg(i.line || chr(10), '' ORDER BY i.ord) FROM items_{scope} i "
                f"WHERE i.workspace_id = w.workspace_id AND i.section = {j} AND i.ord <= p.keep), {none})")

    if scope == "current":
        md0 = (f"{title} || {_lit(chr(10) + K.SECTION_BRANCH + chr(10))} || b.branch_block || "
               f"{_lit(chr(10) + K.SECTION_TASKS + chr(10))} || {none} || "
               f"{_lit(chr(10) + K.SECTION_DECISIONS + chr(10))} || {none}")
        md = (f"{title} || {_lit(chr(10) + K.SECTION_BRANCH + chr(10))} || b.branch_block || "
              f"{_lit(chr(10) + K.SECTION_TASKS + chr(10))} || {sec(0)} || "
              f"{_lit(chr(10) + K.SECTION_DECISIONS + chr(10))} || {sec(1)}")
        join_branch = "JOIN branch b ON b.workspace_id = w.workspace_id"
    else:
        header = K.SECTION_WEEK if scope == "week" else K.SECTION_ALL
        md0 = f"{title} || {_lit(chr(10) + header + chr(10))} || {none}"
        md = f"{title} || {_lit(chr(10) + header + chr(10))} || {sec(0)}"
        join_branch = ""
    note = _lit(K.TRUNCATION_NOTE)
    nb = len(K.TRUNCATION_NOTE.encode("utf-8"))
    return {
        f"items_{scope}": f"""SELECT workspace_id, section, ord, line,
  sum(strlen(line) + 1) OVER (PARTITION BY workspace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  dense_rank() OVER (PARTITION BY workspace_id ORDER BY section) AS ne,
  count(*) OVER (PARTITION BY workspace_id) AS n
FROM lines_{scope}""",
        f"f0_{t}": f"""SELECT w.workspace_id, w.name, strlen({md0}) AS f0 FROM ws w {join_branch}""",
        f"pack_{t}": f"""SELECT f.workspace_id, f.f0,
  coalesce(max(i.n), 0) AS n,
  CASE WHEN coalesce(max(i.n), 0) = 0 THEN f.f0 ELSE f.f0 + max(i.cum) - 7 * max(i.ne) END AS f_all,
  count(i.ord) FILTER (WHERE i.ord < i.n AND f.f0 + i.cum - 7 * i.ne + {nb} <= {max_bytes}) AS feasible
FROM f0_{t} f LEFT JOIN items_{scope} i ON i.workspace_id = f.workspace_id GROUP BY f.workspace_id, f.f0""",
        f"keep_{t}": f"""SELECT workspace_id, n, f0,
  CASE WHEN f_all <= {max_bytes} THEN n WHEN f0 + {nb} <= {max_bytes} THEN feasible ELSE 0 END AS keep,
  f_all > {max_bytes} AS truncated, f_all > {max_bytes} AND f0 + {nb} > {max_bytes} AS hard
FROM pack_{t}""",
        f"digest_{t}": f"""SELECT w.workspace_id,
  CASE WHEN p.hard THEN {hard_cut(md0, max_bytes)} WHEN p.truncated THEN {md} || {note} ELSE {md} END AS digest,
  CAST(p.keep AS INTEGER) AS n_lines, p.truncated
FROM ws w {join_branch} JOIN keep_{t} p ON p.workspace_id = w.workspace_id""",
    }


def _sql(body: str, *ctes_: dict) -> str:
    extra = dict(BASE)
    for c in ctes_:
        extra.update(c)
    return with_fixtures(body, *FX, extra=extra)


def _digest_inputs(spark, sf_dir):
    return (fx.fx_memories(spark, sf_dir), fx.fx_digest_workspaces(spark, sf_dir), fx.fx_repos(spark, sf_dir), fx.fx_commits(spark, sf_dir))


def _pool(spark, sf_dir):
    return dg.context_pool(_digest_inputs(spark, sf_dir)[0])


@register("context_pool", _sql("SELECT workspace_id, memory_id, pool_rank FROM pool"))
def q_context_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("workspace_id", "memory_id", F.col("pool_rank").cast("long").alias("pool_rank"))


@register("top_active_tasks", _sql("SELECT workspace_id, memory_id, label, rank FROM tasks"))
def q_top_active_tasks(spark, sf_dir):
    t = dg.top_active_tasks(_pool(spark, sf_dir))
    return t.select("workspace_id", "memory_id", "label", F.col("rank").cast("long").alias("rank"))


@register("top_decisions", _sql("SELECT workspace_id, memory_id, rank, round(score, 9) AS score FROM decs"))
def q_top_decisions(spark, sf_dir):
    d = dg.top_decisions(_pool(spark, sf_dir), NOW)
    return d.select("workspace_id", "memory_id", F.col("rank").cast("long").alias("rank"),
                    F.round("score", 9).alias("score"))


@register("week_digest_rows", _sql("SELECT workspace_id, memory_id, rank FROM week_rows"))
def q_week_digest_rows(spark, sf_dir):
    w = dg.week_digest_rows(_pool(spark, sf_dir), NOW)
    return w.select("workspace_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@register("all_digest_rows", _sql("SELECT workspace_id, memory_id, rank, round(score, 9) AS score FROM all_rows"))
def q_all_digest_rows(spark, sf_dir):
    a = dg.all_digest_rows(_pool(spark, sf_dir), NOW)
    return a.select("workspace_id", "memory_id", F.col("rank").cast("long").alias("rank"),
                    F.round("score", 9).alias("score"))


@register("format_age", with_fixtures(
    f"SELECT memory_id, {age('created_at')} AS age FROM fx_memories", "fx_memories"))
def q_format_age(spark, sf_dir):
    m = fx.fx_memories(spark, sf_dir)
    return m.select("memory_id", format_age("created_at", NOW).alias("age"))


@register("format_lines", _sql("""
SELECT workspace_id, 'current' AS scope, section, ord, line FROM lines_current
UNION ALL SELECT workspace_id, 'week', section, ord, line FROM lines_week
UNION ALL SELECT workspace_id, 'all', section, ord, line FROM lines_all"""))
def q_format_lines(spark, sf_dir):
    x = dg.digest_lines(_digest_inputs(spark, sf_dir)[0], dg.SCOPES, NOW).where("scope IS NOT NULL")
    return x.select("workspace_id", "scope", "section", F.col("ord").cast("long").alias("ord"), "line")


@register("recent_commits", _sql("""SELECT workspace_id, sha, short_sha, msg AS message, committed_at, rank FROM (
  SELECT workspace_id, sha, committed_at, substr(sha, 1, 7) AS short_sha,
  substr(regexp_replace(split_part(message, chr(10), 1), '^\\s+|\\s+$', '', 'g'), 1, 80) AS msg,
  row_number() OVER (PARTITION BY workspace_id ORDER BY committed_at DESC, sha ASC) AS rank FROM fx_commits)
WHERE rank <= 10"""))
def q_recent_commits(spark, sf_dir):
    c = dg.recent_commits(fx.fx_commits(spark, sf_dir), 10)
    return c.select("workspace_id", "sha", "short_sha", "message", "committed_at",
                    F.col("rank").cast("long").alias("rank"))


@register("branch_section", _sql("SELECT workspace_id, branch_block, has_repo FROM branch"))
def q_branch_section(spark, sf_dir):
    _, ws, repos, commits = _digest_inputs(spark, sf_dir)
    return dg.branch_section(ws, repos, commits, NOW)


# (scope, budget): the default, one that drops decisions before tasks, one below the empty digest (byte cut)
DIGESTS = [(s, K.DEFAULT_MAX_BYTES) for s in dg.SCOPES] + [("current", 20_000), ("current", 300), ("current", 64),
                                                           ("week", 48), ("all", 100_000)]
ALL_DIGESTS = {}
for _s, _b in DIGESTS:
    ALL_DIGESTS.update(_digest_ctes(_s, _b, tag=f"_{_b}"))
PACK_BUDGETS = (256, 2048, 20_000)


@register("pack_byte_budget", _sql(f"""
SELECT workspace_id, max_bytes, section, CAST(ord AS INTEGER) AS ord, strlen(line) AS bytes, total > max_bytes AS truncated
FROM (SELECT i.*, f.f0, f.f0 + cum - 7 * ne AS size, max(f.f0 + cum - 7 * ne) OVER (PARTITION BY i.workspace_id) AS total
      FROM items_current i JOIN f0_current_{K.DEFAULT_MAX_BYTES} f ON f.workspace_id = i.workspace_id),
  (SELECT unnest({list(PACK_BUDGETS)})::BIGINT AS max_bytes)
WHERE total <= max_bytes OR size + {dg.NOTE_BYTES} <= max_bytes""", ALL_DIGESTS))
def q_pack_byte_budget(spark, sf_dir):
    """The lines that stay in the current digest of every workspace, at several budgets."""
    m, ws, repos, commits = _digest_inputs(spark, sf_dir)
    fixed = dg.empty_digest_bytes(ws, repos, commits, "current", NOW)
    lines = reliable_checkpoint(dg.format_lines(m, "current", NOW).join(fixed.select("workspace_id"), "workspace_id", "left_semi"))
    fixed = reliable_checkpoint(fixed)
    out = None
    for b in PACK_BUDGETS:
        x = dg.pack_byte_budget(lines, b, fixed).select("workspace_id", F.lit(b).cast("long").alias("max_bytes"), "section",
                                                        "ord", F.octet_length("line").cast("long").alias("bytes"), "truncated")
        out = x if out is None else out.unionByName(x)
    return out


@register("context_digest", _sql("\nUNION ALL ".join(
    f"SELECT workspace_id, '{s}' AS scope, {b}::BIGINT AS max_bytes, digest, strlen(digest) AS bytes, n_lines, truncated "
    f"FROM digest_{s}_{b}" for s, b in DIGESTS), ALL_DIGESTS))
def q_context_digest(spark, sf_dir):
    d = dg.context_digests(*_digest_inputs(spark, sf_dir), DIGESTS, NOW)
    return d.select("workspace_id", "scope", "max_bytes", "digest", F.octet_length("digest").cast("long").alias("bytes"),
                    "n_lines", "truncated")


HYD_BUDGET = K.DEFAULT_MAX_BYTES - len(K.FRAMING.encode("utf-8"))
HYD_CTES = _digest_ctes("current", HYD_BUDGET)
HYD_CTES["hyd"] = f"""SELECT d.workspace_id,
  CASE WHEN NOT EXISTS (SELECT 1 FROM dmem m WHERE m.workspace_id = d.workspace_id AND m.archived_at IS NULL)
        AND NOT EXISTS (SELECT 1 FROM fx_repos r WHERE r.workspace_id = d.workspace_id)
       THEN {_lit(K.EMPTY_MESSAGE)} ELSE {_lit(K.FRAMING)} || d.digest END AS digest
FROM digest_current d"""


@register("hydration_digest", _sql("SELECT workspace_id, digest, strlen(digest) AS bytes FROM hyd", HYD_CTES))
def q_hydration_digest(spark, sf_dir):
    h = dg.hydration_digest(*_digest_inputs(spark, sf_dir), NOW)
    return h.select("workspace_id", "digest", F.octet_length("digest").cast("long").alias("bytes"))


@register("context_hash", _sql("SELECT workspace_id, sha256(digest) AS context_hash FROM hyd", HYD_CTES))
def q_context_hash(spark, sf_dir):
    h = dg.hydration_digest(*_digest_inputs(spark, sf_dir), NOW)
    return h.select("workspace_id", context_hash("digest").alias("context_hash"))


CUTS = (40, 64, 100, 257)


@register("hard_truncate_utf8", f"""SELECT doc_id, max_bytes::INTEGER AS max_bytes, {hard_cut("text", "max_bytes")} AS cut
FROM documents, (SELECT unnest({list(CUTS)}) AS max_bytes)""")
def q_hard_truncate_utf8(spark, sf_dir):
    """Byte cut of every document at several budgets."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    budgets = F.explode(F.array(*[F.lit(b) for b in CUTS]))
    x = d.select("doc_id", "text", budgets.alias("max_bytes"))
    return x.select("doc_id", "max_bytes", hard_truncate_utf8(F.col("text"), F.col("max_bytes")).alias("cut"))
