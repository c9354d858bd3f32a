"""DuckDB texts of the fixture views (same rows as ``hybridctx.plans.fixtures`` on every scale)."""

from __future__ import annotations

MS = "(epoch_us(e.ts) // 1000)"
SEC = "(epoch_us(o.o_orderdate) // 1000000)"

FIXTURES: dict[str, str] = {
    "fx_memories": f"""
SELECT d.doc_id AS memory_id, d.source AS workspace_id,
  CASE d.doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'gotcha' WHEN 2 THEN 'todo' ELSE 'note' END AS type,
  d.text AS content,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN concat(e.event_type, ', Active') ELSE e.event_type END AS tags,
  CAST(d.doc_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS importance,
  {MS} AS created_at,
  CASE WHEN d.doc_id % 17 = 0 THEN {MS} + 86400000 ELSE NULL END AS archived_at
FROM documents d JOIN events e ON e.event_id = d.doc_id * 5""",
    "fx_vectors": "SELECT vec_id AS memory_id, label, embedding FROM embeddings",
    "fx_queries": """
SELECT b.item_id * 1000000 + b.j AS qid, b.item_id, concat('src', CAST((b.item_id + b.j) % 20 AS VARCHAR)) AS workspace_id,
  CASE WHEN b.j = 0 THEN b.text WHEN b.j % 4 = 1 THEN b.x || ' ' || b.y || ' ' || b.z
       WHEN b.j % 4 = 2 THEN '"' || b.x || '-' || b.y || '" ' || b.z
       WHEN b.j % 4 = 3 THEN b.x || ' "' || b.y || '" ' || b.z || ' ' || b.x
       ELSE b.x || ', ' || b.y || ' & ' || b.z END AS query_text,
  v.embedding AS query_vec, 5 AS k,
  CASE WHEN (b.item_id + b.j) % 5 = 0 THEN 'decision' ELSE NULL END AS only_type
FROM (SELECT item_id, text, j, coalesce(w[3 * j - 2], '') AS x, coalesce(w[3 * j - 1], '') AS y, coalesce(w[3 * j], '') AS z
      FROM (SELECT item_id, text, w, unnest(range(0, (len(w) + 2) // 3 + 1)) AS j
            FROM (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark))) b
JOIN embeddings v ON v.vec_id = b.item_id""",
    "fx_candidates": """
SELECT conv_id, turn, concat('src', CAST(conv_id % 23 AS VARCHAR)) AS workspace_id,
  CASE role WHEN 'user' THEN 'note' WHEN 'assistant' THEN 'decision' ELSE 'SYSTEM' END AS type,
  CASE WHEN turn = 5 THEN '   ' ELSE text END AS content,
  CAST(conv_id % 13 AS DOUBLE) / CAST(10 AS DOUBLE) AS importance
FROM conversations""",
    "fx_known_workspaces": "SELECT DISTINCT source AS id FROM documents",
    "fx_workspaces_base": """
SELECT concat('ws', CAST(n_nationkey AS VARCHAR)) AS id, concat('/repos/', n_name) AS root_path, n_name AS name,
  CAST(NULL AS VARCHAR) AS repo_url, CAST(n_regionkey AS BIGINT) AS created_at
FROM nation WHERE n_nationkey < 15""",
    "fx_workspaces_updates": """
SELECT concat('ws', CAST(n_nationkey AS VARCHAR)) AS id, concat('/repos/', n_name) AS root_path,
  concat(n_name, '_v2') AS name, concat('http://x/', n_name) AS repo_url, CAST(99 AS BIGINT) AS created_at
FROM nation WHERE n_nationkey >= 10""",
    "fx_hydration_events": """
SELECT concat('src', CAST(conv_id % 20 AS VARCHAR)) AS workspace_id, CAST(conv_id AS VARCHAR) AS session_id,
  turn AS seq, CAST(1704067200 AS BIGINT) + conv_id * 60 + turn AS hydrated_at, sha256(text) AS context_hash
FROM conversations""",
    "fx_commits": f"""
SELECT concat('src', CAST(c.c_nationkey AS VARCHAR)) AS workspace_id, sha1(CAST(o.o_orderkey AS VARCHAR)) AS sha,
  c.c_name AS author, concat(o.o_orderpriority, ' ', o.o_orderstatus, chr(10), 'body') AS message,
  {SEC} AS committed_at
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "fx_repos": """
SELECT concat('src', CAST(n_nationkey + 3 AS VARCHAR)) AS workspace_id,
  CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE lower(n_name) END AS branch, n_nationkey % 4 AS uncommitted
FROM nation""",
    "fx_status": """
SELECT concat('src', CAST(l_suppkey % 20 AS VARCHAR)) AS workspace_id,
  concat('f', CAST(l_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR)) AS path,
  CASE l_returnflag WHEN 'R' THEN 'ignored' WHEN 'A' THEN 'submodule' ELSE 'modified' END AS state
FROM lineitem""",
    "fx_paths": "SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS path FROM pages",
    "fx_roots": """
SELECT DISTINCT root FROM (SELECT unnest([regexp_extract(url, '^(https?://[^/]+/[a-z][a-z])/', 1),
  regexp_extract(url, '^(https?://[^/]+)/', 1)]) AS root FROM pages) WHERE root <> ''""",
    "fx_rootless_paths": "SELECT -1 - n_nationkey AS page_id, '/repos/' || n_name || '/src' AS path FROM nation",
    "fx_dim_mix": """
SELECT vec_id AS memory_id, label AS workspace_id, CASE WHEN vec_id % 97 = 0 THEN 32 ELSE 64 END AS dim
FROM embeddings""",
    "fx_digest_workspaces": """
SELECT DISTINCT concat('src', CAST(conv_id % 29 AS VARCHAR)) AS id, concat('src', CAST(conv_id % 29 AS VARCHAR)) AS name
FROM conversations""",
}


def with_fixtures(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `body` with CTEs for the named fixtures (and extra named CTEs, in order)."""
    parts = [f"{n} AS ({FIXTURES[n]}\n)" for n in names]
    for n, text in (extra or {}).items():
        parts.append(f"{n} AS ({text}\n)")
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
