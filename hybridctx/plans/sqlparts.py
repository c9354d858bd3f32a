"""Reusable DuckDB fragments for the oracle texts (mirrors of the Spark expressions)."""

from hybridctx import constants as K

NOW_MS = K.FIXTURE_NOW_MS


def tok(x: str) -> str:
    return (f"coalesce(regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), "
            f"[]::VARCHAR[])")


def recency(created: str, importance: str, now_ms: int = NOW_MS) -> str:
    return (f"(exp(-((CAST({now_ms // 1000} AS BIGINT) - ({created} // 1000))::DOUBLE / 86400.0::DOUBLE) "
            f"/ 30.0::DOUBLE) * (0.5::DOUBLE + {importance}))")


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] * x[2])::DOUBLE))"


def age(created_ms: str, now_ms: int = NOW_MS) -> str:
    h = f"(greatest({now_ms} - {created_ms}, 0)::DOUBLE / 3600000.0::DOUBLE)"
    return (f"(CASE WHEN {h} < 1 THEN 'just now' WHEN {h} < 24 THEN CAST(CAST(floor({h}) AS BIGINT) AS VARCHAR) || 'h ago' "
            f"ELSE CAST(CAST(floor({h} / 24) AS BIGINT) AS VARCHAR) || 'd ago' END)")


def split_tags(x: str) -> str:
    return (f"coalesce(list_filter(list_transform(string_split({x}, ','), "
            f"lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), []::VARCHAR[])")


def has_active(x: str) -> str:
    return (f"coalesce(len(list_filter(string_split({x}, ','), "
            f"lambda t: lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) = 'active')) > 0, false)")


# CTEs of the text index over a memories CTE named `mem` (workspace_id, memory_id, content, tags, archived_at)
# and a queries CTE named `q` (qid, workspace_id, query_text).
FTS_CTES = {
    "toks": f"""SELECT workspace_id, memory_id, archived_at, {tok('content')} AS ct, {tok('tags')} AS tt FROM mem""",
    "postings": """
SELECT workspace_id, memory_id, 0 AS col, unnest(range(len(ct))) AS pos, unnest(ct) AS term FROM toks
UNION ALL
SELECT workspace_id, memory_id, 1 AS col, unnest(range(len(tt))) AS pos, unnest(tt) AS term FROM toks""",
    "doc_stats": """SELECT workspace_id, memory_id, len(ct) + len(tt) AS dl, archived_at IS NULL AS live FROM toks""",
    "ws_stats": """SELECT workspace_id, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_tokens,
  CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM doc_stats GROUP BY workspace_id""",
    "pieces": """SELECT qid, workspace_id, unnest(range(len(string_split(query_text, ' ')))) AS phrase_no,
  unnest(string_split(query_text, ' ')) AS piece FROM q""",
    "phr": f"""SELECT qid, workspace_id, phrase_no, {tok("replace(piece, '\"', '')")} AS toks FROM pieces""",
    "phr2": """SELECT qid, workspace_id, phrase_no, toks, len(toks) AS n_terms,
  count(*) OVER (PARTITION BY qid) AS n_phrases FROM phr WHERE len(toks) > 0""",
    "qterms": """SELECT qid, workspace_id, phrase_no, unnest(range(len(toks))) AS "offset", unnest(toks) AS term,
  n_terms, n_phrases FROM phr2""",
    "occ": """SELECT t.qid, t.workspace_id, t.phrase_no, p.memory_id, p.col, p.pos - t."offset" AS start
FROM postings p JOIN qterms t ON t.workspace_id = p.workspace_id AND t.term = p.term
GROUP BY ALL HAVING count(*) = max(t.n_terms)""",
    "hits": """SELECT qid, workspace_id, phrase_no, memory_id, count(*) AS tf FROM occ GROUP BY ALL""",
    "nh": """SELECT qid, phrase_no, count(*) AS n_hit FROM hits GROUP BY ALL""",
    "per_phrase": """SELECT h.qid, h.workspace_id, h.memory_id, d.live,
  (CASE WHEN ln((s.n_docs::DOUBLE - nh.n_hit::DOUBLE + 0.5::DOUBLE) / (nh.n_hit::DOUBLE + 0.5::DOUBLE)) <= 0
        THEN 1e-6::DOUBLE
        ELSE ln((s.n_docs::DOUBLE - nh.n_hit::DOUBLE + 0.5::DOUBLE) / (nh.n_hit::DOUBLE + 0.5::DOUBLE)) END)
  * ((h.tf::DOUBLE * 2.2::DOUBLE) / (h.tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl::DOUBLE / s.avgdl))) AS s
FROM hits h JOIN nh ON nh.qid = h.qid AND nh.phrase_no = h.phrase_no
JOIN ws_stats s ON s.workspace_id = h.workspace_id
JOIN doc_stats d ON d.workspace_id = h.workspace_id AND d.memory_id = h.memory_id""",
    "bm25": """SELECT a.qid, a.workspace_id, a.memory_id, a.live, a.score FROM (
  SELECT qid, workspace_id, memory_id, live, sum(s) AS score, count(*) AS matched
  FROM per_phrase GROUP BY qid, workspace_id, memory_id, live) a
JOIN (SELECT DISTINCT qid, n_phrases FROM qterms) ph ON ph.qid = a.qid
WHERE a.matched = ph.n_phrases""",
    "fts_top": """SELECT qid, workspace_id, memory_id, fts_rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, memory_id ASC) AS fts_rank
  FROM bm25 WHERE live) WHERE fts_rank <= 20""",
}


def ctes(names: list[str]) -> dict[str, str]:
    return {n: FTS_CTES[n] for n in names}


FTS_ALL = ["toks", "postings", "doc_stats", "ws_stats", "pieces", "phr", "phr2", "qterms", "occ", "hits", "nh",
           "per_phrase", "bm25", "fts_top"]
