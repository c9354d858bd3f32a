"""Catalog entries: tokenizers, word pieces and token budgets over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridctx.functions.columns import basic_tokenize, fts_tokenize
from hybridctx.operators import text as tx
from hybridctx.plans import fixtures as fx
from hybridctx.plans.registry import register
from hybridctx.plans.sqlparts import tok

BASIC_SQL = "regexp_extract_all(lower(text), '([!-/:-@\\[-`{-~]|[^\\s!-/:-@\\[-`{-~]+)')"


@register("fts_tokenize", f"SELECT doc_id, {tok('text')} AS tokens FROM documents")
def q_fts_tokenize(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", fts_tokenize("text").alias("tokens"))


@register("basic_tokenize", f"SELECT doc_id, len({BASIC_SQL}) AS n_tokens, {BASIC_SQL} AS tokens FROM documents")
def q_basic_tokenize(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    t = basic_tokenize("text")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), t.alias("tokens"))


@register("token_budget_report", f"""SELECT lang, count(*) AS n_docs,
  CAST(sum(CASE WHEN len({BASIC_SQL}) + 2 > 256 THEN 1 ELSE 0 END) AS BIGINT) AS n_over_budget,
  max(len({BASIC_SQL})) AS max_tokens FROM documents GROUP BY lang""")
def q_token_budget_report(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    r = tx.token_budget_report(d, "text", "lang")
    return r.select("lang", F.col("n_docs").cast("long").alias("n_docs"),
                    F.col("n_over_budget").cast("long").alias("n_over_budget"),
                    F.col("max_tokens").cast("long").alias("max_tokens"))


WORDPIECE_SQL = f"""WITH RECURSIVE toks AS (SELECT doc_id, {BASIC_SQL} AS t FROM documents),
dfr AS (SELECT w, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(t)) AS w FROM toks) GROUP BY w),
freq AS (SELECT w FROM dfr WHERE n >= 0.01::DOUBLE * (SELECT count(*) FROM documents)),
chars AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(w, '')) AS c FROM dfr) WHERE c <> ''),
vt AS (SELECT c AS token FROM chars UNION SELECT '##' || c FROM chars UNION SELECT w FROM freq
       UNION SELECT '##' || substr(w, length(w) - 2, 3) FROM freq WHERE length(w) >= 3
       UNION SELECT unnest(['[CLS]', '[SEP]', '[UNK]'])),
vocab AS MATERIALIZED (SELECT token, (row_number() OVER (ORDER BY encode(token)) - 1)::INTEGER AS id FROM vt),
used AS (SELECT DISTINCT w FROM (SELECT unnest(t[1:254]) AS w FROM toks)),
starts AS (SELECT w, unnest(range(length(w))) AS start FROM used WHERE length(w) <= 100),
subs AS (SELECT w, start, unnest(range(1, least(length(w) - start, (SELECT max(length(token)) FROM vocab)) + 1)) AS n FROM starts),
edges AS MATERIALIZED (SELECT s.w, s.start, max(s.n) AS n, arg_max(v.id, s.n) AS id FROM subs s
  JOIN vocab v ON v.token = CASE WHEN s.start = 0 THEN substr(s.w, 1, s.n) ELSE '##' || substr(s.w, s.start + 1, s.n) END
  GROUP BY s.w, s.start),
walk AS (SELECT w, 0::BIGINT AS pos, []::INTEGER[] AS ids FROM used WHERE length(w) <= 100
  UNION ALL SELECT k.w, k.pos + e.n, list_append(k.ids, e.id) FROM walk k JOIN edges e ON e.w = k.w AND e.start = k.pos),
done AS (SELECT w, ids FROM walk WHERE pos = length(w)),
special AS (SELECT max(id) FILTER (token = '[CLS]') AS cls, max(id) FILTER (token = '[SEP]') AS sep,
  max(id) FILTER (token = '[UNK]') AS unk FROM vocab),
per_word AS (SELECT doc_id, i, t[i] AS w FROM (SELECT doc_id, t, unnest(range(1, least(len(t), 254) + 1)) AS i FROM toks)),
per_doc AS (SELECT p.doc_id, flatten(list(coalesce(d.ids, [s.unk]) ORDER BY p.i)) AS ids
  FROM per_word p CROSS JOIN special s LEFT JOIN done d ON d.w = p.w GROUP BY p.doc_id)
SELECT d.doc_id, len(ids)::INTEGER AS n_ids, ids FROM (
  SELECT t.doc_id, [s.cls] || coalesce(p.ids[1:254], []::INTEGER[]) || [s.sep] AS ids
  FROM toks t CROSS JOIN special s LEFT JOIN per_doc p ON p.doc_id = t.doc_id) d"""


@register("wordpiece_corpus", WORDPIECE_SQL)
def q_wordpiece_corpus(spark, sf_dir):
    """Word pieces of every document with a vocabulary built from the same corpus."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = tx.corpus_vocabulary(d, "text")
    w = tx.wordpiece_corpus(d, "doc_id", "text", vocab)
    return w.select("doc_id", F.size("ids").alias("n_ids"), "ids")
