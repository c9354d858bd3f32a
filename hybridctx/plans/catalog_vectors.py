"""Catalog entries: similarity, normalisation, pooling, dimension guard and embedders."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.functions.columns import dot_similarity, l2_normalize, l2_normalize_clamp
from hybridctx.operators import vectors as vx
from hybridctx.plans import fixtures as fx
from hybridctx.plans.catalog_store import VALIDATE_SQL
from hybridctx.plans.oracle_fixtures import with_fixtures
from hybridctx.plans.registry import register
from hybridctx.plans.sqlparts import dot, tok
from hybridctx.sources import io


def _r6(v):
    # + 0.0 makes zero unsigned: the engines' round() treat the sign of a tiny negative number differently
    return F.transform(v, lambda x: F.round(x.cast("double"), 6) + F.lit(0.0))


def _r6_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x::DOUBLE, 6) + 0.0::DOUBLE)"


def _clamp_sql(v: str) -> str:
    norm = f"CAST(sqrt(list_reduce(list_transform({v}, lambda x: x * x), lambda a, b: a + b)::DOUBLE) AS FLOAT)"
    scale = f"CAST(1.0::DOUBLE / greatest({norm}, CAST(1e-9 AS FLOAT))::DOUBLE AS FLOAT)"
    return f"list_transform({v}, lambda x: x * {scale})"


def _width(column: str, by: int) -> str:
    """Every 3rd and 5th vector is cut, so that query and stored widths differ both ways."""
    return f"CASE WHEN memory_id % 3 = {by} THEN {column}[1:48] WHEN memory_id % 5 = {by} THEN {column}[1:32] ELSE {column} END"


def _cut(v, by):
    i = F.col("memory_id")
    return v.withColumn("embedding", F.when(i % 3 == by, F.slice("embedding", 1, 48))
                        .when(i % 5 == by, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))


@register("dot_similarity", with_fixtures(f"""SELECT a.memory_id,
  CASE WHEN len(b.v) >= len(a.v) THEN round({dot('a.v', 'b.v[1:len(a.v)]')}, 9) + 0.0::DOUBLE END AS sim
FROM (SELECT memory_id, {_width('embedding', 0)} AS v FROM fx_vectors) a
JOIN (SELECT memory_id, {_width('embedding', 1)} AS v FROM fx_vectors) b ON b.memory_id = a.memory_id + 1""",
                                          "fx_vectors"))
def q_dot_similarity(spark, sf_dir):
    v = fx.fx_vectors(spark, sf_dir)
    b = _cut(v, 1).select((F.col("memory_id") - 1).alias("memory_id"), F.col("embedding").alias("next_vec"))
    return _cut(v, 0).join(b, "memory_id").select(
        "memory_id", (F.round(dot_similarity("embedding", "next_vec"), 9) + F.lit(0.0)).alias("sim"))


_SCALED = "list_transform(embedding, lambda x: x * CAST(memory_id % 5 AS FLOAT))"


def _scaled(spark, sf_dir):
    v = fx.fx_vectors(spark, sf_dir)
    return v.select("memory_id", F.transform("embedding", lambda x: x * (F.col("memory_id") % 5).cast("float"))
                    .alias("v"))


@register("l2_normalize", with_fixtures(f"""SELECT memory_id, {_r6_sql('''CASE WHEN norm < 1e-10 THEN v
  ELSE list_transform(v, lambda x: x * CAST(1.0::DOUBLE / norm AS FLOAT)) END''')} AS normalized FROM (
  SELECT memory_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
  FROM (SELECT memory_id, {_SCALED} AS v FROM fx_vectors))""", "fx_vectors"))
def q_l2_normalize(spark, sf_dir):
    return _scaled(spark, sf_dir).select("memory_id", _r6(l2_normalize("v")).alias("normalized"))


@register("l2_normalize_clamp", with_fixtures(f"""SELECT memory_id, {_r6_sql(_clamp_sql('v'))} AS normalized
FROM (SELECT memory_id, {_SCALED} AS v FROM fx_vectors)""", "fx_vectors"))
def q_l2_normalize_clamp(spark, sf_dir):
    return _scaled(spark, sf_dir).select("memory_id", _r6(l2_normalize_clamp("v")).alias("normalized"))


@register("pool_vectors", with_fixtures(f"""SELECT label, {_r6_sql(_clamp_sql('p'))} AS pooled FROM (
  SELECT label, list(mean ORDER BY i) AS p FROM (
    SELECT label, i, CAST(sum(x::DOUBLE * m) / greatest(sum(m), 1e-9::DOUBLE) AS FLOAT) AS mean FROM (
      SELECT label, CASE WHEN memory_id % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS m,
        unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM fx_vectors)
    GROUP BY label, i) GROUP BY label)""", "fx_vectors"))
def q_pool_vectors(spark, sf_dir):
    v = fx.fx_vectors(spark, sf_dir).withColumn(
        "m", F.when(F.col("memory_id") % 3 != 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    p = vx.pool_vectors(v, "label", "embedding", "m")
    return p.select("label", _r6("pooled").alias("pooled"))


def _dim_mixed(spark, sf_dir):
    v = fx.fx_vectors(spark, sf_dir)
    d = fx.fx_dim_mix(spark, sf_dir)
    j = v.join(d, "memory_id")
    return j.select("memory_id", "workspace_id",
                    F.when(F.col("dim") == 32, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
                    .alias("embedding"))


@register("embedding_dim_guard", with_fixtures("""SELECT workspace_id, min_dim, max_dim, n_vectors,
  min_dim = 64 AND max_dim = 64 AS ok,
  CASE WHEN min_dim = 64 AND max_dim = 64 THEN NULL ELSE
    'stored vectors have ' || CAST(CASE WHEN min_dim <> 64 THEN min_dim ELSE max_dim END AS VARCHAR)
    || ' components, the embedder gives 64'
  END AS message
FROM (SELECT d.workspace_id, min(len(CASE WHEN d.dim = 32 THEN v.embedding[1:32] ELSE v.embedding END)) AS min_dim,
  max(len(CASE WHEN d.dim = 32 THEN v.embedding[1:32] ELSE v.embedding END)) AS max_dim, count(*) AS n_vectors
  FROM fx_vectors v JOIN fx_dim_mix d ON d.memory_id = v.memory_id WHERE v.embedding IS NOT NULL
  GROUP BY d.workspace_id)""", "fx_vectors", "fx_dim_mix"))
def q_embedding_dim_guard(spark, sf_dir):
    g = vx.embedding_dim_guard(_dim_mixed(spark, sf_dir), 64)
    return g.select("workspace_id", F.col("min_dim").cast("long").alias("min_dim"),
                    F.col("max_dim").cast("long").alias("max_dim"), F.col("n_vectors").cast("long").alias("n_vectors"),
                    "ok", "message")


@register("hash_embed", f"""SELECT doc_id, {_r6_sql(_clamp_sql('dense'))} AS embedding FROM (
  SELECT d.doc_id, list_transform(range(64), lambda i: coalesce(list_sum(list_transform(
      list_filter(coalesce(c.entries, []), lambda e: e.b = i), lambda e: e.n)), 0)::FLOAT) AS dense
  FROM documents d LEFT JOIN (
    SELECT doc_id, list({{'b': b, 'n': n}}) AS entries FROM (
      SELECT doc_id, b, count(*)::FLOAT AS n FROM (
        SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (
          SELECT doc_id, unnest({tok('text')}) AS t FROM documents))
      GROUP BY doc_id, b) GROUP BY doc_id) c ON c.doc_id = d.doc_id)""")
def q_hash_embed(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = vx.hash_embed(d, "doc_id", "text", 64)
    return e.select("doc_id", _r6("embedding").alias("embedding"))


@register("embed_corpus", f"""WITH toks AS (
  SELECT concat_ws(':', conv_id, turn) AS key, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS t
  FROM conversations WHERE text IS NOT NULL),
n AS (SELECT key, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS n FROM toks GROUP BY ALL),
e AS (SELECT key, map_from_entries(list((b, n))) AS m, greatest(CAST(sqrt(sum(n * n)::DOUBLE) AS FLOAT), 1e-9::FLOAT) AS norm
  FROM n GROUP BY key)
SELECT concat_ws(':', c.conv_id, c.turn) AS key, 64 AS dim, {_r6_sql("""
    list_transform(range(64), lambda i: coalesce(e.m[i], 0)::FLOAT / coalesce(e.norm, 1e-9::FLOAT))""")} AS embedding
FROM conversations c LEFT JOIN e ON e.key = concat_ws(':', c.conv_id, c.turn) WHERE c.text IS NOT NULL""")
def q_embed_corpus(spark, sf_dir):
    """Pluggable embedder in Arrow batches of 100 over the distinct conversation texts."""
    c = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text") \
        .withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    e = vx.embed_corpus(c, "key", "text", vx.HashingEmbedder(64))
    return e.select("key", F.size("embedding").alias("dim"), _r6("embedding").alias("embedding"))


_TWICE = "SELECT * FROM fx_candidates UNION ALL SELECT * REPLACE (turn + 1000 AS turn) FROM fx_candidates"


@register("remember_embedded", with_fixtures(f"""
SELECT c.conv_id, c.turn, c.workspace_id, 64 AS dim, {_r6_sql("""
    list_transform(range(64), lambda i: coalesce(e.m[i], 0)::FLOAT / coalesce(e.norm, 1e-9::FLOAT))""")} AS embedding
FROM accepted c LEFT JOIN e ON e.content = c.content""", "fx_candidates", "fx_known_workspaces", extra={
    "accepted": f"SELECT * FROM ({_TWICE}) WHERE ({VALIDATE_SQL}) IS NULL AND workspace_id IN (SELECT id FROM fx_known_workspaces)",
    "toks": """SELECT content, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS t
  FROM (SELECT DISTINCT content FROM fx_candidates WHERE content IS NOT NULL)""",
    "n": "SELECT content, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS n FROM toks GROUP BY ALL",
    "e": """SELECT content, map_from_entries(list((b, n))) AS m, greatest(CAST(sqrt(sum(n * n)::DOUBLE) AS FLOAT), 1e-9::FLOAT) AS norm
  FROM n GROUP BY content"""}))
def q_remember_embedded(spark, sf_dir):
    """remember_batch with an embedder; every text comes twice and is embedded once."""
    c = fx.fx_candidates(spark, sf_dir)
    both = c.unionByName(c.withColumn("turn", F.col("turn") + 1000))
    ok, _ = io.remember_batch(both, fx.fx_known_workspaces(spark, sf_dir), K.FIXTURE_NOW_MS, vx.HashingEmbedder(64), ["conv_id", "turn"])
    return ok.select("conv_id", "turn", "workspace_id", F.size("embedding").alias("dim"), _r6("embedding").alias("embedding"))


@register("attach_embeddings", with_fixtures("""SELECT m.memory_id, v.embedding IS NOT NULL AS has_embedding,
  len(v.embedding) AS dim FROM fx_memories m LEFT JOIN fx_vectors v ON v.memory_id = m.memory_id""",
    "fx_memories", "fx_vectors"))
def q_attach_embeddings(spark, sf_dir):
    a = vx.attach_embeddings(fx.fx_memories(spark, sf_dir), fx.fx_vectors(spark, sf_dir))
    return a.select("memory_id", F.col("embedding").isNotNull().alias("has_embedding"),
                    F.when(F.col("embedding").isNull(), F.lit(None)).otherwise(F.size("embedding"))
                    .cast("long").alias("dim"))
