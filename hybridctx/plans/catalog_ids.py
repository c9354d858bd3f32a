"""Catalog entries: ids, fingerprints, text scalars and repository tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.functions.columns import (assign_ulid_col, content_fingerprint, preview, workspace_key,
                                         workspace_name)
from hybridctx.operators import repos
from hybridctx.plans import fixtures as fx
from hybridctx.plans.oracle_fixtures import with_fixtures
from hybridctx.plans.registry import register


@register("workspace_key", with_fixtures(
    "SELECT page_id, substr(sha1(path), 1, 16) AS workspace_key FROM fx_paths", "fx_paths"))
def q_workspace_key(spark, sf_dir):
    return fx.fx_paths(spark, sf_dir).select("page_id", workspace_key("path").alias("workspace_key"))


@register("workspace_name", with_fixtures(
    "SELECT page_id, split_part(regexp_replace(path, '/+$', ''), '/', -1) AS workspace_name FROM fx_paths",
    "fx_paths"))
def q_workspace_name(spark, sf_dir):
    return fx.fx_paths(spark, sf_dir).select("page_id", workspace_name("path").alias("workspace_name"))


@register("resolve_workspace", with_fixtures("""
SELECT p.page_id, p.path, coalesce(h.root, p.path) AS workspace_root FROM all_paths p LEFT JOIN (
  SELECT page_id, arg_max(anc, length(anc)) AS root FROM (
    SELECT page_id, unnest(list_transform(range(1, len(string_split(path, '/')) + 1),
      lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS anc FROM all_paths) c
  WHERE anc IN (SELECT root FROM fx_roots) GROUP BY page_id) h ON h.page_id = p.page_id""",
    "fx_paths", "fx_rootless_paths", "fx_roots",
    extra={"all_paths": "SELECT * FROM fx_paths UNION ALL SELECT * FROM fx_rootless_paths"}))
def q_resolve_workspace(spark, sf_dir):
    paths = fx.fx_paths(spark, sf_dir).unionByName(fx.fx_rootless_paths(spark, sf_dir))
    return repos.resolve_workspace(paths, fx.fx_roots(spark, sf_dir))


@register("dirty_counts", with_fixtures("""
SELECT w.id AS workspace_id, coalesce(c.n, 0) AS uncommitted FROM fx_digest_workspaces w LEFT JOIN (
  SELECT workspace_id, count(*) AS n FROM fx_status WHERE state NOT IN ('ignored', 'submodule') GROUP BY 1) c
ON c.workspace_id = w.id""", "fx_status", "fx_digest_workspaces"))
def q_dirty_counts(spark, sf_dir):
    d = repos.dirty_counts(fx.fx_status(spark, sf_dir), fx.fx_digest_workspaces(spark, sf_dir))
    return d.select("workspace_id", F.col("uncommitted").cast("long").alias("uncommitted"))


@register("content_fingerprint", with_fixtures(
    "SELECT conv_id, turn, substr(sha256(content), 1, 8) AS fingerprint FROM fx_candidates", "fx_candidates"))
def q_content_fingerprint(spark, sf_dir):
    c = fx.fx_candidates(spark, sf_dir)
    return c.select("conv_id", "turn", content_fingerprint("content").alias("fingerprint"))


@register("preview", with_fixtures(
    """SELECT conv_id, turn, CASE WHEN length(content) <= 60 THEN content ELSE substr(content, 1, 60) || '...' END
  AS preview FROM fx_candidates""", "fx_candidates"))
def q_preview(spark, sf_dir):
    c = fx.fx_candidates(spark, sf_dir)
    return c.select("conv_id", "turn", preview("content", 60).alias("preview"))


def _crockford_sql(expr: str, nchars: int) -> str:
    """Crockford base-32 characters of a non-negative BIGINT, most significant first."""
    alpha = K.CROCKFORD
    parts = [f"substr('{alpha}', CAST((({expr}) >> {5 * (nchars - 1 - i)}) & 31 AS INTEGER) + 1, 1)"
             for i in range(nchars)]
    return " || ".join(parts)


_TS = f"({K.FIXTURE_NOW_MS} + conv_id * 1000 + turn)"
_H = "sha256(concat_ws(chr(1), CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)))"


@register("assign_ulid", with_fixtures(f"""
SELECT conv_id, turn, {_crockford_sql(_TS, 10)}
  || {_crockford_sql(f"('0x' || substr({_H}, 1, 10))::BIGINT", 8)}
  || {_crockford_sql(f"('0x' || substr({_H}, 11, 10))::BIGINT", 8)} AS id
FROM fx_candidates""", "fx_candidates"))
def q_assign_ulid(spark, sf_dir):
    c = fx.fx_candidates(spark, sf_dir)
    ts = F.lit(K.FIXTURE_NOW_MS) + F.col("conv_id") * 1000 + F.col("turn")
    return c.select("conv_id", "turn", assign_ulid_col(ts, ["conv_id", "turn"]).alias("id"))
