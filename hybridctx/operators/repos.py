"""Repository tables (commits, status, roots) in place of probing working copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridctx.operators.digest import recent_commits  # noqa: F401  (re-export)
from hybridctx.operators.sizing import broadcast_if_small

WS = "workspace_id"


def dirty_counts(status: DataFrame, workspaces: DataFrame | None = None, ws_key: str = "id") -> DataFrame:
    """Changed files per repository; ignored and submodule entries excluded; clean repositories get 0."""
    counts = (status.where(~F.col("state").isin("ignored", "submodule"))
              .groupBy(WS).agg(F.count(F.lit(1)).alias("uncommitted")))
    if workspaces is None:
        return counts
    ws = workspaces.select(F.col(ws_key).alias(WS)).distinct()
    return ws.join(counts, WS, "left").select(WS, F.coalesce("uncommitted", F.lit(0)).alias("uncommitted"))


def resolve_workspace(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Nearest ancestor of each path (the path included) that is a known root; none -> the path itself.

    Ancestors are the '/'-prefixes of the path, exploded and equi-joined with the roots (no LIKE join).
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    cand = paths.select("*", F.explode(prefixes).alias("_anc"))
    # known roots are few next to the paths: broadcast (checked) so a root shared by many paths is not skewed
    r = broadcast_if_small(roots.select(F.col(root).alias("_anc")).distinct(), 1_000_000)
    hit = cand.join(r, "_anc").groupBy(*paths.columns).agg(F.max_by("_anc", F.length("_anc")).alias("_root"))
    return paths.join(hit, paths.columns, "left").select(
        *paths.columns, F.coalesce("_root", F.col(path)).alias("workspace_root"))
