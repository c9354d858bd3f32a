"""Catalog entries: the streaming jobs run to completion (availableNow) over the driver tables.

Each entry writes under the session's checkpoint folder (a fresh sub-folder per run) and returns the
final table; pytest checks that it equals the batch operator's result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.operators import fts
from hybridctx.plans import fixtures as fx
from hybridctx.plans.catalog_store import ACCEPTED_SQL, LOG_SQL
from hybridctx.plans.oracle_fixtures import with_fixtures
from hybridctx.plans.registry import register
from hybridctx.plans.sqlparts import ctes
from hybridctx.session import scratch_dir
from hybridctx.streaming import store, streams as ss


def _run_dir(spark, name):
    return scratch_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def _arrivals(spark, sf_dir, name, parts, start):
    """Feed the table to a stream in one micro-batch per condition: the rows of a condition are written beside those of the
    ones before, then start(stream) takes up what is new, from its own checkpoint, and runs to its end."""
    path = _run_dir(spark, f"arrivals-{name}")
    df = fx.table(spark, sf_dir, name)
    for cond in parts:
        df.where(cond).write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


@register("remember_stream", with_fixtures(ACCEPTED_SQL, "fx_candidates", "fx_known_workspaces"))
def q_remember_stream(spark, sf_dir):
    """Accepted rows as the store shows them after three micro-batches, joined with the sink's input columns."""
    base = _run_dir(spark, "remember")
    known = fx.fx_known_workspaces(spark, sf_dir)
    _arrivals(spark, sf_dir, "conversations", ["turn < 2", "turn = 2", "turn > 2"], lambda src: ss.remember_stream(
        fx.candidates_from(src), known, f"{base}/sink", f"{base}/quarantine", f"{base}/_checkpoint",
        lambda epoch: K.FIXTURE_NOW_MS, ["conv_id", "turn"], memories=f"{base}/memories"))
    rows = store.read_rows(spark, f"{base}/memories").select(F.col("memory_id").alias("id"), "workspace_id", "created_at")
    return spark.read.parquet(f"{base}/sink").select("conv_id", "turn", "id").join(rows, "id") \
        .select("conv_id", "turn", "workspace_id", "id", "created_at")


@register("hydration_log_stream", with_fixtures(LOG_SQL, "fx_hydration_events"))
def q_hydration_log_stream(spark, sf_dir):
    """Later turns replace the rows that earlier micro-batches merged."""
    base = _run_dir(spark, "hydration-log")
    _arrivals(spark, sf_dir, "conversations", ["turn = 0", "turn in (1, 2)", "turn > 2"], lambda src: ss.hydration_log_stream(
        fx.hydration_events_from(src), f"{base}/log", f"{base}/_checkpoint"))
    return spark.read.parquet(f"{base}/log").select("workspace_id", "session_id", "hydrated_at", "context_hash")


@register("index_refresh_stream", with_fixtures(
    "SELECT workspace_id, memory_id, col, pos, term FROM postings WHERE memory_id % 11 <> 3", "fx_memories",
    extra={"mem": "SELECT * FROM fx_memories", **ctes(["toks", "postings"])}))
def q_index_refresh_stream(spark, sf_dir):
    """Rows arrive in three micro-batches, the last repeating rows of the first; then some are deleted. The postings of the
    stored position lists."""
    base = _run_dir(spark, "postings")
    events = fx.table(spark, sf_dir, "events")
    _arrivals(spark, sf_dir, "documents", ["doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2 OR doc_id % 9 = 0"],
              lambda src: ss.index_refresh_stream(fx.memories_from(src, events), f"{base}/store", f"{base}/_checkpoint"))
    store.commit(spark, f"{base}/store", deleted=fx.fx_memories(spark, sf_dir).where("memory_id % 11 = 3"))
    p = fts.list_postings(store.current_lists(spark, f"{base}/store"))
    return p.select("workspace_id", "memory_id", F.col("col").cast("int").alias("col"),
                    F.col("pos").cast("long").alias("pos"), "term")
