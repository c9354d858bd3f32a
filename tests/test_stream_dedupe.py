"""remember_stream with an event-time watermark drops replayed rows and equals the batch operator."""

import uuid

from pyspark.sql import functions as F

from conftest import SMALL

from hybridctx import constants as K
from hybridctx.plans import fixtures as fx
from hybridctx.session import scratch_dir
from hybridctx.sources import io
from hybridctx.streaming import streams as ss


def _candidates(events):
    return events.select(
        F.col("event_id"), F.col("ts"),
        F.concat(F.lit("src"), (F.col("user_id") % 23).cast("string")).alias("workspace_id"),
        F.lit("note").alias("type"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.lit(0.5).alias("importance"))


def test_remember_stream_drops_replayed_rows(spark):
    base = scratch_dir(spark, f"streams/test-dedupe-{uuid.uuid4().hex[:8]}")
    src = _candidates(ss.stream_table(spark, SMALL, "events"))
    doubled = src.unionByName(src)  # every row arrives twice
    known = fx.fx_known_workspaces(spark, SMALL)
    q = ss.remember_stream(doubled, known, f"{base}/sink", f"{base}/quarantine", f"{base}/_ckpt",
                           lambda epoch: K.FIXTURE_NOW_MS, ["event_id"], event_time="ts", watermark="1 day")
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/sink").select("event_id", "id")
    ok, _ = io.remember_batch(_candidates(fx.table(spark, SMALL, "events")), known, K.FIXTURE_NOW_MS,
                              key_cols=["event_id"])
    want = ok.select("event_id", "id")
    assert got.count() == got.select("event_id").distinct().count()
    assert sorted(got.collect()) == sorted(want.collect())
