"""Structured Streaming wrappers: continuous remember, hydration-log merge and text-index refresh.

Every micro-batch is written so that a replay of the same epoch gives the same files: ids are derived
from row keys, batch output goes to an epoch folder overwritten on replay, a store (streaming.store) applies a
named batch once, and the log overwrites only the hash slices the batch touched (after a reliable
checkpoint cuts the read lineage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridctx.operators.store import log_hydration
from hybridctx.schemas import MEMORY_SCHEMA, conform
from hybridctx.session import reliable_checkpoint
from hybridctx.sources.io import remember_batch
from hybridctx.streaming import store


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remember_stream(source: DataFrame, workspaces: DataFrame, sink: str, quarantine: str, checkpoint: str,
                    now_ms_of_epoch, key_cols: list[str], event_time: str | None = None,
                    watermark: str = "1 hour", embedder=None, available_now: bool = True,
                    memories: str | None = None):
    """Continuous remember_batch: accepted rows to `sink`, rejected rows to `quarantine`, both with the input's columns, one
    folder per epoch. With `memories`, the accepted rows also come into that store (streaming.store): table, embeddings,
    text index and statistics appear together, by one commit per epoch, and the next recall finds them.

    Rows replayed by the source within the watermark are dropped by key; each epoch's output folder is
    overwritten on replay and the store applies an epoch once, so a retried micro-batch does not duplicate rows.
    """
    s = source
    if event_time is not None:
        # a watermark needs TIMESTAMP; a TIMESTAMP_NTZ event time is cast (a uniform zone shift does not
        # change which rows fall inside the watermark)
        wm = event_time
        if dict(s.dtypes)[event_time] == "timestamp_ntz":
            wm = "_event_ts"
            s = s.withColumn(wm, F.col(event_time).cast("timestamp"))
        s = s.withWatermark(wm, watermark).dropDuplicatesWithinWatermark(key_cols)
        if wm != event_time:
            s = s.drop(wm)

    def run(batch: DataFrame, epoch_id: int):
        batch.persist()  # both writes read it: without this the stateful de-duplication runs twice
        ok, rej = remember_batch(batch, workspaces, now_ms_of_epoch(epoch_id), embedder, key_cols)
        ok.write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")
        rej.write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch_id}")
        if memories is not None:
            rows = batch.sparkSession.read.parquet(f"{sink}/epoch={epoch_id}").drop("memory_id").withColumnRenamed("id", "memory_id")
            store.commit(batch.sparkSession, memories, conform(rows, MEMORY_SCHEMA), batch=f"remember-{epoch_id}")
        batch.unpersist()

    w = s.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


#: Folders of the hydration log, by hash of its key: an event rewrites one of them.
LOG_SLICES = 64


def merge_hydration_log(spark: SparkSession, target: str, batch: DataFrame, seq: str = "seq") -> None:
    """Merge a batch of hydration events into the log at `target`. The log lies in LOG_SLICES folders by hash of (workspace,
    session), so a hot workspace is spread over all of them and only folders that an event falls in are rewritten."""
    key = F.pmod(F.xxhash64("workspace_id", "session_id"), F.lit(LOG_SLICES)).cast("int")
    current = None
    if _exists(spark, target):
        touched = reliable_checkpoint(batch.select(key.alias("slice")).distinct())
        current = spark.read.parquet(target).join(F.broadcast(touched), "slice", "left_semi").drop("slice")
    merged = reliable_checkpoint(log_hydration(current, batch, seq).withColumn("slice", key))
    (merged.hint("rebalance", "slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("slice").parquet(target))


def hydration_log_stream(source: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Latest row per (workspace, session) kept in `target` as events arrive."""
    def run(batch: DataFrame, epoch_id: int):
        batch.persist()
        merge_hydration_log(batch.sparkSession, target, batch)
        batch.unpersist()

    w = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def index_refresh_stream(source: DataFrame, target: str, checkpoint: str, available_now: bool = True, name: str = "rows"):
    """Keep a store (streaming.store: rows, text index, statistics) in step with a stream of inserted and updated rows."""
    def run(batch: DataFrame, epoch_id: int):
        batch.persist()
        store.commit(batch.sparkSession, target, batch, batch=f"{name}-{epoch_id}")
        batch.unpersist()

    w = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table read as a file stream (the folder holds one parquet file per table)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)

