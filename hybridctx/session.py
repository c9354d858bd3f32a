"""Session helpers.

Library code never depends on session settings for its results (time conversions are done without
the session zone); the builder below is what tests, the bench and local runs use.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hybridctx") -> SparkSession:
    master = master or os.environ.get("HYBRIDCTX_MASTER", "local[*]")
    parts = shuffle_partitions or int(os.environ.get("HYBRIDCTX_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HYBRIDCTX_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; only when none is configured (local tests) make one."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (needed to cut lineage)")
    local = tempfile.mkdtemp(prefix="hybridctx-ckpt-")  # local mode only (tests, single machine)
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def reliable_checkpoint(df, eager: bool = True):
    """Materialise df in the shared checkpoint folder and cut its lineage (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_collected = 0.0


def collect_references(spark: SparkSession) -> None:
    """The shuffle files and checkpoints behind finished steps go when the driver collects its references to them; left alone
    that is after half an hour, and they pile up on the executors' disks. At most every few seconds."""
    global _collected
    if time.monotonic() - _collected > 3:
        for _ in range(2):  # the JVM hears a little later of the handles that Python gives up
            gc.collect()
            time.sleep(0.2)
            spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def written(df, name: str):
    """df as a Parquet table of its own below the shared checkpoint folder: columns packed, and readers take those they need."""
    path = scratch_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
