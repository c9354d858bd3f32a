"""Sources and sinks: fixed-schema readers, the load generator, batch appends and result serialisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.functions.columns import assign_ulid_col
from hybridctx.operators.store import known_memories, orphan_memories, validate_memories
from hybridctx.schemas import COMMIT_SCHEMA, MEMORY_SCHEMA, conform


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Scan a memories table with the fixed schema (no inference); workspace filters prune partitions."""
    return spark.read.schema(MEMORY_SCHEMA).parquet(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT_SCHEMA).parquet(path)


def generate_memories(spark: SparkSession, n: int, workspace_id: str = "ws0", now_ms: int = K.FIXTURE_NOW_MS,
                      num_partitions: int | None = None) -> DataFrame:
    """Deterministic load corpus of n rows (see generate_memories_for)."""
    r = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    return generate_memories_for(r, workspace_id, now_ms)


def generate_memories_for(ids: DataFrame, workspace_id: str = "ws0", now_ms: int = K.FIXTURE_NOW_MS,
                          id_col: str = "id", text_col: str | None = None, workspace_col: str | None = None) -> DataFrame:
    """One generated row per id i: type cycles decision, gotcha, todo, note; importance (i % 10) / 10;
    content '{verb} {noun} {object}. Memory #{i}.'; row i is i seconds old. With text_col and workspace_col a table's own texts
    follow the generated sentence and its own column names the workspace."""
    i = F.col(id_col)

    def pick(words):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))

    return ids.select(
        i.alias("memory_id"), (F.col(workspace_col) if workspace_col else F.lit(workspace_id)).alias("workspace_id"),
        pick(K.GEN_TYPES).alias("type"),
        F.concat(pick(K.GEN_VERBS), F.lit(" "), pick(K.GEN_NOUNS), F.lit(" "), pick(K.GEN_OBJECTS),
                 F.lit(". Memory #"), i.cast("string"), F.lit("."),
                 *([F.coalesce(F.concat(F.lit("\n"), F.col(text_col)), F.lit(""))] if text_col else [])).alias("content"),
        F.lit(None).cast("string").alias("tags"),
        ((i % 10).cast("double") / F.lit(10.0)).alias("importance"),
        (F.lit(now_ms) - i * 1000).alias("created_at"),
        F.lit(None).cast("long").alias("archived_at"),
    )


def remember_batch(df: DataFrame, workspaces: DataFrame, now_ms: int, embedder=None,
                   key_cols: list[str] | None = None, ws_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Validate, refuse unknown workspaces, fill defaults, assign id and created_at, embed.

    Returns (accepted rows: memories columns plus the input's extra columns; conform to MEMORY_SCHEMA
    before appending) and rejected rows with reject_reason.
    Defaults: type 'note', importance 0.5, tags null. Ids are ULIDs whose 80 random bits come from a hash
    of the row key (key_cols, by default the row's own values) and its number among equal keys, so a retried task
    produces the same ids and equal rows still differ. memory_id is that ULID unless the input brings its own key.
    """
    x = df
    if "type" not in x.columns:
        x = x.withColumn("type", F.lit(K.DEFAULT_TYPE))
    if "importance" not in x.columns:
        x = x.withColumn("importance", F.lit(K.DEFAULT_IMPORTANCE))
    if "tags" not in x.columns:
        x = x.withColumn("tags", F.lit(None).cast("string"))
    x = x.withColumn("type", F.coalesce("type", F.lit(K.DEFAULT_TYPE))) \
        .withColumn("importance", F.coalesce(F.col("importance").cast("double"), F.lit(K.DEFAULT_IMPORTANCE)))
    v = validate_memories(x)
    orphans = orphan_memories(v.where(F.col("reject_reason").isNull()), workspaces, ws_key) \
        .withColumn("reject_reason", F.lit(K.UNKNOWN_WORKSPACE))
    rejected = v.where(F.col("reject_reason").isNotNull()).unionByName(orphans)
    ok = known_memories(v.where(F.col("reject_reason").isNull()), workspaces, ws_key).drop("reject_reason")
    keys = key_cols or [c for c in ("workspace_id", "content", "type", "tags", "importance") if c in ok.columns]
    # rows with equal keys are numbered, so every row gets an id of its own; the number takes part from the second on
    same = Window.partitionBy(*keys).orderBy(F.xxhash64(*ok.columns))
    ok = ok.withColumn("_nth", F.row_number().over(same))
    ts = F.lit(int(now_ms))
    ok = ok.withColumn("created_at", ts) \
        .withColumn("id", F.when(F.col("_nth") == 1, assign_ulid_col(ts, keys))
                    .otherwise(assign_ulid_col(ts, [*keys, F.col("_nth")]))) \
        .withColumn("archived_at", F.lit(None).cast("long")).drop("_nth")
    if "memory_id" not in ok.columns:
        ok = ok.withColumn("memory_id", F.col("id"))
    if embedder is not None:
        from hybridctx.operators.vectors import embed_corpus
        ok = ok.join(embed_corpus(ok, "id", "content", embedder), "id", "left")
    return ok, rejected


def append_memories(df: DataFrame, path: str) -> None:
    """Append to the memories table, one folder per workspace."""
    conform(df, MEMORY_SCHEMA).write.mode("append").partitionBy("workspace_id").parquet(path)
