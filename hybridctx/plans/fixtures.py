"""Fixture views over the benchmark tables, giving them the shapes of the operators' inputs.

Every view is a plain DataFrame plan over the parquet tables, so its size grows with the tables.
The DuckDB texts of the same views live in ``hybridctx.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridctx.functions.columns import epoch_ms, epoch_seconds


#: Session setting: partitions that a run wants its text tables in (unset: as scanned).
TEXT_PARTITIONS = "spark.hybridctx.textPartitions"
# text-heavy tables and the key they are spread on
TEXT_TABLES = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"],
               "benchmark": ["item_id"]}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A driver table. Where the run sets TEXT_PARTITIONS in the session, text tables are hash-spread on their key
    into that many partitions (for small files of one row group, which one task would read)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(TEXT_PARTITIONS, None) if spread and name in TEXT_TABLES else None
    return df.repartition(int(n), *TEXT_TABLES[name]) if n else df


def fx_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "events"))


def memories_from(documents: DataFrame, events: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "source", "text")
    e = events.select("event_id", "ts", "event_type")
    j = d.join(e, e.event_id == d.doc_id * 5)
    ms = epoch_ms("ts")
    i = F.col("doc_id")
    return j.select(
        i.alias("memory_id"),
        F.col("source").alias("workspace_id"),
        F.when(i % 4 == 0, "decision").when(i % 4 == 1, "gotcha").when(i % 4 == 2, "todo")
        .otherwise("note").alias("type"),
        F.col("text").alias("content"),
        F.when(i % 7 == 0, F.lit(None).cast("string"))
        .when(i % 5 == 0, F.concat(F.col("event_type"), F.lit(", Active")))
        .otherwise(F.col("event_type")).alias("tags"),
        ((i % 10).cast("double") / F.lit(10.0)).alias("importance"),
        ms.alias("created_at"),
        F.when(i % 17 == 0, ms + F.lit(86400000)).otherwise(F.lit(None).cast("long")).alias("archived_at"),
    )


def fx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("memory_id"), "label", "embedding")


#: Words of a benchmark text that one short query holds.
QUERY_WORDS = 3
#: qid = item_id * QUERY_STEP + number of the query within its text (0: the whole text).
QUERY_STEP = 1_000_000


def fx_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as one query over all its words, and as consecutive queries of three words that cover it: plain,
    with a quoted phrase of two, with a repeated quoted word, with separators that hold no word."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = F.split("text", " ")

    def short(j):
        x, y, z = (F.coalesce(F.get(w, (j - 1) * QUERY_WORDS + k), F.lit("")) for k in range(QUERY_WORDS))
        return F.when(j == 0, F.col("text")) \
            .when(j % 4 == 1, F.concat(x, F.lit(" "), y, F.lit(" "), z)) \
            .when(j % 4 == 2, F.concat(F.lit('"'), x, F.lit("-"), y, F.lit('" '), z)) \
            .when(j % 4 == 3, F.concat(x, F.lit(' "'), y, F.lit('" '), z, F.lit(" "), x)) \
            .otherwise(F.concat(x, F.lit(", "), y, F.lit(" & "), z))

    last = F.ceil(F.size(w) / F.lit(QUERY_WORDS)).cast("int")
    q = b.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), short)).alias("j", "query_text"))
    i = F.col("item_id") + F.col("j")
    only_type = F.when(i % 5 == 0, F.lit("decision")).otherwise(F.lit(None).cast("string"))
    return q.join(v, v.vec_id == q.item_id).select(
        (F.col("item_id") * QUERY_STEP + F.col("j")).alias("qid"),
        "item_id",
        F.concat(F.lit("src"), (i % 20).cast("string")).alias("workspace_id"),
        "query_text",
        F.col("embedding").alias("query_vec"),
        F.lit(5).alias("k"),
        only_type.alias("only_type"),
        F.when(only_type.isNull(), F.lit(None).cast("array<string>"))
        .otherwise(F.array(only_type)).alias("types"),
    )


def fx_memories_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_memories with the fx_vectors embedding attached (left join: rows without a vector stay)."""
    from hybridctx.operators.vectors import attach_embeddings
    return attach_embeddings(fx_memories(spark, sf_dir), fx_vectors(spark, sf_dir))


def fx_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_from(table(spark, sf_dir, "conversations"))


def candidates_from(c: DataFrame) -> DataFrame:
    cid = F.col("conv_id")
    return c.select(
        cid, "turn",
        F.concat(F.lit("src"), (cid % 23).cast("string")).alias("workspace_id"),
        F.when(F.col("role") == "user", "note").when(F.col("role") == "assistant", "decision")
        .otherwise("SYSTEM").alias("type"),
        F.when(F.col("turn") == 5, F.lit("   ")).otherwise(F.col("text")).alias("content"),
        ((cid % 13).cast("double") / F.lit(10.0)).alias("importance"),
    )


def fx_known_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known workspace ids for the candidate fixture: the document sources."""
    return table(spark, sf_dir, "documents", spread=False).select(F.col("source").alias("id")).distinct()


def fx_workspaces_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 15)
    return n.select(
        F.concat(F.lit("ws"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("/repos/"), F.col("n_name")).alias("root_path"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("repo_url"),
        F.col("n_regionkey").cast("long").alias("created_at"),
    )


def fx_workspaces_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey") >= 10)
    return n.select(
        F.concat(F.lit("ws"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("/repos/"), F.col("n_name")).alias("root_path"),
        F.concat(F.col("n_name"), F.lit("_v2")).alias("name"),
        F.concat(F.lit("http://x/"), F.col("n_name")).alias("repo_url"),
        F.lit(99).cast("long").alias("created_at"),
    )


def fx_hydration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydration_events_from(table(spark, sf_dir, "conversations"))


def hydration_events_from(c: DataFrame) -> DataFrame:
    cid = F.col("conv_id")
    return c.select(
        F.concat(F.lit("src"), (cid % 20).cast("string")).alias("workspace_id"),
        cid.cast("string").alias("session_id"),
        F.col("turn").alias("seq"),
        (F.lit(1704067200).cast("long") + cid * 60 + F.col("turn")).alias("hydrated_at"),
        F.sha2(F.col("text"), 256).alias("context_hash"),
    )


def fx_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                              "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = o.join(c, c.c_custkey == o.o_custkey)
    return j.select(
        F.concat(F.lit("src"), F.col("c_nationkey").cast("string")).alias("workspace_id"),
        F.sha1(F.col("o_orderkey").cast("string")).alias("sha"),
        F.col("c_name").alias("author"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"), F.lit("\nbody")).alias("message"),
        epoch_seconds("o_orderdate").alias("committed_at"),
    )


def fx_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per nation, in src3 to src27: src0 to src2 hold memories and no repository."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("src"), (k + 3).cast("string")).alias("workspace_id"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.lower(F.col("n_name"))).alias("branch"),
        (k % 4).alias("uncommitted"),
    )


def fx_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return li.select(
        F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("workspace_id"),
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("path"),
        F.when(F.col("l_returnflag") == "R", "ignored").when(F.col("l_returnflag") == "A", "submodule")
        .otherwise("modified").alias("state"),
    )


def fx_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.split_part(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return p.select("page_id", path.alias("path"))


def fx_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known roots of all pages: the language folder of an url that has one, and every host."""
    p = table(spark, sf_dir, "pages").select("url")
    pattern = [r"^(https?://[^/]+/[a-z][a-z])/", r"^(https?://[^/]+)/"]
    return p.select(F.explode(F.array(*[F.regexp_extract("url", x, 1) for x in pattern])).alias("root")) \
        .where("root <> ''").distinct()


def fx_rootless_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below no known root."""
    n = table(spark, sf_dir, "nation")
    return n.select((-1 - F.col("n_nationkey")).cast("long").alias("page_id"),
                    F.concat(F.lit("/repos/"), F.col("n_name"), F.lit("/src")).alias("path"))


def fx_dim_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("memory_id"), F.col("label").alias("workspace_id"),
        F.when(F.col("vec_id") % 97 == 0, 32).otherwise(64).alias("dim"))


def fx_digest_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces that digests are built for: src0..src28.

    src20 to src27 hold a repository and no memories, src28 neither: they exercise the empty cases.
    """
    c = table(spark, sf_dir, "conversations", spread=False)  # key column only: no text work to spread
    ws = c.select(F.concat(F.lit("src"), (F.col("conv_id") % 29).cast("string")).alias("id")).distinct()
    return ws.select("id", F.col("id").alias("name"))
