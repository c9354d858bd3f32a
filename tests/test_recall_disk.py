"""What a commit and a recall leave on disk: whole rows are shuffled once, blocks keep no hash, candidates leave out other rows first."""

import uuid

from pyspark.sql import functions as F

from hybridctx.operators import fts, recall as rc
from hybridctx.session import scratch_dir
from hybridctx.streaming import store

COLS = "memory_id long, workspace_id string, content string, tags string, created_at long, archived_at long"


def rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("memory_id"), F.expr("concat('w', id % 3)").alias("workspace_id"),
        F.expr("concat('all t', id % 7, repeat(' x', cast(id % 40 as int)))").alias("content"), F.lit("a, b").alias("tags"),
        F.lit(1).cast("long").alias("created_at"), F.lit(None).cast("long").alias("archived_at"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_commit_shuffles_whole_rows_once(spark, monkeypatch):
    """New rows are written as they come, and their packed rows are dealt once, for lists and blocks."""
    monkeypatch.setattr(store, "SEGMENT_BYTES", 2000)
    plans, write = {}, store._write
    monkeypatch.setattr(store, "_write", lambda df, where, table, epoch: (plans.update({table: plan(df)}), write(df, where, table, epoch)))
    path = scratch_dir(spark, f"store-{uuid.uuid4().hex[:10]}")
    store.commit(spark, path, rows(spark, 400))
    assert not [t for t in ("memories", "lists", "blocks", "docs") if "Exchange" in plans[t]]
    lists = spark.read.parquet(f"{path}/lists/epoch=0").select("block", F.col("_metadata.file_name").alias("file")).distinct()
    assert lists.select("file").distinct().count() > 1  # segments
    assert lists.groupBy("block").count().where("count > 1").isEmpty()  # of whole blocks
    assert store.read_rows(spark, path).count() == 400


def test_the_newest_of_one_id_is_kept(spark):
    path = scratch_dir(spark, f"store-{uuid.uuid4().hex[:10]}")
    twice = [(1, "a", "old x", "", 1, None), (1, "b", "new y", "", 3, None), (1, "a", "older z", "", 0, None), (2, "a", "one", None, 1, None),
             (3, "a", "same", None, 1, None), (3, "a", "same", None, 1, None), (4, "a", "gone", None, 1, None), (4, "a", "gone too", None, 2, None)]
    store.commit(spark, path, spark.createDataFrame(twice, COLS), spark.createDataFrame([(4,)], "memory_id long"))
    want = [(1, "new y"), (2, "one"), (3, "same")]
    assert sorted((r.memory_id, r.content) for r in store.read_rows(spark, path).collect()) == want
    terms = store.current_lists(spark, path).select("memory_id", "term").collect()
    assert sorted(map(tuple, terms)) == [(1, "new"), (1, "y"), (2, "one"), (3, "same")]
    assert {r.workspace_id: r.n_docs for r in store.read_stats(spark, path).collect()} == {"a": 2, "b": 1}


def test_blocks_make_their_hash_when_read(spark):
    path = scratch_dir(spark, f"store-{uuid.uuid4().hex[:10]}")
    store.commit(spark, path, rows(spark, 60))
    assert "h" not in spark.read.parquet(f"{path}/blocks/epoch=0").columns
    cols = ["h", "workspace_id", "term", "block", "max_tf", "min_dl", "n_rows"]
    for _ in range(2):
        got = store.open_store(spark, path).blocks.select(cols).collect()
        assert sorted(got) == sorted(fts.term_blocks(store.current_lists(spark, path)).select(cols).collect()) and got
        store.compact(spark, path)


def test_candidates_leave_out_other_rows_first(spark):
    """The fused ids reach the table that holds the texts, below the joins of the memories' own plan; results stay those of the plain join,
    also for repeated ids, null keys and other workspaces."""
    texts = spark.createDataFrame([(1, "a", "t1"), (2, "a", "t2"), (2, "a", "t2 again"), (3, "b", "t3"), (4, None, "t4"), (None, "a", "t5"), (6, "a", "t6")],
                                  "doc long, ws string, text string")
    more = spark.createDataFrame([(i, i * 10, None if i != 6 else 1) for i in range(1, 8)], "id long, at long, gone long")
    mem = texts.join(more, more.id == texts.doc * 1).select(
        F.col("doc").alias("memory_id"), F.col("ws").alias("workspace_id"), F.when(F.col("doc") % 2 == 0, "todo").otherwise("note").alias("type"),
        F.col("text").alias("content"), F.lit("").alias("tags"), (F.col("doc") / 10).alias("importance"), F.col("at").alias("created_at"),
        F.col("gone").alias("archived_at"))
    mem = mem.join(spark.createDataFrame([(2, [1.0]), (2, [2.0])], "memory_id long, embedding array<double>"), "memory_id", "left")
    fused = spark.createDataFrame([(1, "a", 1, 0.5), (2, "a", 1, 0.4), (1, "a", 2, 0.3), (1, "a", 3, 0.2), (3, None, 4, 0.1), (2, "a", None, 0.1),
                                   (2, "a", 6, 0.6)], "qid long, workspace_id string, memory_id long, rrf double")
    q = spark.createDataFrame([(1, None), (2, ["note"]), (3, [])], "qid long, types array<string>")
    got = rc.fetch_candidates(fused, mem, q)
    want = [(1, 1, "t1"), (2, 1, "t1")] + [(1, 2, t) for t in ("t2", "t2", "t2 again", "t2 again")]
    for r in (got, rc.fetch_candidates(fused, mem, q, broadcast_fused=False)):
        assert sorted((x.qid, x.memory_id, x.content) for x in r.collect()) == sorted(want)
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {k: [len(x) - len(x.lstrip(" :+-")) for x in lines if k in x] for k in ("LeftSemi", "Join Inner, (id", "LogicalRDD [doc#")}
    assert depth["LeftSemi"] and max(depth["Join Inner, (id"]) < depth["LeftSemi"][0] < depth["LogicalRDD [doc#"][0], lines
