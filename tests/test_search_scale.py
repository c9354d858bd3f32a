"""Lists made inside rows and slice by slice, blocks that know their rows, vectors spread before they are compared, ranges of few terms."""

import uuid

from pyspark.sql import functions as F

from hybridctx.functions import columns
from hybridctx.operators import fts, fts_bounded, vectors
from hybridctx.session import scratch_dir
from hybridctx.streaming import store

COLS = "memory_id long, workspace_id string, content string, tags string, created_at long, archived_at long"
ROWS = [(1, "a", "x y x, z X", "x, q", 1, None), (2, "a", None, "y", 1, None), (3, "b", "", None, 1, 5), (4, "b", "only-one", "", 1, None),
        (5, "b", "-- ,", "; t t", 1, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_made_inside_rows(spark):
    mem = spark.createDataFrame(ROWS, COLS)
    lists = fts.position_lists(fts.packed_tokens(mem))
    assert "Exchange" not in plan(lists)
    got = fts.list_postings(lists)
    assert sorted(got.collect()) == sorted(fts.build_postings(mem).select(*got.columns).collect())
    r = lists.where("memory_id = 1 AND term = 'x'").first()
    assert list(r.content_at) == [0, 2, 4] and list(r.tags_at) == [0] and r.dl == 7 and r.live


def test_blocks_of_rows_are_those_of_their_lists(spark):
    t = fts.with_blocks(fts.packed_tokens(spark.createDataFrame(ROWS, COLS)), len(ROWS))
    dealt = fts.row_blocks(t.repartition(3, "block"))
    assert plan(dealt).count("Exchange") == 1  # the rows; their terms are not shuffled
    cols = ["h", "workspace_id", "term", "block", "max_tf", "min_dl", "n_rows"]
    assert sorted(dealt.select(cols).collect()) == sorted(fts.term_blocks(fts.position_lists(t)).select(cols).collect())


def test_segments_answer_as_one_index(spark, monkeypatch):
    monkeypatch.setattr(store, "SEGMENT_BYTES", 200)
    path = scratch_dir(spark, f"store-{uuid.uuid4().hex[:10]}")
    mem = spark.range(60).select(F.col("id").alias("memory_id"), F.lit("w").alias("workspace_id"), F.expr(
        "concat('all w', id % 7, ' w', id % 5, ' w', id % 3)").alias("content"), F.lit("t").alias("tags"), F.lit(1).cast("long").alias("created_at"),
        F.lit(None).cast("long").alias("archived_at"))
    q = spark.createDataFrame([(1, "w", "w1 w2"), (2, "w", '"w1 w1"'), (3, "w", "all"), (4, "w", "w1 nowhere")],
                              "qid long, workspace_id string, query_text string")
    store.commit(spark, path, mem)
    assert spark.read.parquet(f"{path}/lists/epoch=0").select("_metadata.file_path").distinct().count() > 1
    cols = ["qid", "memory_id", "fts_rank", F.round("score", 9).alias("s")]
    want = sorted(fts.fts_topk(q, mem, 5).select(cols).collect())
    assert {r.qid for r in want} == {1, 2, 3}
    # versions that ended are taken off the blocks' numbers of rows
    for change in (lambda: None, lambda: store.commit(spark, path, mem.where("memory_id < 20"))):
        change()
        index = store.open_store(spark, path)
        assert sorted(fts.fts_topk(q, None, 5, index).select(cols).collect()) == want
        assert sorted(fts_bounded.fts_topk_bounded(q, index, 5)[0].select(cols).collect()) == want


def test_rows_with_vectors_are_spread(spark):
    mem = spark.range(100).coalesce(1).select(F.col("id").alias("memory_id"), F.lit("w").alias("workspace_id"), F.lit(None).cast("long").alias("archived_at"),
                                  F.array(F.col("id").cast("float")).alias("embedding"))
    q = spark.createDataFrame([(1, "w", [1.0])], "qid long, workspace_id string, query_vec array<float>")
    top = vectors.vector_topk(q, mem, 3)
    assert "hashpartitioning(memory_id" in plan(top) and [r.memory_id for r in top.orderBy("vec_rank").collect()] == [99, 98, 97]


def test_many_terms_are_not_tested_one_by_one(spark):
    lists = spark.createDataFrame([(1,)], "h long")
    terms = spark.range(1500).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("t"), "id").alias("term"))
    assert "Filter" not in plan(fts._only_terms(lists, terms))
    assert "Filter" in plan(fts._only_terms(lists, terms.limit(10)))


def test_bounded_search_joins_blocks_with_lists_of_query_terms(spark):
    """However many (query, block) pairs there are, their join meets the lists of the query's terms and no stored list."""
    path = scratch_dir(spark, f"t-{uuid.uuid4().hex[:8]}")
    store.commit(spark, path, spark.createDataFrame(ROWS, COLS))
    q = spark.createDataFrame([(1, "a", "x"), (2, "a", "z y"), (3, "b", "t")], "qid long, workspace_id string, query_text string")
    got, _ = fts_bounded.fts_topk_bounded(q, store.open_store(spark, path), 5)
    files = got.inputFiles()
    assert files and not [f for f in files if path in f]
    assert {r.term for r in spark.read.parquet(*files).where("term IS NOT NULL").collect()} <= set("xyzt")
    assert sorted((r.qid, r.memory_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 5)]


ODD = ["caf\u00e9 Caf\u00c9, x", "\u212a k \u0130 i\u0307", "\U00010400\U00010428 \ue000x -- \u00b2\u00bd", None, "", " - ", "a", "a b a\tb\nA", "\u00a0nb\u00a0sp "]


def test_packed_words_are_the_tokens(spark):
    mem = spark.createDataFrame([(i, "w", t, u, 1, None) for i, t in enumerate(ODD) for u in ("x, y", None, ODD[1])], COLS)
    cols = ["memory_id", "dl", "content", "tags"]
    want = fts.tokenized_memories(mem).select("memory_id", "dl", F.array_join("content_tokens", " ").alias("content"),
                                              F.array_join("tags_tokens", " ").alias("tags"))
    got = fts.packed_tokens(mem).select("memory_id", "dl", F.col("content_words").alias("content"), F.col("tags_words").alias("tags"))
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert sorted(map(tuple, mem.select("content", columns.fts_words("content").alias("w")).where("content = 'a'").collect()))[0] == ("a", "a")


def test_lists_and_blocks_of_slices(spark, monkeypatch):
    """Tasks that cut their rows into the smallest slices make the lists, counts and bounds of all rows."""
    monkeypatch.setattr(fts, "SLICE_CHARS", 1)
    mem = spark.createDataFrame([(f"m{i}{j}", ("a", "b", None)[j % 3], t, u, 1, 5 if i % 2 else None) for i, t in enumerate(ODD)
                                 for j, u in enumerate(("x, y", None, ODD[7], "a"))], COLS.replace("memory_id long", "memory_id string"))
    t = fts.with_blocks(fts.packed_tokens(mem), 40)
    lists = fts.position_lists(t)
    got = fts.list_postings(lists)
    wanted = fts.build_postings(mem).select(*got.columns).collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted))
    assert lists.where("tf <> size(content_at) + size(tags_at) OR tf IS NULL").count() == 0
    block = {r.memory_id: (r.block, r.dl) for r in t.collect()}
    tf = {}
    for r in wanted:
        tf[r.workspace_id, r.term, r.memory_id] = tf.get((r.workspace_id, r.term, r.memory_id), 0) + 1
    want = {}
    for (w, term, m), n in tf.items():
        b, dl = block[m]
        x = want.get((w, term, b), (0, dl, 0))
        want[w, term, b] = (max(x[0], n), min(x[1], dl), x[2] + 1)
    rows = fts.row_blocks(t.repartition(2, "block")).collect()
    merged = {}
    for r in rows:
        x = merged.get((r.workspace_id, r.term, r.block), (0, r.min_dl, 0))
        merged[r.workspace_id, r.term, r.block] = (max(x[0], r.max_tf), min(x[1], r.min_dl), x[2] + r.n_rows)
    assert merged == want and {r.h for r in rows} == {r.h for r in lists.select("h").collect()}


def test_single_terms_read_no_positions(spark):
    path = scratch_dir(spark, f"t-{uuid.uuid4().hex[:8]}")
    store.commit(spark, path, spark.createDataFrame(ROWS, COLS))
    q = spark.createDataFrame([(1, "a", "x"), (2, "a", "x-y")], "qid long, workspace_id string, query_text string")
    hits = fts.phrase_hits(fts.parse_fts_query(q), store.open_store(spark, path))
    leaves = hits._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [x.output().mkString(",") for x in map(leaves.apply, range(leaves.size())) if x.nodeName().startswith("Scan parquet")]
    scans = [x for x in scans if "dl#" in x]
    assert len(scans) == 2 and len([x for x in scans if "content_at" in x or "tags_at" in x]) == 1
    assert sorted((r.qid, r.memory_id, r.tf) for r in hits.collect()) == [(1, 1, 4), (2, 1, 1)]


def test_dot_products_of_pairs(spark):
    pairs = [(0, [1.5, 2.5], [0.1, 0.2]), (1, [1.0], [3.0, 4.0]), (2, [1.0, 2.0], [3.0]), (3, None, [1.0]), (4, [1.0], None), (5, [], [1.0]),
             (6, [], []), (7, [1.0, None], [1.0, 1.0]), (8, [1.0], [2.0, None]), (9, [float("nan")], [1.0]), (10, [float("inf")], [0.0]),
             (11, [0.1] * 64, [0.3 + i / 7 for i in range(64)]), (12, [1e30, 1e30], [1e30, -1e30])]
    df = spark.createDataFrame(pairs, "qid long, q array<float>, v array<float>")
    want = df.select("qid", columns.dot_similarity("q", "v").alias("sim")).where("sim IS NOT NULL").collect()
    got = vectors.pair_similarity(df, ["qid"], "q", "v")
    assert "MapInArrow" in plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 9


def test_best_vectors_either_way(spark, monkeypatch):
    """Broadcast queries, some pairs at a time, find what the salted join and a plain join find."""
    monkeypatch.setattr(vectors, "PAIRS", 7)
    mem = spark.range(90).select(F.col("id").alias("memory_id"), F.expr("elt(id % 4 + 1, 'a', 'a', 'b', null)").alias("workspace_id"),
                                 F.expr("if(id % 11 = 0, 1L, null)").alias("archived_at"), F.expr(
        "case when id % 9 = 0 then null when id % 7 = 0 then array(1f) when id % 13 = 0 then array(1f, null) "
        "when id = 41 then array(float('nan'), 0f) else array(float(id % 5), float(id % 3)) end").alias("embedding"))
    q = spark.createDataFrame([(1, "a", [1.0, 0.5]), (2, "b", [0.0, 1.0]), (3, "a", [2.0]), (4, "none", [1.0]), (5, None, [1.0]), (6, "a", None),
                               (7, "a", [-1.0, 0.1])], "qid long, workspace_id string, query_vec array<float>")
    plain = mem.where("archived_at IS NULL AND embedding IS NOT NULL").join(q, "workspace_id").select(
        "qid", "workspace_id", "memory_id", columns.dot_similarity("query_vec", "embedding").alias("sim")).where("sim IS NOT NULL")
    for k in (1, 5, 100):
        want = sorted(map(str, vectors.top_n_per(plain, ["qid"], [F.col("sim").desc(), F.col("memory_id").asc()], k, "vec_rank").collect()))
        for got in (vectors.vector_topk(q, mem, k, salt_buckets=2), vectors.vector_topk(q, mem, k, 0, salt_buckets=2)):
            assert "MapInArrow" in plan(got) and sorted(map(str, got.select("qid", "workspace_id", "memory_id", "sim", "vec_rank").collect())) == want
    assert vectors.vector_topk(q.where("false"), mem, 3).collect() == []
