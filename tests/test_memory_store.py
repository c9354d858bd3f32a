"""The store of rows, text index and statistics: equal to a rebuild after every change, one commit for all tables."""

import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from hybridctx import constants as K
from hybridctx.operators import fts, recall as rc
from hybridctx.operators.vectors import HashingEmbedder, embed_corpus
from hybridctx.session import scratch_dir
from hybridctx.streaming import store, streams as ss

COLS = "memory_id long, workspace_id string, content string, tags string, created_at long, archived_at long"
NOW = K.FIXTURE_NOW_MS


def rows(spark, seed, ids, ws=("a", "b", "hot", "hot")):
    r = random.Random(seed)
    return spark.createDataFrame(
        [(i, r.choice(ws), " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(12))) or None,
          r.choice([None, "x, y", "w1"]), 1000 + seed, r.choice([None, None, 5])) for i in ids], COLS)


def new_store(spark):
    return scratch_dir(spark, f"store-{uuid.uuid4().hex[:10]}")


def same_as_rebuild(spark, path, want):
    """Rows, postings, statistics and answers of the store are those of the plain table."""
    assert sorted(map(tuple, store.read_rows(spark, path).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    got = fts.list_postings(store.current_lists(spark, path))
    assert sorted(got.collect()) == sorted(fts.build_postings(want).select(*got.columns).collect())
    stats = ["workspace_id", "n_docs", "total_tokens", "avgdl"]
    assert sorted(store.read_stats(spark, path).select(stats).collect()) == sorted(fts.corpus_stats(want)[0].select(stats).collect())
    q = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(
        (w, t) for w in ("a", "b", "hot") for t in ("w1", "w2 w3", "w1-w2", '"w4" w4', "nowhere", "w5 & x"))],
        "qid long, workspace_id string, query_text string")
    cols = ["qid", "memory_id", "fts_rank", F.round("score", 9).alias("s")]
    a = fts.fts_topk(q, None, 5, store.open_store(spark, path)).select(cols).collect()
    assert sorted(a) == sorted(fts.fts_topk(q, want, 5).select(cols).collect())
    return a


def test_store_equals_rebuild_after_every_change(spark):
    path, base = new_store(spark), rows(spark, 0, range(120))
    store.commit(spark, path, base)
    assert same_as_rebuild(spark, path, base)
    # new rows, new versions (other texts, workspaces, archived or not) and deletions at once; an unknown id is no matter
    up, gone = rows(spark, 1, [*range(0, 40, 3), *range(200, 230)]), [1, 3, 50, 201, 999]
    store.commit(spark, path, up, spark.createDataFrame([(i,) for i in gone], "memory_id long"))
    now = base.join(up, "memory_id", "left_anti").unionByName(up).where(~F.col("memory_id").isin(gone))
    same_as_rebuild(spark, path, now)
    store.commit(spark, path, deleted=now.where("workspace_id = 'b'").select("memory_id"))
    now = now.where("workspace_id <> 'b'")
    same_as_rebuild(spark, path, now)
    store.compact(spark, path)
    same_as_rebuild(spark, path, now)
    back = rows(spark, 2, [1, 3, 500])  # deleted rows may come again
    store.commit(spark, path, back)
    store.vacuum(spark, path)
    same_as_rebuild(spark, path, now.unionByName(back))
    assert len(glob.glob(f"{path.removeprefix('file:')}/lists/epoch=*")) == 2


def test_a_changed_row_writes_its_own_postings(spark):
    path = new_store(spark)
    store.commit(spark, path, rows(spark, 0, range(300)))
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True)}
    before = files()
    store.commit(spark, path, rows(spark, 1, [7]))
    after = files()
    assert all(after[f] == t for f, t in before.items())
    written = spark.read.parquet(f"{path}/lists/epoch=1")
    assert {r.memory_id for r in written.collect()} <= {7} and spark.read.parquet(f"{path}/ended/epoch=1").count() == 1


def test_a_broken_commit_shows_nothing_and_is_repeated(spark, monkeypatch):
    path, base = new_store(spark), rows(spark, 0, range(60))
    store.commit(spark, path, base, batch="s-0")
    write = store._write
    for fails in ("lists", "docs", "ended", "stats"):
        def broken(df, where, table, epoch, fails=fails):
            if table == fails:
                raise OSError("lost")
            write(df, where, table, epoch)
        monkeypatch.setattr(store, "_write", broken)
        with pytest.raises(OSError):
            store.commit(spark, path, rows(spark, 3, range(30, 90)), batch="s-1")
        monkeypatch.setattr(store, "_write", write)
        assert sorted(store.read_rows(spark, path).select("memory_id").collect()) == sorted(base.select("memory_id").collect())
        assert sorted(store.read_stats(spark, path).collect()) == sorted(
            fts.corpus_stats(base)[0].select("workspace_id", "n_docs", "total_tokens", "avgdl").collect())
    change = rows(spark, 3, range(30, 90))
    for _ in range(3):  # a replayed batch is applied once
        assert store.commit(spark, path, change, batch="s-1") == 1
    same_as_rebuild(spark, path, base.join(change, "memory_id", "left_anti").unionByName(change))


def test_a_search_reads_few_pages(spark, monkeypatch):
    monkeypatch.setattr(store, "PAGE_ROWS", 100)
    path = new_store(spark)
    mem = spark.range(4000).select(
        F.col("id").alias("memory_id"), F.lit("w").alias("workspace_id"),
        F.concat(F.lit("common rare"), F.col("id"), F.lit(" t"), F.col("id") % 50).alias("content"),
        F.lit(None).cast("string").alias("tags"), F.lit(None).cast("long").alias("archived_at"))
    store.commit(spark, path, mem)
    index = store.open_store(spark, path)
    q = spark.createDataFrame([(1, "w", "rare17 rare18"), (2, "w", "rare3999")], "qid long, workspace_id string, query_text string")
    cut = fts._only_terms(index.lists, fts.parse_fts_query(q))
    assert cut.count() >= 3
    df = cut.select("memory_id", "h")
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "h" in text.split("PushedFilters")[1]

    def scan(node):
        if node.nodeName().startswith("Scan"):
            return node
        return next((s for s in map(scan, [node.children().apply(i) for i in range(node.children().size())]) if s), None)

    read = scan(df._jdf.queryExecution().executedPlan()).metrics().apply("numOutputRows").value()
    assert 3 <= read < 0.1 * index.lists.count()


def test_remembered_rows_are_found_by_the_next_recall(spark):
    path, e = new_store(spark), HashingEmbedder(16)
    spark.createDataFrame([("w", "webpack build optimization notes", 0.5), ("w", "prefer postgres", 0.9), ("z", "unknown place", 0.1)],
                          "workspace_id string, content string, importance double").write.parquet(f"{path}/in")
    src = spark.readStream.schema("workspace_id string, content string, importance double").parquet(f"{path}/in")
    known = spark.createDataFrame([("w",)], "id string")
    for _ in range(2):  # the second run finds nothing new
        ss.remember_stream(src, known, f"{path}/sink", f"{path}/no", f"{path}/ck", lambda n: NOW - 1000, ["workspace_id", "content"],
                           embedder=e, memories=f"{path}/memories").awaitTermination()
    mem = store.read_rows(spark, f"{path}/memories")
    assert mem.count() == 2 and spark.read.parquet(f"{path}/no").count() == 1
    q = spark.createDataFrame([(1, "w", "webpack build optimization", 5, None)],
                              "qid long, workspace_id string, query_text string, k int, types array<string>")
    q = q.join(embed_corpus(q, "qid", "query_text", e).withColumnRenamed("embedding", "query_vec"), "qid")
    found = rc.recall(q, mem, NOW, store.open_store(spark, f"{path}/memories")).collect()
    assert [r.content for r in sorted(found, key=lambda r: r["rank"])][0].startswith("webpack")
    # the index follows a deletion
    store.commit(spark, f"{path}/memories", deleted=mem.where("content like 'webpack%'"))
    left = rc.recall(q, store.read_rows(spark, f"{path}/memories"), NOW, store.open_store(spark, f"{path}/memories"))
    assert [r.content for r in left.collect()] == ["prefer postgres"]


def test_one_event_rewrites_one_slice_of_the_log(spark):
    path = new_store(spark)
    cols = "workspace_id string, session_id string, seq int, hydrated_at long, context_hash string"
    log = spark.createDataFrame([("hot", f"s{i}", 0, i, "a") for i in range(500)], cols)
    ss.merge_hydration_log(spark, f"{path}/log", log)
    files = lambda: set(glob.glob(f"{path.removeprefix('file:')}/log/*/*.parquet"))
    before = files()
    ss.merge_hydration_log(spark, f"{path}/log", spark.createDataFrame([("hot", "s9", 1, 999, "b")], cols))
    assert len({os.path.dirname(f) for f in files() ^ before}) == 1 and len(before) > 50
    got = {r.session_id: (r.hydrated_at, r.context_hash) for r in spark.read.parquet(f"{path}/log").collect()}
    assert len(got) == 500 and got["s9"] == (999, "b") and got["s8"] == (8, "a")


def test_phrases_against_brute_force(spark):
    r = random.Random(4)
    texts = [(i, "w", " ".join(r.choice("abc") for _ in range(r.randrange(14))), " ".join(r.choice("abc") for _ in range(r.randrange(4))), None)
             for i in range(60)]
    mem = spark.createDataFrame(texts, "memory_id long, workspace_id string, content string, tags string, archived_at long")
    phrases = ["a", "a-b", "a-a", "c-b-a", "a-b-a-b", "b-b-b"]
    q = spark.createDataFrame([(i, "w", p) for i, p in enumerate(phrases)], "qid long, workspace_id string, query_text string")
    want = set()
    for n, p in enumerate(phrases):
        p = p.split("-")
        for i, _, c, t, _ in texts:
            tf = sum(w.split()[j:j + len(p)] == p for w in (c, t) for j in range(len(w.split())))
            if tf:
                want.add((n, i, tf))
    for bound in (1000, 0):
        got = fts.phrase_hits(fts.parse_fts_query(q), fts.build_index(mem), bound).select("qid", "memory_id", "tf").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_pair_order_against_pairs(spark):
    r = random.Random(8)
    rows = [(q, i, float(r.randrange(6)), r.choice([None, r.random()])) for q in range(5) for i in range(1, 2 + 9 * q)]
    want = {}
    for q in range(5):
        for at, name in ((2, "a"), (3, "b")):
            mine = sorted(x for x in rows if x[0] == q and x[at] is not None)
            pairs = [(x[at], y[at]) for n, x in enumerate(mine) for y in mine[n + 1:]]
            want[q, name] = (sum(x > y for x, y in pairs), sum(x < y for x, y in pairs), sum(x == y for x, y in pairs))
    df = spark.createDataFrame(rows, "qid long, rank int, a double, b double")
    got = {(x.qid, x.value): (x.agree, x.disagree, x.equal) for x in rc.pair_order(df, ["a", "b"]).collect()}
    assert {k: v for k, v in want.items() if sum(v)} == {k: v for k, v in got.items() if sum(v)}
    assert rc.pair_order(df.where("false"), ["a"]).collect() == []


def test_bounded_search_equals_and_skips_blocks(spark):
    from hybridctx.operators import fts_bounded
    r = random.Random(3)
    texts = [("common " * (1 + i % 4 if i % 97 else 9) + " ".join(f"w{r.randrange(60)}" for _ in range(3 + i % 80))) for i in range(3000)]
    mem = spark.createDataFrame([(i, "hot" if i % 8 else "b", t, None if i % 5 else "common", 1, 7 if i % 11 == 0 else None)
                                 for i, t in enumerate(texts)], COLS)
    path = new_store(spark)
    store.commit(spark, path, mem.where("memory_id < 2600"))
    store.commit(spark, path, mem.where("memory_id >= 2500"), mem.where("memory_id % 50 = 0").select("memory_id"))
    now = mem.where("memory_id % 50 <> 0")
    q = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate((w, t) for w in ("hot", "b", "none") for t in (
        "common", "common w3", "w1 w2 w3", "common-common w5", "w7-w8", "nowhere common", "common common", "& -"))],
        "qid long, workspace_id string, query_text string")
    index = store.open_store(spark, path)
    got, report = fts_bounded.fts_topk_bounded(q, index, 5)
    cols = ["qid", "memory_id", "fts_rank", F.round("score", 9).alias("s")]
    assert sorted(got.select(cols).collect()) == sorted(fts.fts_topk(q, now, 5).select(cols).collect())
    blocks = {x.qid: (x.blocks, x.scored) for x in report.collect()}
    assert blocks[0][1] < blocks[0][0] / 2, blocks  # a frequent term: most blocks are skipped
