import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hybridctx.llm import exact_dedup, mixing, near_dup, quality, vector_search
from hybridctx.llm.common import table
from tables import shingles

SMALL = "/root/testdata/sf0.001"


def brute_topk(rows, k):
    vec = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        vec[i] = min(vec.get(i, q), q)
    out = []
    for q in sorted(vec):
        if q % 20:
            continue
        s = sorted(((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, id string, dist double")


def vector_rows(n=400, seed=2):
    r = random.Random(seed)
    f32 = lambda x: float(int(x * 4096) / 4096)  # noqa: E731  exact in float32
    rows = [(i, [f32(r.gauss(0, 0.3)) for _ in range(8)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)]                     # one vector a quarter of all rows hold
    rows += [(2000, None), (2001, []), (2002, [0.5, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8),
             (2020, [0.25] * 3), (40, rows[40][1]), (60, [0.1] * 8), (None, [0.5] * 8), (2040, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "rings": 2, "first_rings": 1}, {"sample": 30}])
def test_topk_against_brute_force(spark, options):
    rows = vector_rows()
    got = vector_search.topk(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20, **options).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 20)


def test_topk_few_rows_and_empty(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    got = vector_search.topk(vectors(spark, few), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute_topk(few, 20)
    assert vector_search.topk(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert vector_search.topk(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 16)
    rows = vector_rows()
    got = vector_search.topk(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 20)


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append({r.doc_id: r.text for r in rows})
        if name == "quality_classifier":
            want = quality.rank_documents(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
            assert set(seen[-1]) == {r.doc_id for r in want.where("predicted = 1").collect()}
        if name == "exact_dedup":
            top = {}
            for i, t in seen[-2].items():
                top[t] = max(top.get(t, i), i)
            assert set(seen[-1]) == set(top.values())
        if name == "near_dedup":
            before = sorted(seen[-2])
            sets = {i: shingles(seen[-2][i]) for i in before}
            linked = {b for k, a in enumerate(before) for b in before[k + 1:]
                      if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
            assert not set(seen[-1]) & linked or set(seen[-1]) == set(before) - linked
        if name == "source_mix":
            want = mixing.mix_sources(spark.createDataFrame([(i, t) for i, t in seen[-2].items()], "doc_id long, text string")
                                      .join(table(spark, SMALL, "documents").select("doc_id", "source"), "doc_id"))
            copies = {r.doc_id: r.copies for r in want.collect()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == {i: c for i, c in copies.items() if c}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p.doc_id for p in pieces} == set(seen[-1])
    assert len([p for p in pieces if p.start == 0]) == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


def test_stage_functions_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mix",
                                                      "packing"]
    assert near_dup.SHARE < 0.75 and exact_dedup.md5_128 is not None
