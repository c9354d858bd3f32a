"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances: with M the largest norm, every vector x gets one more component
sqrt(M^2 - |x|^2) and a query q gets 0 there, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The largest products are the smallest
distances, and the triangle inequality |d(q', p) - d(x', p)| <= d(q', x') bounds them.

Index: vectors are keyed by their nearest pivot and their distance to it, and each pivot's vectors are cut into
`rings` annuli of about equal counts (from a histogram of distances). The table of annuli has at most pivots x rings
rows at any size of input; that is what the tasks get by broadcast. Pivots are fitted on a bounded sample
(`sample` vectors with the smallest md5 draws); every vector is indexed.

Search: a query's first bound is its k-th best product among the sample. Its annuli are expanded in the order of
their lower bounds: first the nearest `first_rings`, whose results tighten the bound, then all whose lower bound is
not beyond it. An annulus that is left out can't hold a result, so the results are exact.

Work is dealt by (annulus, vector block, query block): blocks hold a bounded number of rows, and one task multiplies one
block of queries with one block of vectors. Of equal vectors only the k + 1 with the smallest ids can be results, so a
vector that a third of all rows repeat costs k + 1 rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids;
shorter vectors count as padded by zeros; an empty vector is the zero vector; rows that repeat an id count once, with
the smallest of their vectors; fewer than k others give fewer rows; no queries or an empty table give no rows; extra
columns are never read. Scores are exact while their absolute values stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridctx.llm.common import stored, unit_draw

BLOCK_ROWS = 4096
HISTOGRAM = 1024


def quantised(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of every component as double; null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double"))
    return F.when(vector.isNotNull() & ~bad, q)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a float64 matrix, padded by zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lens), dim))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _whole(t: pa.Table, name: str) -> pa.Array:
    """A column of a small table as one array."""
    return pa.concat_arrays(t.column(name).chunks)


def distances(a: np.ndarray, a_extra: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of augmented rows (a, a_extra) to augmented pivots p."""
    sq = (a * a).sum(1) + a_extra * a_extra
    cross = a @ p[:, :-1].T + a_extra[:, None] * p[:, -1]
    return np.sqrt(np.maximum(sq[:, None] + (p * p).sum(1) - 2 * cross, 0.0))


def fit_pivots(sample: np.ndarray, extra: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of Lloyd's method on the augmented sample, started at evenly spaced sample rows."""
    x = np.hstack([sample, extra[:, None]])
    p = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = distances(sample, extra, p).argmin(1)
        for c in range(len(p)):
            if (own == c).any():
                p[c] = x[own == c].mean(0)
    return p


def top_positions(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest entries per row, ties to the smaller position; -inf entries come last."""
    n = score.shape[1]
    finite = np.abs(np.where(np.isfinite(score), score, 0)).max(initial=0)
    if finite * n >= 2 ** 52:
        return np.argsort(-score, axis=1, kind="stable")[:, :k]
    key = score * n - np.arange(n)  # distinct integers that order by score, then position
    if n > k:
        part = np.argpartition(-key, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(n), score.shape).copy()
    order = np.argsort(-np.take_along_axis(key, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class Index:
    """Fitted index: vectors with (pivot, ring, block), annuli bounds, and what queries need."""

    def __init__(self, vectors, annuli, pivots, sample, max_sq, dim):
        self.vectors, self.annuli, self.pivots, self.sample = vectors, annuli, pivots, sample
        self.max_sq, self.dim = max_sq, dim


def build_index(rows: DataFrame, k: int, pivots: int = 32, rings: int = 16, sample: int = 4096) -> Index | None:
    """rows: (id long, v array<double>), one per id. None when there are no rows."""
    spark = rows.sparkSession
    norms = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"),
                     F.max(F.size("v")).alias("d")).first()
    if norms["m"] is None:
        return None
    max_sq, dim = float(norms["m"]), max(1, int(norms["d"]))
    # of equal vectors, those beyond the k + 1 smallest ids are never among the k best of any query
    same = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    # the bounded sample: pivots and first bounds
    got = rows.orderBy(unit_draw(F.col("id").cast("string"), "pivot:"), "id").limit(sample).toArrow()
    s_ids, s_vec = got.column("id").to_numpy(), matrix(_whole(got, "v"), dim)
    p = fit_pivots(s_vec, _extra(s_vec, max_sq), pivots)

    def assign(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            d = distances(x, _extra(x, max_sq), p)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own])],
                names=["id", "v", "pivot", "dist"])

    keyed = stored(some.mapInArrow(assign, "id long, v array<double>, pivot int, dist double"), "pivot-keys")
    # annuli of about equal counts from a histogram of each pivot's distances
    top = keyed.groupBy("pivot").agg(F.max("dist").alias("far"))
    bin_of = F.least(F.floor(F.col("dist") / F.greatest("far", F.lit(1e-300)) * HISTOGRAM), F.lit(HISTOGRAM - 1))
    binned = keyed.join(F.broadcast(top), "pivot").withColumn("bin", bin_of.cast("int"))
    by_bin = binned.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"),
                                                F.max("dist").alias("hi"))
    upto = Window.partitionBy("pivot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("pivot")
    by_bin = stored(by_bin.withColumn("ring", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0))
                                                      * rings / F.sum("n").over(all_of)).cast("int")), "pivot-bins")
    annuli = stored(by_bin.groupBy("pivot", "ring").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.ceil(F.sum("n") / BLOCK_ROWS).cast("int").alias("blocks")), "pivot-annuli")
    # both small tables have at most pivots x bins and pivots x rings rows
    vectors = binned.join(F.broadcast(by_bin.select("pivot", "bin", "ring")), ["pivot", "bin"]) \
        .join(F.broadcast(annuli.select("pivot", "ring", "blocks")), ["pivot", "ring"]) \
        .select("id", "v", "pivot", "ring", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return Index(stored(vectors, "pivot-vectors"), annuli, p, (s_ids, s_vec), max_sq, dim)


def _extra(x: np.ndarray, max_sq: float) -> np.ndarray:
    return np.sqrt(np.maximum(max_sq - (x * x).sum(1), 0.0))


def _visits(index: Index, queries: DataFrame, skip: int, most: int | None) -> DataFrame:
    """(pivot, ring, block, qblock, id, v, bound): what every query looks at, of its annuli in the order of their
    lower bounds: those from number `skip` to before `most` (None: all) that its bound does not exclude."""
    a = index.annuli.select("pivot", "ring", "lo", "hi", "blocks").toPandas()  # at most pivots x rings rows
    pivot, lo, hi = a["pivot"].to_numpy(), a["lo"].to_numpy(), a["hi"].to_numpy()
    p, max_sq, dim = index.pivots, index.max_sq, index.dim
    ring, blocks = a["ring"].to_numpy(), a["blocks"].to_numpy()
    nth = np.arange(len(a))
    inside = (nth >= skip) & (nth < (len(a) if most is None else most))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = matrix(part.column("v"), dim)
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                d = distances(x, np.zeros(len(x)), p)[:, pivot]
                low = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                # k-th product so far as a distance, with room for rounding
                far = np.sqrt(np.maximum((x * x).sum(1) + max_sq - 2 * bound, 0.0)) * (1 + 1e-9) + 1e-6
                order = np.argsort(low, axis=1, kind="stable")
                take = inside & (np.take_along_axis(low, order, 1) <= far[:, None])
                q = np.repeat(np.arange(len(x)), take.sum(1))
                cell = order[take]
                reps = blocks[cell]
                q, cell2 = np.repeat(q, reps), np.repeat(cell, reps)
                block = np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
                for c in range(0, len(q), 8192):
                    s = slice(c, c + 8192)
                    rows = pa.array(q[s])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pivot[cell2[s]].astype(np.int32)), pa.array(ring[cell2[s]].astype(np.int32)),
                         pa.array(block[s].astype(np.int32)), part.column("qblock").take(rows),
                         part.column("id").take(rows), part.column("v").take(rows), part.column("bound").take(rows)],
                        names=["pivot", "ring", "block", "qblock", "id", "v", "bound"])

    return queries.mapInArrow(run, "pivot int, ring int, block int, qblock int, id long, v array<double>, bound double")


def _compare(index: Index, visits: DataFrame, k: int, n_query_blocks: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every visited block that reach the query's bound."""
    dim = index.dim
    vectors = index.vectors.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    keys = ["pivot", "ring", "block", "qblock"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        left = left.sort_by("id")
        ids, v = left.column("id").to_numpy(), matrix(_whole(left, "v"), dim)
        out = [none]
        for at in range(0, right.num_rows, 1024):
            part = right.slice(at, 1024)
            q_ids = part.column("id").to_numpy()
            score = matrix(_whole(part, "v"), dim) @ v.T
            own = np.searchsorted(ids, q_ids)
            mine = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids))
            score[mine, own[mine]] = -np.inf
            top = top_positions(score, k)
            best = np.take_along_axis(score, top, 1)
            keep = np.isfinite(best) & (best >= part.column("bound").to_numpy()[:, None])
            row = np.nonzero(keep)[0]
            out.append(pa.table({"query_id": q_ids[row], "vec_id": ids[top[keep]],
                                 "score": best[keep].astype(np.int64)}))
        return pa.concat_tables(out)

    return vectors.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(
        run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
         factor: float = 64.0, first_rings: int = 4, **index_options) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which is_query holds, against all others."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), factor).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("v").isNotNull())
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")), "pivot-rows")
    index = build_index(rows.select("id", "v"), k, **index_options)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if index is None:
        return empty
    queries = rows.where("is_query").select("id", "v")
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    s_ids, s_vec = index.sample
    dim = index.dim

    def first_bound(batches):
        for b in batches:
            q_ids = b.column(0).to_numpy()
            score = matrix(b.column(1), dim) @ s_vec.T
            score[q_ids[:, None] == s_ids[None, :]] = -np.inf
            kth = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q_ids), -np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kth)], names=["id", "v", "bound"])

    queries = queries.withColumn("qblock", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(n_blocks)).cast("int"))
    q = stored(queries.select("id", "v", "qblock").mapInArrow(
        lambda it: _with_qblock(it, first_bound), "id long, v array<double>, qblock int, bound double"), "pivot-queries")
    # round 1: the nearest annuli
    one = stored(_best(_compare(index, _visits(index, q, 0, first_rings), k, n_blocks), k), "pivot-near")
    # round 2: whatever the tightened bound leaves of the others
    kth = one.where(F.col("rank") == k).select(F.col("query_id").alias("k_id"), F.col("score").cast("double").alias("kth"))
    q = q.join(kth, F.col("id") == F.col("k_id"), "left").select(
        "id", "v", "qblock", F.greatest("bound", F.coalesce("kth", F.lit(float("-inf")))).alias("bound"))
    two = _compare(index, _visits(index, q, first_rings, None), k, n_blocks)
    found = one.select("query_id", "vec_id", "score").unionByName(two)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_qblock(batches, bound):
    for b in batches:
        for x in bound(iter([pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "v"])])):
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), b.column(2), x.column(2)],
                                             names=["id", "v", "qblock", "bound"])
