"""Document quality by Bradley-Terry pairwise ranking on style features of whole texts.

Every document has a latent score w.x; a document labelled good is preferred to one labelled bad with probability
sigmoid(w.(x_good - x_bad)). w minimises that logistic loss over preference pairs (plus a small ridge). The threshold is
the quantile of the training scores, weighted to the label shares of all training labels, below which the share
of bad labels lies; the published score is sigmoid(latent - threshold), so 0.5 is the threshold.

Features depend on the text alone: byte frequencies (A-Z, punctuation, digits, white space, all bytes above
127 as one), word and line counts, word shape, repeated neighbours, share of distinct words and lines.

Fitting uses a bounded sample: `per_class` documents of each label (smallest md5 draws of the id) and `pairs`
preference pairs; scoring reads every whole text in vectorised slices.

Defined results: null text is empty and is scored like it; labels that are null are ignored, several labels of one
document count as the worst; without labels of both kinds the score is the smoothed share of good labels for
all; repeated rows each give a row; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridctx.llm import words as W
from hybridctx.llm.common import unit_draw

N_BYTES = 129
N_EXTRA = 11
N_FEATURES = N_BYTES + N_EXTRA
_FOLD = np.minimum(np.arange(256), 128).astype(np.int64)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _distinct(rows: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct values per row; rows is each value's row (below 2^20)."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n_rows)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Feature matrix of the rows of a slice."""
    n, lens = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, N_FEATURES))
    total = np.maximum(lens, 1)[:, None]
    row_of = np.repeat(np.arange(n), lens)
    counts = np.bincount(row_of * N_BYTES + _FOLD[data], minlength=n * N_BYTES).reshape(n, N_BYTES)
    out[:, :N_BYTES] = np.sqrt(counts / total)
    starts, ends, first, h = W.words(data, offs)
    n_words = np.diff(first)
    per = np.maximum(n_words, 1)
    word_row = np.repeat(np.arange(n), n_words)
    by_row = lambda flag: np.bincount(word_row, weights=flag, minlength=n) / per
    x = out[:, N_BYTES:]
    x[:, 0] = np.log1p(lens)
    x[:, 1] = np.log1p(n_words)
    if len(h):
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
        x[:, 2] = by_row(same)
        x[:, 3] = by_row(_SIGN[data[ends - 1]])
        x[:, 4] = by_row(_SIGN[data[starts]])
        x[:, 5] = by_row(_UPPER[data[starts]])
        x[:, 6] = by_row((ends - starts).astype(float)) / 10
        x[:, 7] = by_row(_UPPER[data[ends - 1]])
        x[:, 8] = _distinct(word_row, h, n) / per
    ls, le, lf = W.runs(data != 10, offs)
    n_lines = np.diff(lf)
    x[:, 9] = np.log1p(n_lines)
    if len(ls):
        x[:, 10] = _distinct(np.repeat(np.arange(n), n_lines), W.hash_runs(data, ls, le), n) / np.maximum(n_lines, 1)
    return out


@dataclass
class Ranker:
    """Fitted model; weights is None when there was nothing to prefer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    threshold: float
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(self.latent(x) - self.threshold, -500, 500)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, n_pairs: int, ridge: float = 1e-3, rounds: int = 300,
              rate: float = 0.1) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.(x_good - x_bad))) + ridge |w|^2 over pairs (Adam)."""
    rng = np.random.default_rng(7)
    diff = good[rng.integers(0, len(good), n_pairs)] - bad[rng.integers(0, len(bad), n_pairs)]
    w = np.zeros(diff.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -500, 500)))
        g = -(p @ diff) / len(diff) + 2 * ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def quantile_threshold(good: np.ndarray, bad: np.ndarray, bad_share: float) -> float:
    """The score with weight bad_share below it, when bad scores weigh bad_share in all and good ones the rest;
    half way between its neighbours."""
    s = np.concatenate([good, bad])
    w = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(w[order]), bad_share - 1e-12))
    return float((s[order][at] + s[order][min(at + 1, len(s) - 1)]) / 2)


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(label, x) of (label, text)."""
    def run(batches):
        for b in batches:
            for a, e, data, offs in W.slices(b.column(1)):
                x = features(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, e - a),
                     pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, pa.array(x.ravel()))],
                    names=["label", "x"])

    return docs.mapInArrow(run, "label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = 4000, pairs: int = 40_000) -> Ranker:
    """Fit on a bounded sample of the labelled documents for which may_train (on id_col) holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & may_train) \
        .select(F.col(id_col).alias("lid"), (F.col(label_col) == 1).cast("int").alias("label")) \
        .groupBy("lid").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    none = Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, 0.0, prior)
    if not n0 or not n1:
        return none
    draw = unit_draw(F.col("lid").cast("string"), "rank:")
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(draw, "lid").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 x per_class rows of (id, label), and one text of each: a repeated id counts once
    rows = docs.select(F.col(id_col).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(F.broadcast(sample), F.col("did") == F.col("lid")).groupBy("lid", "label") \
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("label", "one.text")
    got = _feature_rows(rows).toArrow()
    if not got.num_rows:
        return none
    y = got.column("label").to_numpy()
    x = pa.concat_arrays(got.column("x").chunks).flatten().to_numpy().reshape(len(y), N_FEATURES)
    if y.min() == y.max():
        return none
    # the order in which tasks deliver rows must not matter
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model = Ranker(mean, scale, None, 0.0, prior)
    z = (x - mean) / scale
    model.weights = fit_pairs(z[y == 1], z[y == 0], pairs)
    s = z @ model.weights
    model.threshold = quantile_threshold(s[y == 1], s[y == 0], n0 / (n0 + n1))
    return model


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score."""
    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for a, e, data, offs in W.slices(b.column(1)):
                out[a:e] = model.score(features(data, offs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[id_col, "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1 (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rank_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **fit_options) -> DataFrame:
    """id_col, held_out, score, predicted (1: score >= 0.5) of every row; labels of held-out ids are never read."""
    model = fit(docs, labels, ~is_held_out(id_col), id_col, text_col, **fit_options)
    return score(docs, model, id_col, text_col).select(
        id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              **fit_options) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject. Scores travel beside the rows, so there is no join."""
    model = fit(docs, labels, ~is_held_out(id_col), id_col, text_col, **fit_options)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for a, e, data, offs in W.slices(b.column(at)):
                good[a:e] = model.score(features(data, offs)) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
