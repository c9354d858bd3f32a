"""Ranked lexical search of all documents for each item, with equal bags of words scored once.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With N documents
that have a term, L terms in all, n terms of one document, document frequencies df and counts tf:
w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and the score of a document is the sum of
w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms, in 64-bit integers.

Steps: every document is restricted to the items' vocabulary (hash of each term, then its bytes compared): its
vector is the list of (term, tf). N, L and df are summed over all documents. Documents with equal (vector, m) have equal
scores for every item; rows are grouped by a hash of both and by the vectors themselves, so a collision only shares a
partition. Each class is scored once, in blocks of classes x item terms; its members enter the ranking by ascending id. An item
ranks `k` rows, so at most the k smallest ids of a class can matter and only these are kept (group-limited
before the shuffle: a bag that a third of all documents share does not gather in one task).

Bounds: the vocabulary of the items is broadcast. Items are dealt into blocks by the bytes of their terms
(`block_bytes`), and blocks are searched one after the other, so the broadcast stays bounded for any number of items.
Every task hands on at most k rows per item.

Defined results: null and empty texts have no term; a document without a term of an item is no result; items without terms
give no rows; rows of one item_id are one item with all their terms; repeated documents are results of their own; a null
doc_id ranks behind all others of its score; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridctx.llm import words as W
from hybridctx.llm.common import stored

#: A term in every engine's regular expressions (texts are lower-cased in A-Z only).
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = np.ones(256, bool)
_IS_TERM[:128] = False
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _IS_TERM[_a:_b + 1] = True
#: Cells of one block of vectors (terms x classes) and of gathered contributions.
_CELLS = 1 << 21
_NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): distinct terms of every item."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(item_col).alias("item"),
                        F.explode(F.regexp_extract_all(lower, F.lit(f"({TERM_PATTERN})"), F.lit(1))).alias("term")) \
        .distinct()


def _blocks(terms: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items dealt into blocks whose terms have about block_bytes bytes. One row of sizes reaches the driver."""
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n = -(-size // block_bytes)
    if n <= 1:
        return [terms]
    part = F.pmod(F.xxhash64("item", F.col("item").isNull()), F.lit(n))
    return [terms.where(part == i) for i in range(n)]


class Vocabulary:
    """The distinct terms of a block of items, for look-ups of many terms at once."""

    def __init__(self, terms: list[str]):
        # one seed under which no two of these terms share a hash
        raw = [t.encode("utf-8") for t in terms]
        lens = np.array([len(t) for t in raw], np.int64)
        ends = np.cumsum(lens)
        data = np.frombuffer(b"".join(raw), np.uint8)
        for self.seed in range(100):
            h = W.hash_runs(data, ends - lens, ends, self.seed)
            if len(np.unique(h)) == len(h):
                break
        self.order = np.argsort(h)
        self.hashes, self.lens, self.starts = h[self.order], lens[self.order], (ends - lens)[self.order]
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each run of (lower-cased) bytes in the vocabulary, or -1. Equal hashes count only with equal bytes."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        h = W.hash_runs(data, starts, ends, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.lens[at] == ends - starts))
        at = at[hit]
        n = self.lens[at]
        first = np.cumsum(n) - n
        j = np.arange(int(n.sum())) - np.repeat(first, n)
        same = data[np.repeat(starts[hit], n) + j] == self.data[np.repeat(self.starts[at], n) + j]
        good = np.logical_and.reduceat(same, first) if len(first) else np.zeros(0, bool)
        out[hit[good]] = self.order[at[good]]
        return out


def restrict(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, vec): terms of the whole text and its (term number, tf) pairs, ascending, as little-endian 32-bit numbers."""
    def run(batches):
        voc = vocabulary.value
        for b in batches:
            for a, e, data, offs in W.slices(b.column(1)):
                data = W._LOWER[data]
                starts, ends, rows = W.runs(_IS_TERM[data], offs)
                term = voc.find(data, starts, ends)
                row = np.repeat(np.arange(e - a), np.diff(rows))
                known = term >= 0
                key, tf = np.unique((row[known] << 32) | term[known], return_counts=True)
                pairs = np.empty((len(key), 2), "<u4")
                pairs[:, 0], pairs[:, 1] = key & 0xFFFFFFFF, tf
                cut = (np.searchsorted(key >> 32, np.arange(e - a + 1)) * 8).astype(np.int32)
                vec = pa.Array.from_buffers(pa.binary(), e - a, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(np.diff(rows)), vec],
                                                 names=["doc_id", "n", "vec"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, n long, vec binary")


def _pairs(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((term, tf) of all rows, first pair of each row and the end) of a binary column."""
    offs = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset:vec.offset + len(vec) + 1]
    data = vec.buffers()[2]
    raw = np.frombuffer(data, "<u4", count=(offs[-1] - offs[0]) // 4, offset=int(offs[0])) if offs[-1] > offs[0] \
        else np.zeros(0, "<u4")
    return raw.reshape(-1, 2).astype(np.int64), (offs - offs[0]) // 8


def document_frequencies(vectors: DataFrame, n_terms: int) -> DataFrame:
    """(term, df): every task counts the documents of each term it meets, Spark adds the counts."""
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(_pairs(b.column(0))[0][:, 0], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return vectors.select("vec").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def bag_classes(vectors: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, vec, members): one row per distinct (vector, m), with the k smallest ids of its documents, ascending."""
    m = (F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {n_terms}L")).cast("long")
    rows = vectors.where(F.octet_length("vec") > 0).select("doc_id", "vec", m.alias("m"))
    rows = rows.withColumn("h", F.xxhash64("vec", "m"))
    one = Window.partitionBy("h", "m", "vec").orderBy(F.col("doc_id").asc_nulls_last())
    return rows.withColumn("place", F.row_number().over(one)).where(F.col("place") <= k) \
        .groupBy("h", "m", "vec").agg(F.array_sort(F.collect_list(F.coalesce("doc_id", F.lit(_NO_ID)))).alias("members")) \
        .select("m", "vec", "members")


class _Best:
    """The k best (score, doc_id) of every item met so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.zeros(n_items, np.int64)  # the k-th score, once there are k
        self.score = [np.zeros(0, np.int64)] * n_items
        self.ids = [np.zeros(0, np.int64)] * n_items

    def add(self, item: int, scores: np.ndarray, members: np.ndarray, first: np.ndarray) -> None:
        """Classes with their scores for one item; the ids of class c are members[first[c]:first[c + 1]]."""
        good = np.flatnonzero((scores > 0) & (scores >= self.floor[item]))
        if not len(good):
            return
        if len(good) > self.k:  # a class has a member, so k classes suffice (and those that tie with the k-th)
            least = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
            good = good[scores[good] >= least]
        n = first[good + 1] - first[good]
        at = np.repeat(first[good] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        score = np.concatenate([self.score[item], np.repeat(scores[good], n)])
        ids = np.concatenate([self.ids[item], members[at]])
        order = np.lexsort((ids, -score))[:self.k]
        self.score[item], self.ids[item] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[item] = score[order[-1]]


def _scored(classes: DataFrame, items, k: int) -> DataFrame:
    """(item_no, doc_id, score): the k best of every item in each task."""
    def run(batches):
        weights, terms, first_term = items.value
        best = _Best(len(first_term) - 1, k)
        step = max(1, _CELLS // max(len(weights), 1))
        for b in batches:
            pairs, first = _pairs(b.column(1))
            m = b.column(0).to_numpy()
            members = b.column(2)
            ids, at = members.flatten().to_numpy(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
            for a in range(0, len(m), step):
                e = min(a + step, len(m))
                part = pairs[first[a]:first[e]]
                cls = np.repeat(np.arange(e - a), np.diff(first[a:e + 1]))
                grid = np.zeros((len(weights), e - a), np.int64)  # a row per term: its part of each class's score
                grid[part[:, 0], cls] = weights[part[:, 0]] * (
                    (1_000_000_000 * part[:, 1]) // (1000 * part[:, 1] + 20 * m[a:e][cls]))
                for i in range(best.floor.size):
                    mine = terms[first_term[i]:first_term[i + 1]]
                    best.add(i, grid[mine].sum(axis=0), ids, at[a:e + 1])
        n = [len(x) for x in best.ids]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), pa.array(np.concatenate(best.ids)),
                 pa.array(np.concatenate(best.score))], names=["item_no", "doc_id", "score"])

    return classes.mapInArrow(run, "item_no int, doc_id long, score long")


def _search_block(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, rank, doc_id, score) for a block of items."""
    spark = docs.sparkSession
    got = terms.toArrow()  # bounded by block_bytes
    if not got.num_rows:
        return None
    item, term = got.column("item").to_pylist(), got.column("term").to_pylist()
    names = sorted(set(term))
    keys = sorted(set(item), key=lambda x: (x is not None, x))
    vectors = stored(restrict(docs, spark.sparkContext.broadcast(Vocabulary(names)), id_col, text_col), "lexical-vectors")
    n_docs, n_terms = vectors.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    if not n_terms:
        return None
    found = document_frequencies(vectors, len(names)).toArrow()  # one row per term of the block
    df = np.zeros(len(names), np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    number, place = {t: i for i, t in enumerate(names)}, {x: i for i, x in enumerate(keys)}
    edges = np.array(sorted((place[i], number[t]) for i, t in zip(item, term)))
    items = spark.sparkContext.broadcast((weights, edges[:, 1], np.searchsorted(edges[:, 0], np.arange(len(keys) + 1))))
    rows = _scored(bag_classes(vectors, n_docs, n_terms, k), items, k)
    last = Window.partitionBy("item_no").orderBy(F.col("score").desc(), "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    labels = spark.createDataFrame(list(enumerate(keys)), f"no int, item {terms.schema['item'].dataType.simpleString()}")
    return ranked.join(F.broadcast(labels), F.col("item_no") == F.col("no")).select(
        "item", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """item_col, rank, id_col, score: the k best documents of every item."""
    terms = stored(item_terms(items, item_col, item_text_col), "lexical-items")
    out = None
    for block in _blocks(terms, block_bytes):
        part = _search_block(docs, block, k, id_col, text_col)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], f"item {terms.schema['item'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


#: The same in DuckDB (k = 50).
SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, c GROUP BY term),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nn) // l) AS m FROM n, c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
