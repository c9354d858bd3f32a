"""Line deduplication by range-partitioned line hashes, streamed in sorted order; results are keep bitmaps.

1. Every line of at least min_chars key characters gives a row (128-bit key hash, document, position). Texts
   do not move.
2. The rows are range-partitioned on (hash, document) and sorted by (hash, document descending, position). A range may
   end inside a hash, so a line that a third of all documents hold is spread over many tasks.
3. Each task streams its runs of equal hashes: the first document of a run keeps its lines, those of later ones
   drop once min_docs documents were seen. Only the run that a task begins with and the one it ends with may go on in
   a neighbour; their undecided rows leave with a summary (documents, largest id) of at most two rows per task.
   The summaries are added up, and that table, bounded by twice the number of tasks, decides the rest by broadcast.
4. Dropped positions are gathered per document (bounded by its lines) into a zlib-compressed keep bitmap.

Defined results: null or empty text is one empty line; lines whose key is shorter never drop; a null
id sorts as the smallest document; rows that repeat a doc_id are one document for counting, and get bitmaps of their
own when their texts differ; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridctx.llm import words as W
from hybridctx.llm.common import stored

SPACE = b" \t\n\x0b\x0c\r"
DROP, OPEN, SUMMARY = 0, 1, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is too short: ASCII white space off both ends, A-Z in lower case."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, th, pos, n_lines) of every line that can drop; th tells texts of one id apart."""
    def emit(batches):
        for batch in batches:
            ids, th = batch.column(0), batch.column(2).to_numpy()
            for a, b, data, offs in W.slices(batch.column(1)):
                raw, at = data.tobytes(), offs.tolist()
                h, row, pos, n = [], [], [], []
                for k in range(b - a):
                    lines = raw[at[k]:at[k + 1]].split(b"\n")
                    for j, line in enumerate(lines):
                        key = line_key(line, min_chars)
                        if key is not None:
                            h.append(xxhash.xxh3_128_digest(key))
                            row.append(a + k)
                            pos.append(j)
                            n.append(len(lines))
                if h:
                    two = np.frombuffer(b"".join(h), ">i8").astype(np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(two[:, 0]), pa.array(two[:, 1]), ids.take(pa.array(row)), pa.array(th[row]),
                         pa.array(pos, pa.int32()), pa.array(n, pa.int32())],
                        names=["h1", "h2", "id", "th", "pos", "n_lines"])

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                           T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()),
                           T.StructField("pos", T.IntegerType()), T.StructField("n_lines", T.IntegerType())])
    return _keyed(docs, id_col, text_col).mapInArrow(emit, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))


def _changed(col: pa.Array) -> np.ndarray:
    """Entry i: whether value i differs from value i - 1 (first: True)."""
    out = np.ones(len(col), bool)
    if len(col) > 1:
        a, b = col[1:], col[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


class _Runs:
    """Streams sorted rows of one task. Rows go out as DROP (decided) or OPEN (of a run that a neighbour may hold)."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key = None       # (h1, h2) of the run that is open
        self.first = True     # it is the first run of the task
        self.n_docs = 0
        self.top = None       # its largest id (one-row Arrow array)
        self.last = None      # its last id
        self.held: list[pa.RecordBatch] = []   # undecided rows of the open run
        self.out: list[tuple[int, pa.RecordBatch]] = []
        self.summaries: list[tuple] = []

    def _close(self, end: bool):
        """The open run is over (end: because the task's rows are)."""
        if self.key is None:
            return
        if self.first or end:
            self.summaries.append((self.key, self.n_docs, self.top))
            self.out += [(OPEN, x) for x in self.held]
        self.key, self.held, self.first = None, [], False

    def _part(self, rows: pa.RecordBatch, key: tuple):
        """Rows of one run, or of a part of it that continues the open run."""
        ids = rows.column("id")
        new = _changed(ids)
        if self.key != key:
            self._close(False)
            self.key, self.n_docs, self.top, self.last = key, 0, ids[:1], None
        else:
            new[0] = _changed(pa.concat_arrays([self.last, ids[:1]]))[1]
        number = self.n_docs + np.cumsum(new)  # which document of the run, from 1
        self.n_docs, self.last = int(number[-1]), ids[len(ids) - 1:]
        if self.first:  # it may have begun in the task before: all rows stay open
            self.held.append(rows)
            if sum(x.num_rows for x in self.held) > 50_000:
                self.out += [(OPEN, x) for x in self.held]
                self.held = []
            return
        self.held.append(rows.filter(pa.array(number > 1)))
        if self.n_docs >= self.min_docs:  # decided: whatever follows, the first document is the largest
            self.out += [(DROP, x) for x in self.held]
            self.held = []

    def add(self, batch: pa.RecordBatch):
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(h1))
        key = lambda i: (int(h1[i]), int(h2[i]))
        self._part(batch.slice(0, ends[0]), key(0))
        if len(starts) > 2:  # runs that lie inside the batch, at once
            a, b = int(starts[1]), int(starts[-1])
            self._inside(batch.slice(a, b - a), new[a:b])
        if len(starts) > 1:
            self._part(batch.slice(int(starts[-1])), key(int(starts[-1])))

    def _inside(self, rows: pa.RecordBatch, new_run: np.ndarray):
        self._close(False)
        new_doc = _changed(rows.column("id")) | new_run
        run = np.cumsum(new_run) - 1
        docs = np.cumsum(new_doc)
        first = np.flatnonzero(new_run)
        number = docs - docs[first][run] + 1
        n_docs = np.append(docs[first[1:] - 1], docs[-1]) - docs[first] + 1
        drop = (number > 1) & (n_docs[run] >= self.min_docs)
        if drop.any():
            self.out.append((DROP, rows.filter(pa.array(drop))))


def dropped_lines(rows: DataFrame, min_docs: int, partitions: int | None = None) -> DataFrame:
    """(id, th, pos, n_lines) of the lines to drop."""
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *rows.schema.fields,
                           T.StructField("n_docs", T.LongType())])

    def run(batches):
        state, names = _Runs(min_docs), None
        def flush():
            for kind, x in state.out:
                if x.num_rows:
                    n = x.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind, np.int32)), *x.columns, pa.nulls(n, pa.int64())], names=names)
            state.out = []
        types = None
        for batch in batches:
            if batch.num_rows:
                names = ["kind", *batch.schema.names, "n_docs"]
                types = [f.type for f in batch.schema]
                state.add(batch)
                yield from flush()
        state._close(True)
        yield from flush() if names else ()
        for (h1, h2), n, top in state.summaries:
            yield pa.RecordBatch.from_arrays(
                [pa.array([SUMMARY], pa.int32()), pa.array([h1], types[0]), pa.array([h2], types[1]),
                 top.cast(types[2]), *(pa.nulls(1, t) for t in types[3:]), pa.array([n], pa.int64())], names=names)

    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "h1", "h2", F.col("id").desc()) \
        .sortWithinPartitions("h1", "h2", F.col("id").desc(), "th", "pos")
    done = stored(ordered.mapInArrow(run, schema), "line-runs")
    totals = done.where(F.col("kind") == SUMMARY).groupBy("h1", "h2") \
        .agg(F.sum("n_docs").alias("total"), F.max("id").alias("top")).where(F.col("total") >= min_docs)
    # at most two summary rows per task of the sort: bounded by the number of partitions
    late = done.where(F.col("kind") == OPEN).join(F.broadcast(totals), ["h1", "h2"]) \
        .where(~F.col("id").eqNullSafe(F.col("top")))
    cols = ["id", "th", "pos", "n_lines"]
    assert id_type == done.schema["id"].dataType
    return done.where(F.col("kind") == DROP).select(cols).unionByName(late.select(cols))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id",
                 text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(id, th, n_lines, n_dropped, keep) of every document that loses lines; keep: zlib-compressed bits, first
    line in the highest bit of the first byte, 1 = the line stays. th: xxhash64 of the text."""
    lines = dropped_lines(line_rows(docs, min_chars, id_col, text_col), min_docs, partitions)
    per_doc = lines.groupBy("id", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drops"))

    def pack(batches):
        for batch in batches:
            n = batch.column("n_lines").to_numpy()
            drops = batch.column("drops")
            bits, count = [], []
            for i in range(batch.num_rows):
                keep = np.ones(n[i], bool)
                gone = drops[i].values.to_numpy()
                keep[gone] = False
                count.append(len(gone))
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), batch.column("n_lines"), pa.array(count, pa.int64()),
                 pa.array(bits, pa.binary())], names=["id", "th", "n_lines", "n_dropped", "keep"])

    schema = T.StructType([lines.schema["id"], lines.schema["th"], T.StructField("n_lines", T.IntegerType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])
    return per_doc.mapInArrow(pack, schema)


def kept_text(text: bytes, n_lines: int, keep: bytes) -> bytes:
    """The lines that a bitmap keeps, joined by line feeds."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines]
    return b"\n".join(x for x, stays in zip(text.split(b"\n"), bits.tolist()) if stays)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_lines, n_dropped, kept_text."""
    def cut(batches):
        for batch in batches:
            texts, keeps = batch.column("text"), batch.column("keep")
            n_lines, n_dropped, out = [], [], []
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                n = raw.count(b"\n") + 1
                keep = keeps[i].as_py()
                kept = raw if keep is None else kept_text(raw, n, keep)
                n_lines.append(n)
                n_dropped.append(batch.column("n_dropped")[i].as_py() or 0)
                out.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(out, pa.binary()).cast(pa.string())], names=[id_col, "n_lines", "n_dropped", "kept_text"])

    b = bitmaps.select(F.col("id").alias("b_id"), F.col("th").alias("b_th"), "n_dropped", "keep")
    rows = _keyed(docs, id_col, text_col)
    rows = rows.join(b, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th")), "left") \
        .select("id", "text", "n_dropped", "keep")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """Every document with its repeated lines dropped: id_col, n_lines, n_dropped, kept_text."""
    names = {k: options[k] for k in ("id_col", "text_col") if k in options}
    return apply_bitmaps(docs, keep_bitmaps(docs, **options), **names)


#: The query's columns in DuckDB. A-Z are lower-cased alone, hence translate().
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (d.top IS NOT NULL AND d.top <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (d.top IS NULL OR d.top = k.doc_id), ''))
         AS kept_sha256
FROM k LEFT JOIN d ON k.key = d.key GROUP BY k.doc_id
"""
