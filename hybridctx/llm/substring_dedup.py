"""Substring deduplication over a compacted de Bruijn graph of word windows, verified in the source texts.

A window is WIDTH (20) consecutive words of one document. Every word covered by a window whose words also start earlier
(smaller id, or earlier in the document) is removed; the first occurrence stays.

1. Edges. The smallest hash among a window's K-mers (K words) is its anchor; consecutive windows with one anchor
   form a segment. The anchor depends on the window's words alone, so equal windows lie in segments of equal anchors,
   and only about one row per eight words leaves the text. Anchors that occur once are dropped by a join.
2. Compaction. Per repeated anchor: its count, whether all its segments are equal ('pure'), the first occurrence, and
   whether all occurrences follow the same anchor. These go back to the occurrences by a join. An edge between
   neighbouring pure segments does not branch when the second always follows the first and both occur equally
   often; runs of such edges compact into one path occurrence (document, first word, last word).
3. Verification. Path occurrences get a 128-bit digest of their words at the source coordinates and must equal the
   path's first occurrence; then all but the first are removed whole. A path that fails (a hash met two texts)
   is taken apart into windows like the rest.
4. Segments that are not pure (the ends of repeated passages, edited spots) are resolved window by window with 128-bit
   window hashes: a group-by finds the first start of each, a join marks the others.

Texts move only for documents that hold a repeated anchor (step 3) or lose words (the end); others are finished where
they are scanned. Hot passages: counts and firsts are pre-aggregated in the tasks, joins are on splittable sides.

Defined results: null text has no words; repeated rows (equal id and text) start at the same place, so neither is
earlier; rows that repeat an id with another text are ordered by their starts alone; a null id is the
earliest; an empty table gives an empty result; extra columns are never read. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridctx.llm import words as W
from hybridctx.llm.common import split_by_ids, stored

WIDTH = 20
K = 5
SPAN = WIDTH - K + 1          # K-mers of a window; a segment has at most as many windows
TEXT_BITS = 20                # bits that tell texts of one id apart
PURE, FIRST, ONE_BEFORE = 1, 2, 4

_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        more = np.full(max(n, 256), np.uint64(pow(int(W._BASE), -1, 2 ** 64)), np.uint64)
        more[0] = 1
        with np.errstate(over="ignore"):
            _inverse = np.cumprod(more)
    return _inverse[:n]


def segments(data: np.ndarray, offs: np.ndarray):
    """Segments of a slice: (row, first window in the row, windows - 1, anchor, segment hash, anchor before) arrays."""
    _, _, first, h = W.words(data, offs)
    n = len(h) - WIDTH + 1
    if n <= 0:
        return None
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    kmers = W.windows(h, K)
    at = np.arange(n)
    anchor = at + np.lib.stride_tricks.sliding_window_view(kmers, SPAN)[:n].argmin(1)
    valid = at + WIDTH <= first[1:][row[:n]]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    s = np.flatnonzero(new)
    if not len(s):
        return None
    length = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(s))
    end = s + length + WIDTH - 1  # after the last word
    a = kmers[anchor[s]]
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * W.powers(len(h)), dtype=np.uint64)])
        seg = (run[end] - run[s]) * _inverse_powers(len(h))[s] + (anchor[s] - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    seg = W.mix(seg + length.astype(np.uint64))
    before = np.zeros(len(s), np.uint64)
    joined = (s[:-1] + length[:-1] == s[1:]) & (row[s[:-1]] == row[s[1:]])
    before[1:][joined] = a[:-1][joined]
    return row[s], s - first[row[s]], length - 1, a, seg, before


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, th, text): the id as a number that is never null, bits that tell texts of one id apart."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63)).alias("key"),
                       F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << TEXT_BITS)).cast("int").alias("th"),
                       text.alias("text"), F.col(id_col).alias("id"))


def edge_rows(source: DataFrame, anchors_only: bool, segment_bits: int) -> DataFrame:
    """(h) or (h, x, key, at) of every segment. x: segment hash (high half) and anchor before (low half);
    at: start, windows - 1 (4 bits) and text bits in one number that orders by start."""
    def run(batches):
        for batch in batches:
            key, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offs in W.slices(batch.column(2)):
                got = segments(data, offs)
                if got is None:
                    continue
                row, start, more, h, seg, before = got
                cols = [pa.array(h.view(np.int64))]
                if not anchors_only:
                    seg = (seg >> np.uint64(32)) & np.uint64((1 << segment_bits) - 1)
                    x = (seg << np.uint64(32)) | (before & np.uint64(0xFFFFFFFF))
                    at = (start << (TEXT_BITS + 4)) | (more << TEXT_BITS) | th[a:b][row]
                    cols += [pa.array(x.view(np.int64)), pa.array(key[a:b][row]), pa.array(at)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "x", "key", "at"][:len(cols)])

    return source.select("key", "th", "text").mapInArrow(
        run, "h long" if anchors_only else "h long, x long, key long, at long")


def _start(at: str) -> Column:
    return F.shiftright(at, TEXT_BITS + 4)


def occurrences(source: DataFrame, segment_bits: int) -> DataFrame:
    """(key, at, h, n, flags) of the occurrences of repeated anchors."""
    often = stored(edge_rows(source, True, segment_bits).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("h"), "edges")
    occ = stored(edge_rows(source, False, segment_bits).join(often, "h"), "edge-occurrences")
    seg, before = F.shiftrightunsigned("x", 32), F.col("x").bitwiseAND(0xFFFFFFFF)
    stats = stored(occ.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min(seg).alias("s0"), F.max(seg).alias("s1"),
        F.min(before).alias("b0"), F.max(before).alias("b1"),
        F.min(F.struct("key", _start("at").alias("start"))).alias("top")), "edge-stats")
    flag = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0))
    return occ.join(stats, "h").select(
        "key", "at", "h", "n",
        (flag(F.col("s0") == F.col("s1"), PURE)
         + flag((F.col("key") == F.col("top.key")) & (_start("at") == F.col("top.start")), FIRST)
         + flag((F.col("b0") == F.col("b1")) & (F.col("b0") != 0), ONE_BEFORE)).alias("flags"))


PASS_SCHEMA = ("kind int, key long, th int, start long, stop long, head long, first boolean, d1 long, d2 long")


def compact(row, at, h, n, flags):
    """Compaction of occurrences (sorted by text row and start): the paths as arrays (row, first word, stop word, head,
    first), and the segments that are not pure as (row, first window, windows)."""
    start, more = at >> (TEXT_BITS + 4), (at >> TEXT_BITS) & 15
    pure = (flags & PURE) > 0
    linked = np.zeros(len(at), bool)
    linked[1:] = pure[1:] & pure[:-1] & ((flags[1:] & ONE_BEFORE) > 0) & (n[1:] == n[:-1]) \
        & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + more[:-1] + 1)
    breaks = np.flatnonzero(~linked)
    head = breaks[pure[breaks]]
    tail = np.append(breaks[1:], len(at))[np.searchsorted(breaks, head)] - 1
    rest = np.flatnonzero(~pure)
    return ((row[head], start[head], start[tail] + more[tail] + WIDTH, h[head], (flags[head] & FIRST) > 0),
            (row[rest], start[rest], more[rest] + 1))


_SPACES = bytes(0x20 if b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) else b for b in range(256))


def _digest(region: bytes, size: int) -> tuple[int, int]:
    """128-bit digest of the words of a region of `size` bytes when they are joined by one space each."""
    text = region.translate(_SPACES) if len(region) == size else b" ".join(region.split())
    d = xxhash.xxh3_128_intdigest(text)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(d >> 64), signed(d & 0xFFFFFFFFFFFFFFFF)


def _path_batch(paths, keys, th, data, starts, ends, first, a) -> pa.RecordBatch:
    """Path occurrences of the rows from a on, with the digest of their words in the source text."""
    row, s, e, head, is_first = paths
    raw = data.tobytes()
    lens = np.concatenate([[0], np.cumsum(ends - starts)])
    w0, w1 = first[row - a] + s, first[row - a] + e
    sizes = lens[w1] - lens[w0] + (e - s) - 1
    digests = [_digest(raw[x:y], n) for x, y, n in zip(starts[w0].tolist(), ends[w1 - 1].tolist(), sizes.tolist())]
    n = len(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int32)), pa.array(keys[row]), pa.array(th[row]), pa.array(s), pa.array(e),
         pa.array(head), pa.array(is_first), *(pa.array(c, pa.int64()) for c in zip(*digests))], names=_PASS_NAMES)


def _window_batch(row, start, count, keys, th, hashes, first, a) -> pa.RecordBatch:
    """All windows of the given runs (row, first window, windows) with their 128-bit hashes: hashes are two independent
    hashes of the words."""
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    row = np.repeat(row, count)
    pos = first[row - a] + at
    w1, w2 = (W.windows(h, WIDTH, seed).view(np.int64)[pos] for seed, h in enumerate(hashes))
    n = len(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ones(n, np.int32)), pa.array(keys[row]), pa.array(th[row]), pa.array(at), pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(w1), pa.array(w2)], names=_PASS_NAMES)


_PASS_NAMES = ["kind", "key", "th", "start", "stop", "head", "first", "d1", "d2"]


def _flat(lists: pa.ListArray, *names: str):
    """(row of every entry, the named fields) of a list<struct> column."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    return np.repeat(np.arange(len(lens)), lens), *(flat.field(f).to_numpy() for f in names)


def _slice_rows(sorted_rows: np.ndarray, a: int, b: int) -> slice:
    return slice(*np.searchsorted(sorted_rows, (a, b)).tolist())


def source_pass(source: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Reads the texts that per_doc (o_key, occ) names; rows of PASS_SCHEMA: kind 0 a path occurrence with the
    digest of its words, kind 1 a window (start; d1, d2 its hash)."""
    def run(batches):
        for batch in batches:
            keys, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, at, h, n, flags = _flat(batch.column(3), "at", "h", "n", "flags")
            mine = np.flatnonzero((at & ((1 << TEXT_BITS) - 1)) == th[row])
            mine = mine[np.lexsort((at[mine], row[mine]))]
            keep = np.ones(len(mine), bool)  # a repeated row brings every occurrence once more
            keep[1:] = (at[mine][1:] != at[mine][:-1]) | (row[mine][1:] != row[mine][:-1])
            mine = mine[keep]
            paths, rest = compact(row[mine], at[mine], h[mine], n[mine], flags[mine])
            for a, b, data, offs in W.slices(batch.column(2)):
                starts, ends, first, hashes = W.words(data, offs)
                here = _slice_rows(paths[0], a, b)
                if here.start < here.stop:
                    yield _path_batch([c[here] for c in paths], keys, th, data, starts, ends, first, a)
                here = _slice_rows(rest[0], a, b)
                if here.start < here.stop:
                    two = hashes, W.hash_runs(data, starts, ends, 1)
                    yield _window_batch(*(c[here] for c in rest), keys, th, two, first, a)

    maybe, _ = split_by_ids(source.select("key", "th", "text"), "key", per_doc, "o_key")
    rows = maybe.join(per_doc, F.col("key") == F.col("o_key")).select("key", "th", "text", "occ")
    return stored(rows.mapInArrow(run, PASS_SCHEMA), "source-pass")


def _windows_again(source: DataFrame, failed: DataFrame) -> DataFrame:
    """Windows (rows of PASS_SCHEMA) of path occurrences (key, th, start, stop) that failed their verification."""
    spans = failed.groupBy(F.col("key").alias("o_key"), F.col("th").alias("o_th")) \
        .agg(F.collect_set(F.struct("start", "stop")).alias("occ"))

    def run(batches):
        for batch in batches:
            keys, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, start, stop = _flat(batch.column(3), "start", "stop")
            for a, b, data, offs in W.slices(batch.column(2)):
                starts, ends, first, hashes = W.words(data, offs)
                here = _slice_rows(row, a, b)
                if here.start < here.stop:
                    two = hashes, W.hash_runs(data, starts, ends, 1)
                    yield _window_batch(row[here], start[here], (stop - start)[here] - WIDTH + 1, keys, th, two, first, a)

    rows = source.select("key", "th", "text").join(
        spans, (F.col("key") == F.col("o_key")) & (F.col("th") == F.col("o_th"))).select("key", "th", "text", "occ")
    return stored(rows.mapInArrow(run, PASS_SCHEMA), "windows-again")


def repeated_spans(source: DataFrame, segment_bits: int = 32) -> DataFrame:
    """(key, th, start, stop): word ranges to remove; the ranges of one text may overlap."""
    occ = occurrences(source, segment_bits)
    per_doc = stored(occ.groupBy(F.col("key").alias("o_key")).agg(
        F.collect_list(F.struct("at", "h", "n", "flags")).alias("occ")), "doc-occurrences")
    found = source_pass(source, per_doc)
    paths = found.where("kind = 0").select("key", "th", "start", "stop", "head", "first", "d1", "d2")
    firsts = stored(paths.where("first").groupBy(F.col("head").alias("f_head")).agg(
        F.min(F.struct("d1", "d2")).alias("d"), F.min(F.struct("d1", "d2")).alias("lo"),
        F.max(F.struct("d1", "d2")).alias("hi")), "path-firsts")
    same = F.coalesce((F.col("d.d1") == F.col("d1")) & (F.col("d.d2") == F.col("d2")) & (F.col("lo") == F.col("hi")),
                      F.lit(False))
    judged = stored(paths.where("not first").join(firsts, F.col("head") == F.col("f_head"), "left")
                    .select("key", "th", "start", "stop", "head", same.alias("same")), "path-verified")
    bad = judged.where("not same").select(F.col("head").alias("bad")).distinct()
    windows = found.where("kind = 1")
    good = judged
    if judged.where("not same").limit(1).count():
        bad = stored(bad, "path-failed")
        failed = paths.join(bad, F.col("head") == F.col("bad"), "left_semi")
        windows = windows.unionByName(_windows_again(source, failed))
        good = judged.join(bad, F.col("head") == F.col("bad"), "left_anti")
    firsts_of = stored(windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"),
                                                       F.min(F.struct("key", "start")).alias("top"))
                       .where("n > 1").select(F.col("d1").alias("t1"), F.col("d2").alias("t2"), "top"), "window-firsts")
    later = windows.join(firsts_of, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2"))) \
        .where((F.col("key") != F.col("top.key")) | (F.col("start") != F.col("top.start")))
    later = later.withColumn("stop", F.col("start") + WIDTH)
    cols = ["key", "th", "start", "stop"]
    return good.select(cols).unionByName(later.select(cols))


def _kept(batches, with_spans: bool):
    """(id, n_words, n_removed, kept_text) of (id, text[, spans])."""
    for batch in batches:
        if with_spans:
            spans = batch.column(2)
            span_row, s, e = _flat(spans.fill_null([]) if spans.null_count else spans, "start", "stop")
        for a, b, data, offs in W.slices(batch.column(1)):
            starts, ends, first, _ = W.words(data, offs, hashes=False)
            keep = np.ones(len(starts), bool)
            if with_spans:
                here = _slice_rows(span_row, a, b)
                base = first[span_row[here] - a]
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, base + s[here], 1)
                np.add.at(depth, base + e[here], -1)
                keep = np.cumsum(depth)[:-1] == 0
            total = np.diff(first)
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            kept_rows = kept_before[first]
            # every kept word and the byte after it, which becomes the space; the last word of a row without it
            size = (ends - starts)[keep] + 1
            last = kept_rows[1:][np.diff(kept_rows) > 0] - 1
            size[last] -= 1
            begin = np.cumsum(size) - size
            out = data[np.repeat(starts[keep] - begin, size) + np.arange(int(size.sum()))]
            gaps = np.ones(len(size), bool)
            gaps[last] = False
            out[(begin + size - 1)[gaps]] = 0x20
            ends_of = np.concatenate([[0], np.cumsum(size)])[kept_rows].astype(np.int32)
            texts = pa.StringArray.from_buffers(b - a, pa.py_buffer(ends_of.tobytes()), pa.py_buffer(out.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(total), pa.array(total - np.diff(kept_rows)), texts],
                names=["id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     segment_bits: int = 32) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_text (kept words joined by one space).

    segment_bits: bits of the segment hash; fewer only make verification fail more often."""
    source = _source(docs, id_col, text_col)
    spans = repeated_spans(source, segment_bits).groupBy(F.col("key").alias("s_key"), F.col("th").alias("s_th")) \
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = stored(spans, "spans")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    maybe, clean = split_by_ids(source, "key", spans, "s_key")
    cut = maybe.join(spans, (F.col("key") == F.col("s_key")) & (F.col("th") == F.col("s_th")), "left") \
        .select("id", "text", "spans").mapInArrow(lambda it: _kept(it, True), schema)
    whole = clean.select("id", "text").mapInArrow(lambda it: _kept(it, False), schema)
    return cut.unionByName(whole).withColumnRenamed("id", id_col)


#: The query's columns in DuckDB: every window under its own hash.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
k AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
r AS (SELECT k.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (g.p IS NULL) AS kept
      FROM k LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
