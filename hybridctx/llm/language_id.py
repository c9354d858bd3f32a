"""Language identification: multinomial naive Bayes over hashed character n-grams of whole texts.

A text is lower-cased; every character that is no letter counts as a blank, and one blank is put before and behind
the text. Its n-grams are all windows of 1, 2 and 3 characters that hold a letter, hashed into BUCKETS numbers. A
language c gives bucket b the smoothed probability (count(c, b) + alpha) / (count(c) + alpha * BUCKETS) and has the
prior (documents(c) + 1) / (documents + languages). The predicted language has the largest sum of logarithms; the score is
its posterior probability.

Logarithms are kept as integers (units of 2^-16), so a document's sums are exact and do not depend on how rows are
dealt to tasks. Training counts cover all training rows: every task adds its n-grams up and hands on one number per
(language, bucket) it met; Spark adds those. The matrix (BUCKETS x languages, 4 bytes each) is broadcast; it is
bounded by `max_languages`, beyond which fit() raises an error. Scoring goes through slices of
rows: n-grams as one flat array with row bounds (a sparse matrix of ones), rows of the matrix summed per document.

Defined results: null text, or text without a letter, is `und` with score 0, and so is everything when nothing was
learned; rows with null lang or text, or without a letter, teach nothing; a null id is not held out; equal sums go to the language that
sorts first; repeated rows count and answer once each; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridctx.llm import words as W

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
UNKNOWN = "und"
#: Logarithms are rounded to multiples of 1 / UNIT.
UNIT = 1 << 16
_BLANK = 32
#: Bytes worked on at a time; a longer text is cut into pieces that overlap by the largest n-gram.
_PIECE = 1 << 18
#: Cells of one gathered block (n-grams x languages).
_CELLS = 1 << 21
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter (general category L); built once per Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _gram_buckets(c: np.ndarray, room: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, bucket) of the n-grams of the characters c; room is the number of characters from each to its row's end."""
    at, out = [], []
    c = c.astype(np.uint32)
    h, some = np.zeros(len(c), np.uint32), np.zeros(len(c), bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[:len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1:]
            some = some[:len(c) - n + 1] | letter[n - 1:]
            if n in SIZES:
                start = np.flatnonzero(some & (room[:len(some)] >= n))
                g = h[start] * np.uint32(2) + np.uint32(n)
                g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
                at.append(start)
                out.append((g >> np.uint32(16)).astype(np.int64))
    return np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.int64)


def _window(data: np.ndarray, offs: np.ndarray, head: bool = True, tail: bool = True, own: int | None = None):
    """(rows, buckets) of the n-grams of whole rows, or of a part of one row: head and tail tell whether it starts and
    ends there, own is the number of its bytes in which n-grams may start."""
    c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    # characters before each byte: bytes that do not continue a character
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size, n = np.diff(before[offs]), len(offs) - 1
    letter = letters()[c]
    pads = int(head) + int(tail)
    row = np.repeat(np.arange(n), size + pads)
    place = np.arange(len(c)) + pads * np.repeat(np.arange(n), size) + int(head)
    padded, is_letter = np.full(len(row), _BLANK, np.uint32), np.zeros(len(row), bool)
    padded[place], is_letter[place] = np.where(letter, c, _BLANK), letter
    room = np.cumsum(size + pads)[row] - np.arange(len(row))
    start, bucket = _gram_buckets(padded, room, is_letter)
    if own is not None:
        mine = start < before[own] + int(head)
        start, bucket = start[mine], bucket[mine]
    return row[start], bucket


def grams(texts: pa.Array):
    """(rows, buckets) of all n-grams of a string array, in bounded pieces; a long row comes in several pieces."""
    for a, _, data, offs in W.slices(pc.utf8_lower(texts), _PIECE):
        if len(data) <= 2 * _PIECE:
            rows, buckets = _window(data, offs)
            yield a + rows, buckets
            continue
        # one long row: windows of bytes, each with the characters behind it that its last n-grams need
        p = 0
        while p < len(data):
            q = _char_end(data, p + _PIECE)
            far = q
            for _ in range(max(SIZES) - 1):
                far = _char_end(data, far + 1)
            rows, buckets = _window(data[p:far], np.array([0, far - p]), p == 0, far == len(data), q - p)
            yield a + rows, buckets
            p = q


def _char_end(data: np.ndarray, at: int) -> int:
    """The first character boundary at or behind a byte position."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


@dataclass
class Model:
    """languages in order, their integer log priors, and the (BUCKETS, languages) integer log probabilities."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sums of logarithms per row and language, whether the row has a letter)."""
        k = len(self.languages)
        total, known = np.zeros((len(texts), k), np.int64), np.zeros(len(texts), bool)
        step = max(1, _CELLS // max(k, 1))
        for rows, buckets in grams(texts):
            known[rows] = True
            for a in range(0, len(rows) if k else 0, step):
                r = rows[a:a + step]
                new = np.flatnonzero(np.diff(r, prepend=-1))  # a row is met once per n-gram size
                part = np.add.reduceat(self.table[buckets[a:a + step]], new, axis=0, dtype=np.int64)
                np.add.at(total, r[new], part)
        return total + self.prior, known

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        total, known = self.sums(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        top = total[np.arange(len(total)), best]
        share = 1.0 / np.exp(np.maximum((total - top[:, None]) / UNIT, -745.0)).sum(axis=1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist())]
        return names, np.where(known, share, 0.0)


def _count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of (lang, text), added up per task; bucket -1 counts the documents that hold a letter."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            codes = b.column(0).dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for name in names:
                counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
            seen = np.zeros(b.num_rows, bool)
            for r, bucket in grams(b.column(1)):
                seen[r] = True
                lang = code[r]
                for i in np.unique(lang).tolist():
                    counts[names[i]][:BUCKETS] += np.bincount(bucket[lang == i], minlength=BUCKETS)
            for i, n in enumerate(np.bincount(code[seen], minlength=len(names)).tolist()):
                counts[names[i]][BUCKETS] += n
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)),
                 pa.array(n[at])], names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long")


def fit(docs: DataFrame, may_train: Column, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5,
        max_languages: int = 128) -> Model:
    """Fit on all rows with text and lang for which may_train holds. The driver gets at most max_languages x
    (BUCKETS + 1) sums; more languages than that are an error (raise the limit, at 256 KB a language)."""
    rows = docs.where(may_train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = rows.select("lang").distinct().limit(max_languages + 1).count()
    if n > max_languages:
        raise ValueError(f"more than {max_languages} languages in {lang_col!r}: raise max_languages")
    got = _count_grams(rows).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names), key=lambda x: x.encode("utf-8"))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[got.column("bucket").to_numpy(), np.fromiter((at[x] for x in names), np.int64, len(names))] = \
        got.column("n").to_numpy()
    docs_of = counts[-1]
    keep = np.flatnonzero(docs_of > 0)
    counts, docs_of = counts[:BUCKETS, keep], docs_of[keep]
    p = (counts + alpha) / (counts.sum(axis=0) + alpha * BUCKETS)
    prior = (docs_of + 1) / (docs_of.sum() + max(len(keep), 1))
    whole = lambda x: np.rint(np.log(x) * UNIT)
    return Model([langs[i] for i in keep], whole(prior).astype(np.int64), whole(p).astype(np.int32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred, score. Reads the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, score = shared.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)],
                                             names=[id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0 (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **fit_options) -> DataFrame:
    """id_col, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    model = fit(docs, ~is_held_out(id_col), text_col, lang_col, **fit_options)
    return predict(docs, model, id_col, text_col).select(
        id_col, is_held_out(id_col).alias("held_out"), "lang_pred", "score")
