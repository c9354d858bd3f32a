"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A document of at most `chunk_chars` characters is encoded whole (through the exact unit cache). A longer one is
encoded in overlapping chunks with offsets, so that memory follows the chunk and not the document. Two neighbours
are spliced at a boundary that both encodings share and that is proven stable:

* left chunk L: the boundary starts a pre-token and at least STABLE pre-tokens follow it in L. Pre-tokenisation
  runs left to right and looks at most past the end of its match, so only the last few pre-tokens of a cut text can
  differ from those of the whole text;
* right chunk R: the same offset starts a pre-token of R, and from there on R's ids and offsets equal L's up to
  the last stable boundary of L. From a common boundary on, both scans see the same text, so R continues exactly as the
  whole text does.

When no such boundary exists (one long run, a special string cut by the chunk), the overlap doubles and the right
chunk starts earlier, at last at the left chunk's own start, which gives one larger chunk; so the count is always
that of the whole text.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table gives an
empty result; extra columns are never read; the id keeps its type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hybridctx.llm import words as W
from hybridctx.llm.unit_cache import tokenizer, unit_cache

STABLE = 4


def _pretoken_starts(enc) -> np.ndarray:
    """Indices of the tokens that start a pre-token."""
    w = np.array([-1 if x is None else x for x in enc.word_ids], np.int64)
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    # an added token or a change of segment restarts the numbering; offsets that touch stay one pre-token otherwise
    return np.flatnonzero(new)


def splice(left, left_at: int, right, right_at: int) -> tuple[int, int] | None:
    """A proven stable common boundary of two encodings that start at characters left_at and right_at:
    (tokens of left before it, tokens of right before it), or None."""
    ls, rs = _pretoken_starts(left), _pretoken_starts(right)
    if len(ls) <= STABLE:
        return None
    lo = np.array([o[0] for o in left.offsets], np.int64) + left_at
    ro = np.array([o[0] for o in right.offsets], np.int64) + right_at
    stable = ls[:-STABLE]
    end = int(ls[-STABLE])
    common, li, ri = np.intersect1d(lo[stable], ro[rs], return_indices=True)
    lid, rid = np.array(left.ids), np.array(right.ids)
    for i, j in zip(stable[li].tolist(), rs[ri].tolist()):
        n = end - i
        if n > 0 and j + n <= len(rid) and np.array_equal(lid[i:end], rid[j:j + n]) \
                and np.array_equal(lo[i:end], ro[j:j + n]):
            return i, j
    return None


def count_huge(tok, text: str, chunk_chars: int, overlap_chars: int) -> int:
    """Tokens of a text, never encoding much more than chunk_chars characters at once."""
    encode = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    start, stop = 0, min(len(text), chunk_chars)
    left, skip, total, step = encode(start, stop), 0, 0, chunk_chars - overlap_chars
    while stop < len(text):
        overlap, found = overlap_chars, None
        nxt = min(len(text), stop + step)
        while found is None and overlap < stop - start:
            at = stop - overlap
            right = encode(at, nxt)
            found = splice(left, start, right, at)
            overlap *= 2
        if found is None or found[0] < skip:
            # widened up to the left chunk itself: one larger chunk, and twice as large a step behind it, so that a run
            # without a stable boundary is encoded again a few times, not once per chunk
            left, stop = encode(start, nxt), nxt
            step = max(step, stop - start)
            continue
        step = chunk_chars - overlap_chars
        total += found[0] - skip
        left, skip, start, stop = right, found[1], at, nxt
    return total + len(left) - skip


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk_chars: int = 1 << 15,
                 overlap_chars: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a tokenizers .json file with byte-level pre-tokenisation, readable on every executor."""
    def count(batches):
        cache = unit_cache(vocabulary, "space_word", False)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b, data, offs in W.slices(texts):
                n_bytes[a:b] = np.diff(offs)
                # no text has more characters than bytes, so the cheap test on bytes comes first
                for i in np.flatnonzero(np.diff(offs) > chunk_chars).tolist():
                    text = data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace")
                    n_tokens[a + i] = count_huge(tokenizer(vocabulary), text, chunk_chars, overlap_chars)
                short = np.diff(offs) <= chunk_chars
                if short.all():
                    n_tokens[a:b] = cache.row_counts(data, offs)
                elif short.any():
                    lens = np.where(short, np.diff(offs), 0)
                    part = data[np.repeat(short, np.diff(offs))]
                    got = cache.row_counts(part, np.concatenate([[0], np.cumsum(lens)]))
                    n_tokens[a:b][short] = got[short]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(count, schema)
