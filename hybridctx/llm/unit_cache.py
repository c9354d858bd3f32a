"""Exact tokenisation with a bounded cache of units.

A unit is a stretch of text whose encoding does not depend on its neighbours, so the encoding of a text is the
concatenation of its units' encodings:

* 'word' units (tokenizers that drop white space): runs without ASCII white space. Pre-tokens, added tokens and
  normalisation never reach over an ASCII space.
* 'space_word' units (byte-level pre-tokenisation with a leading space): a cut before every ASCII white-space
  byte that follows a character which is no white space. No pre-token contains white space after non-space,
  and the pre-tokeniser looks ahead, never back.

Distinct units are encoded by the library itself, once per task slice; their ids are kept in sorted NumPy arrays
under 64-bit hashes (bounded: cleared when full). Units longer than `LONG` bytes are encoded, never kept.
"""

from __future__ import annotations

import os

import numpy as np

from hybridctx.llm import words as W

LONG = 512
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for a vocabulary file, loaded once per Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def _unicode_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends right before byte `at` is (or may be) Unicode white space."""
    p1 = data[at - 1]
    p2 = np.where(at >= 2, data[np.maximum(at - 2, 0)], 0)
    p3 = np.where(at >= 3, data[np.maximum(at - 3, 0)], 0)
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    three = ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)) \
        | ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80))
    return (p1 <= 0x20) | two | three


def space_word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first unit of each row and the end); the units of a row cover it."""
    space = W._SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    at = at[~_unicode_space_before(data, at)]
    bounds = np.union1d(at, offs[:-1][offs[:-1] < offs[1:]])
    starts = bounds.astype(np.int64)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offs)


class UnitCache:
    """Encodings of units under 64-bit hashes: counts, and ids when with_ids."""

    def __init__(self, path: str, kind: str, with_ids: bool, limit: int = 1_500_000):
        self.path, self.kind, self.with_ids, self.limit = path, kind, with_ids, limit
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, data, starts, ends):
        raw = data.tobytes()
        tok = tokenizer(self.path)
        units = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]
        counts, ids = np.empty(len(units), np.int32), []
        for a in range(0, len(units), 20_000):
            enc = tok.encode_batch_fast(units[a:a + 20_000], add_special_tokens=False)
            counts[a:a + len(enc)] = [len(x) for x in enc]
            if self.with_ids:
                ids.append(np.fromiter((i for x in enc for i in x.ids), np.uint32))
        return counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def look_up(self, data, starts, ends):
        """(distinct -> token count, distinct -> first id, ids, index of each unit's distinct)."""
        h = W.hash_runs(data, starts, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self.clear()
        pos = np.searchsorted(self.keys, uniq)
        hit = np.zeros(len(uniq), bool)
        inside = pos < len(self.keys)
        hit[inside] = self.keys[pos[inside]] == uniq[inside]
        counts, at = np.zeros(len(uniq), np.int32), np.zeros(len(uniq), np.int64)
        counts[hit], at[hit] = self.counts[pos[hit]], self.at[pos[hit]]
        ids = self.ids
        if not hit.all():
            new = np.flatnonzero(~hit)
            c, got = self._encode(data, starts[first[new]], ends[first[new]])
            counts[new] = c
            at[new] = len(ids) + np.cumsum(c) - c
            ids = np.concatenate([ids, got]) if self.with_ids else ids
            keep = new[(ends - starts)[first[new]] <= LONG]
            where = np.searchsorted(self.keys, uniq[keep])
            self.keys = np.insert(self.keys, where, uniq[keep])
            self.counts = np.insert(self.counts, where, counts[keep])
            self.at = np.insert(self.at, where, at[keep])
            if len(keep) == len(new):
                self.ids = ids
            elif self.with_ids:  # ids of long units are used now and not kept
                kept_c = counts[keep]
                src = np.repeat(at[keep], kept_c) + np.arange(int(kept_c.sum())) - np.repeat(np.cumsum(kept_c) - kept_c, kept_c)
                self.at[np.searchsorted(self.keys, uniq[keep])] = len(self.ids) + np.cumsum(kept_c) - kept_c
                self.ids = np.concatenate([self.ids, ids[src]])
        return counts, at, ids, inverse

    def _units(self, data, offs):
        if self.kind == "word":
            return W.runs(~W._SPACE[data], offs)
        return space_word_units(data, offs)

    def row_counts(self, data, offs) -> np.ndarray:
        """Tokens of every row of a slice."""
        starts, ends, rows = self._units(data, offs)
        if not len(starts):
            return np.zeros(len(offs) - 1, np.int64)
        counts, _, _, inverse = self.look_up(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(counts[inverse].astype(np.int64))])
        return total[rows[1:]] - total[rows[:-1]]

    def row_ids(self, data, offs) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offset of each row and the end)."""
        starts, ends, rows = self._units(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        counts, at, ids, inverse = self.look_up(data, starts, ends)
        n = counts[inverse].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        src = np.repeat(at[inverse] - total[:-1], n) + np.arange(total[-1])
        return ids[src], total[rows]


_caches: dict[tuple, UnitCache] = {}


def unit_cache(path: str, kind: str, with_ids: bool) -> UnitCache:
    """One cache per Python worker and vocabulary."""
    return _caches.setdefault((path, kind, with_ids), UnitCache(path, kind, with_ids))
