"""Vectorised word access for Arrow text columns: no Python object per word, memory bounded by a slice of bytes.

Words are maximal runs of bytes other than ASCII white space. A word's hash is a sum of 64-bit values, one for each
eight bytes, every value mixed with its place in the word; equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first k bytes of a little-endian 64-bit number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Eight-byte pieces hashed at a time.
_BLOCK = 1 << 17
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), _BASE, np.uint64)
        more[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(more)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit; a bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(27)
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(31)
    return h


_place_tables: dict[int, np.ndarray] = {}


def _places(n: int, seed: int) -> np.ndarray:
    """One fixed random number for each of the first n places, by seed."""
    if len(_place_tables.get(seed, ())) < n:
        k = np.arange(1, max(2 * n, 1 << 10) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            _place_tables[seed] = mix(mix(k * _BASE) + _U(seed) * _U(0xC2B2AE3D27D4EB4F))
    return _place_tables[seed][:n]


def slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string array: (first row, end row, bytes, byte offset of each row and the end). Null counts as
    empty. A slice holds at most max_bytes unless one row alone is longer."""
    texts = texts.cast(pa.large_utf8()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def runs(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross rows: (start, end, first run of each row and the end)."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    inner = offs[:-1]
    before[inner[inner < len(is_word)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every run of bytes. Each eight bytes are mixed with their place before they are summed, so no
    pattern of the bytes cancels out; another seed gives an independent hash."""
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.uint64)
    n = (lens + 7) >> 3
    first = np.cumsum(n) - n
    places = _places(int(n.max()), seed)
    padded = np.empty(len(data) + 8, np.uint8)
    padded[:len(data)], padded[len(data):] = data, 0
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.empty(len(lens), np.uint64)
    # whole runs in blocks, so that the working arrays stay small
    cuts = np.searchsorted(first + n, np.arange(_BLOCK, int(n.sum()) + _BLOCK, _BLOCK), "left") + 1
    a = 0
    for b in np.minimum(cuts, len(lens)).tolist():
        if b <= a:
            continue
        k, begin = n[a:b], first[a:b] - first[a]
        j = np.arange(int(k.sum())) - np.repeat(begin, k)
        left = np.minimum(np.repeat(lens[a:b], k) - 8 * j, 8)
        value = eights[np.repeat(starts[a:b], k) + 8 * j]
        value &= _MASKS[left]
        value ^= places[j]
        with np.errstate(over="ignore"):
            out[a:b] = np.add.reduceat(mix(value), begin)
        a = b
    with np.errstate(over="ignore"):
        return mix(out + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, hashes: bool = True):
    """(starts, ends, first word of each row and the end, hashes or None) of the words of a slice."""
    if lower:
        data = _LOWER[data]
    starts, ends, rows = runs(~_SPACE[data], offs)
    return starts, ends, rows, hash_runs(data, starts, ends) if hashes else None


def windows(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every `width` consecutive words, over the whole slice: entry i covers words i .. i + width - 1."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = _U(0xA24BAED4963EE407 + 2 * seed)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * b + h[j:j + n]
    return mix(out)
