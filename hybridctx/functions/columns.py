"""Column expressions: Column in, Column out, evaluated in the JVM (no Python UDFs).

Every function accepts a column name or a Column.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridctx import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------------------------
# time
# --------------------------------------------------------------------------------------------

def epoch_ms(ts) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ column, floored, independent of the session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


def epoch_seconds(ts) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


# --------------------------------------------------------------------------------------------
# vectors
# --------------------------------------------------------------------------------------------

def dot_similarity(query, stored) -> Column:
    """Sum of float32 products over the query's length, accumulated in double (cosine for unit vectors, no norm
    division). A stored vector shorter than the query gives null: embedding_dim_guard reports it."""
    q, v = _c(query), _c(stored)
    prods = F.zip_with(q, F.slice(v, F.lit(1), F.size(q)), lambda x, y: x * y)
    return F.when(F.size(v) >= F.size(q), F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x))


def l2_normalize(v) -> Column:
    """Double norm; below 1e-10 the vector is returned unchanged, else each float times float32(1/norm)."""
    v = _c(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = (F.lit(1.0) / norm).cast("float")
    return F.when(norm < K.NORM_EPS_DOUBLE, v).otherwise(F.transform(v, lambda x: x * scale))


def l2_normalize_clamp(v) -> Column:
    """Float32 norm with divisor max(norm, 1e-9); zero vectors stay zero."""
    v = _c(v)
    sq = F.aggregate(v, F.lit(0.0).cast("float"), lambda s, x: (s + x * x).cast("float"))
    norm = F.sqrt(sq.cast("double")).cast("float")
    denom = F.greatest(norm, F.lit(K.NORM_EPS_FLOAT).cast("float"))
    scale = (F.lit(1.0) / denom.cast("double")).cast("float")
    return F.transform(v, lambda x: x * scale)


# --------------------------------------------------------------------------------------------
# text
# --------------------------------------------------------------------------------------------

def _diacritic_table() -> tuple[str, str]:
    """Lower-case Latin letters made of one base letter plus one combining mark -> the base letter.

    Built by rule from Unicode decomposition (the text index strips a single diacritic and keeps
    letters such as o-stroke, l-stroke and sharp s, which have no decomposition).
    """
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        if ch != ch.lower():
            continue
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and not unicodedata.combining(parts[0]):
            src.append(ch)
            dst.append(parts[0])
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _diacritic_table()


def fts_tokenize(text) -> Column:
    """Full-text tokens: lower case, single diacritics stripped, maximal runs of letters/numbers/private use."""
    folded = F.translate(F.lower(_c(text)), ACCENTED, UNACCENTED)
    return F.coalesce(F.regexp_extract_all(folded, F.lit(K.FTS_TOKEN_PATTERN), F.lit(1)),
                      F.array().cast("array<string>"))


def fts_words(text) -> Column:
    """The tokens of fts_tokenize as one text, joined by spaces: what lies between them is replaced. ASCII text has no diacritics."""
    c = _c(text)
    folded = F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(F.lower(c), ACCENTED, UNACCENTED))
    return F.coalesce(F.trim(F.regexp_replace(folded, K.FTS_BETWEEN_PATTERN, " ")), F.lit(""))


def basic_tokenize(text) -> Column:
    """BERT-uncased basic tokens: lower case, split on Unicode whitespace, ASCII punctuation alone."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(K.BASIC_TOKEN_PATTERN), F.lit(1)),
                      F.array().cast("array<string>"))


def split_tags(tags) -> Column:
    """Comma-separated tags -> trimmed, non-empty array; null -> empty array."""
    parts = F.transform(F.split(_c(tags), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def has_tag(tags, target: str) -> Column:
    """Whole tag equal to target, trimmed, case-insensitive; null tags -> false."""
    parts = F.split(_c(tags), ",")
    found = F.exists(parts, lambda t: F.lower(F.regexp_replace(t, r"^\s+|\s+$", "")) == target.lower())
    return F.coalesce(found, F.lit(False))


def preview(text, n: int = 60) -> Column:
    t = _c(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("...")))


def content_fingerprint(text) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 8)


def context_hash(blob) -> Column:
    return F.sha2(_c(blob), 256)


def workspace_key(path) -> Column:
    return F.substring(F.sha1(_c(path)), 1, 16)


def workspace_name(path) -> Column:
    trimmed = F.regexp_replace(_c(path), "/+$", "")
    return F.substring_index(trimmed, "/", -1)


def hard_truncate_utf8(text, max_bytes, note: str = K.TRUNCATION_NOTE) -> Column:
    """Cut the UTF-8 bytes at max_bytes - len(note), step back to a character boundary, append note.

    Text that already fits in the budget gets the note appended unchanged.
    """
    t = _c(text)
    b = F.encode(t, "UTF-8")
    budget = _c(max_bytes) - F.lit(len(note.encode("utf-8"))) if not isinstance(max_bytes, int) \
        else F.lit(max_bytes - len(note.encode("utf-8")))

    def is_continuation(pos):
        # byte at 0-based position pos (i.e. the first byte that is cut off) is 10xxxxxx
        byte = F.conv(F.hex(F.substring(b, pos + 1, 1)), 16, 10).cast("int")
        return F.coalesce((byte >= 128) & (byte < 192), F.lit(False))

    # a UTF-8 character has at most 3 continuation bytes: step back at most 3 times
    cut = budget
    for _ in range(3):
        cut = F.when((cut > 0) & is_continuation(cut), cut - 1).otherwise(cut)
    kept = F.decode(F.substring(b, 1, F.greatest(cut, F.lit(0))), "UTF-8")
    return F.when(F.octet_length(t) <= budget, F.concat(t, F.lit(note))) \
        .otherwise(F.concat(kept, F.lit(note)))


# --------------------------------------------------------------------------------------------
# scoring and formatting
# --------------------------------------------------------------------------------------------

def recency_importance(created_at, importance, now_ms) -> Column:
    """exp(-age_days / 30) * (0.5 + importance), age from whole seconds; not clamped."""
    now_s = F.lit(int(now_ms) // 1000) if isinstance(now_ms, int) else _div_trunc(_c(now_ms).cast("long"), 1000)
    age_days = (now_s - _div_trunc(_c(created_at).cast("long"), 1000)) / F.lit(86400.0)
    return F.exp(-age_days / F.lit(K.DECAY_DAYS)) * (F.lit(0.5) + _c(importance))


def _div_trunc(x: Column, d: int) -> Column:
    """Integer division truncating toward zero (C# semantics)."""
    return F.when(x >= 0, F.floor(x / d)).otherwise(-F.floor(-x / d)).cast("long")


def format_age(created_ms, now_ms) -> Column:
    now = F.lit(int(now_ms)) if isinstance(now_ms, int) else _c(now_ms)
    hours = F.greatest(now - _c(created_ms), F.lit(0)).cast("double") / F.lit(3_600_000.0)
    return (F.when(hours < 1, F.lit("just now"))
            .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago"))))


def format_importance(importance) -> Column:
    return F.format_string("%.1f", _c(importance))


# --------------------------------------------------------------------------------------------
# ids
# --------------------------------------------------------------------------------------------

_BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of conv(x, 10|16, 32)


def _crockford(base32_digits: Column, width: int) -> Column:
    return F.translate(F.lpad(base32_digits, width, "0"), _BASE32, K.CROCKFORD)


def ulid_time_part(ts_ms) -> Column:
    """10 Crockford base-32 characters of a 48-bit millisecond time."""
    return _crockford(F.conv(_c(ts_ms).cast("string"), 10, 32), 10)


def assign_ulid_col(ts_ms, key_cols: list[str]) -> Column:
    """26-char ULID: time part + 80 bits taken from SHA-256 of the row key (stable across task retries)."""
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(_c(k).cast("string"), F.lit("\u0000")) for k in key_cols]), 256)
    hi = _crockford(F.conv(F.substring(h, 1, 10), 16, 32), 8)
    lo = _crockford(F.conv(F.substring(h, 11, 10), 16, 32), 8)
    return F.concat(ulid_time_part(ts_ms), hi, lo)
