"""Small awkward tables and plain-Python versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that an operator might use for itself; they must neither clash nor be read.
CLASHING = ["id", "h", "s", "t", "v", "u", "n", "key", "th", "node", "comp", "size", "copies", "kept", "bucket", "w",
            "label", "score", "pos", "rank", "a", "b"]


def documents(spark, rows, extra=True):
    """rows of (doc_id, text[, source]) as a documents table; extra adds the clashing columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, *[None] * len(CLASHING)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASHING)
    df = spark.createDataFrame(full, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Rows with nulls, empties, one very long text, ties, repeated rows, odd white space and scripts."""
    base = prose(1, 120)
    return [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "b"), (5, "a b c d e", "b"), (6, base, "c"),
            (7, base, "c"), (7, base, "c"), (8, base + " tail", None), (9, base.upper(), "c"),
            (10, prose(2, 30_000), "d"), (11, "é à ü x  日本 語\x1cq", "\U0001f600"), (None, base, "e"),
            (None, None, "e"), (12, "x" * 5000, "￿"), (13, prose(3, 40) + "\n" + base, "d"), (14, "\n\n", "d")]


def components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
