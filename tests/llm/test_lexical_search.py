import math
import random
import re
from collections import Counter

import pyarrow as pa

from hybridctx.llm import lexical_search as S
from hybridctx.llm import words as W
from tables import LOWER, awkward, documents, prose

TERM = re.compile(S.TERM_PATTERN)


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def plain(rows, items, k):
    bags = [(r[0], Counter(terms(r[1]))) for r in rows]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in q if t in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(*x, "?", 1) for x in items], "item_id long, text string, doc_id string, rank int")


def corpus():
    r = random.Random(5)
    rows = awkward() + [(100 + i, prose(i, 5 + i % 60), "s") for i in range(150)]
    rows += [(1000 + r.randrange(500), "W1 w2, w3-w4! W2", "s") for _ in range(130)]  # many equal bags, repeated ids
    rows += [(3000 + i, "w4 w3 w2 w2 w1" if i % 2 else "w3 w9 w9 w9", "s") for i in range(70)] + [(None, "w1 w2 w2 w3 w4", "s")]
    return rows + [(5000, "É é日本 naïve C3PO a_b 9x", "s")]


ITEMS = [(1, "w1 W2 w2 w3?"), (2, None), (3, ""), (4, "nowhere"), (5, "w9 w17 one x"), (None, "w4 é日本"), (6, "a-b C3po"),
         (1, "w250"), (7, " ".join(f"w{i}" for i in range(400)))]


def test_search_against_brute_force(spark):
    rows = corpus()
    docs = documents(spark, rows)
    for k in (50, 3):
        want = plain(rows, ITEMS, k)
        got = S.search(docs.repartition(5), benchmark(spark, ITEMS), k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    # items in blocks give the same
    got = S.search(docs, benchmark(spark, ITEMS), 50, block_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, ITEMS, 50)


def test_equal_hashes_do_not_merge_or_match(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = corpus()
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert sorted(map(tuple, S.search(documents(spark, rows), benchmark(spark, ITEMS)).collect()), key=str) == plain(rows, ITEMS, 50)
    v = S.Vocabulary(["ab", "cd"])
    monkeypatch.setattr(W, "hash_runs", lambda d, s, e, seed=0: v.hashes[:1].repeat(len(s)))
    for _, _, data, offs in W.slices(pa.array(["ab cd xy"])):
        starts, ends, _ = W.runs(S._IS_TERM[data], offs)
        assert sorted(v.find(data, starts, ends).tolist())[:2] == [-1, -1]


def test_terms_are_the_pattern(spark):
    for t in ["a_b-c", "É x1Y2 日本\u0000z", "__", "", "naïve b", None]:
        for _, _, data, offs in W.slices(pa.array([t], pa.string())):
            data = W._LOWER[data]
            starts, ends, _ = W.runs(S._IS_TERM[data], offs)
            assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == terms(t)


def test_empty_tables(spark):
    docs, items = documents(spark, corpus()), benchmark(spark, ITEMS)
    assert S.search(documents(spark, []), items).collect() == []
    assert S.search(docs, items.where("false")).collect() == []
    assert S.search(documents(spark, [(1, None), (2, ""), (3, " -_")]), items).collect() == []


def test_a_hot_bag_keeps_its_smallest_ids(spark):
    rows = [(i, "hot bag", "s") for i in range(3000, 0, -1)] + [(9000 + i, prose(i, 9), "s") for i in range(20)]
    got = S.search(documents(spark, rows).repartition(7), benchmark(spark, [(1, "hot")]), 50).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 51)]
