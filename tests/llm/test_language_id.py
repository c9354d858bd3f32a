import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridctx.llm import language_id as L
from tables import awkward

SYLLABLES = {"xx": ["ka", "to", "ri", "mu"], "yy": ["sch", "ung", "ber", "ein"], "zz": ["ção", "lhe", "nho", "que"]}


def text(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def table(spark, rows):
    return spark.createDataFrame([(*r, None, 0.5) for r in rows],
                                 "doc_id long, text string, lang string, held_out string, score double")


def learned(n=240):
    langs = list(SYLLABLES)
    return [(i, text(langs[i % 3], i), langs[i % 3]) for i in range(n)]


def plain_buckets(t):
    """n-grams of a text one by one."""
    c = [ord(x) if x.isalpha() else 32 for x in t.lower()]
    c = [32, *c, 32]
    out, mask = [], 0xFFFFFFFF
    for n in L.SIZES:
        for i in range(len(c) - n + 1):
            if any(x != 32 for x in c[i:i + n]):
                h = 0
                for x in c[i:i + n]:
                    h = (h * 0x9E3779B1 + x) & mask
                g = (h * 2 + n) & mask
                g = ((g ^ (g >> 15)) * 0x85EBCA6B) & mask
                g = ((g ^ (g >> 13)) * 0xC2B2AE35) & mask
                out.append(g >> 16)
    return out


def test_grams_against_a_plain_loop(monkeypatch):
    texts = [r[1] for r in awkward() if r[1] is None or len(r[1]) < 3000] + ["Ünïcode ÀÉ x", "日本 語", "1 2 3", "ab" * 300 + "é" * 99]
    for piece in (1 << 18, 40, 7):
        monkeypatch.setattr(L, "_PIECE", piece)
        got = [[] for _ in texts]
        for rows, buckets in L.grams(pa.array(texts)):
            for r, b in zip(rows.tolist(), buckets.tolist()):
                got[r].append(b)
        assert [sorted(x) for x in got] == [sorted(plain_buckets(t or "")) for t in texts]


def test_whole_query_against_brute_force(spark):
    rows = learned() + [(1000 + i, r[1], ["xx", "yy", None][i % 3]) for i, r in enumerate(awkward()) if not r[1] or len(r[1]) < 6000] \
        + [(None, text("xx", 9), "xx"), (5, text("yy", 5), "zz"), (5, text("yy", 5), "zz")]
    counts, docs = {}, Counter()
    for i, t, lang in rows:
        if lang is None or (i is not None and zlib.crc32(str(i).encode()) % 5 == 0):
            continue
        if grams := plain_buckets(t or ""):
            counts.setdefault(lang, Counter()).update(grams)
            docs[lang] += 1
    langs = sorted(counts)
    unit, total = L.UNIT, sum(docs.values())
    size = {x: sum(counts[x].values()) + 0.5 * L.BUCKETS for x in langs}
    want = []
    for i, t, _ in rows:
        sums = [round(math.log((docs[x] + 1) / (total + len(langs))) * unit)
                + sum(k * round(math.log((counts[x][b] + 0.5) / size[x]) * unit) for b, k in Counter(plain_buckets(t or "")).items())
                for x in langs]
        best = max(range(len(langs)), key=lambda j: (sums[j], -j))
        known = bool(plain_buckets(t or ""))
        share = 1 / sum(math.exp(max((s - sums[best]) / unit, -745)) for s in sums)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, langs[best] if known else "und",
                     round(share, 9) if known else 0.0))
    got = L.identify(table(spark, rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got), key=str) == sorted(want, key=str)


def test_held_out_accuracy_and_independence(spark):
    rows = learned()
    got = {r.doc_id: r for r in L.identify(table(spark, rows)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 25 and all(got[i].lang_pred == lang for i, _, lang in held)
    # the languages of held-out rows, ids and extra columns are never read
    wrong = [(i, t, "xx" if got[i].held_out else lang) for i, t, lang in rows]
    again = {r.doc_id: r for r in L.identify(table(spark, wrong).repartition(3)).collect()}
    assert all(again[i].lang_pred == got[i].lang_pred and again[i].score == got[i].score for i in got)


def test_long_texts_are_read_whole(spark):
    model = L.fit(table(spark, learned()), F.lit(True))
    mostly = text("yy", 1, 200) + " " + text("xx", 2, 120_000)
    names, score = model.predict(pa.array([mostly, text("yy", 1, 200)]))
    assert names == ["xx", "yy"] and ((0 <= score) & (score <= 1)).all()


def test_empty_and_nothing_to_learn(spark):
    assert L.identify(table(spark, [])).collect() == []
    rows = [(i, t, None) for i, t, _ in learned(20)]
    assert {(r.lang_pred, r.score) for r in L.identify(table(spark, rows)).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError, match="max_languages"):
        L.identify(table(spark, learned(30)), max_languages=2)
    assert np.array_equal(*[L.fit(table(spark, learned(60)).repartition(n), F.lit(True)).table for n in (1, 4)])
