import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hybridctx.llm import line_dedup, near_dup, substring_dedup
from tables import awkward, components, documents, prose, shingles, words


# ------------------------------------------------------------------------------------------------ near copies

def near_truth(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components(ids, edges)


def mutated(seed, base, rate):
    r = random.Random(seed)
    return " ".join(f"m{r.randrange(10 ** 6)}" if r.random() < rate else w for w in base.split())


def near_rows():
    """Chains and stars of near copies at every distance, a passage most documents share, ties and short texts."""
    rows, passage = [], prose(77, 60)
    for g in range(12):
        base = prose(100 + g, 30 + 25 * g)
        rows += [(1000 + 40 * g + k, mutated(g * 100 + k, base, 0.004 * k)) for k in range(12)]
    step = prose(55, 200).split()
    rows += [(3000 + k, " ".join(step[5 * k:5 * k + 100])) for k in range(20)]      # a chain of shifted texts
    rows += [(5000 + k, prose(900 + k, 40) + " " + passage + " " + prose(2000 + k, 20)) for k in range(150)]
    rows += [(7000 + k, " ".join(f"q{j}" for j in range(k % 6))) for k in range(12)]
    return rows + [r for r in awkward() if r[0] != 7] + [(7, prose(1, 120))]


def test_near_components_against_brute_force(spark):
    rows = near_rows()
    sets, truth = near_truth(rows)
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), truth[r.doc_id]), r
            assert r.kept == (r.doc_id == r.component_id)


def test_near_links_inside_a_group_are_followed_once(spark, monkeypatch):
    """Large groups have many links inside: the rounds of the components may not meet them again after each step."""
    from hybridctx.llm import components as cc
    rows, followed = near_rows(), []

    def spy(df, name="step"):
        out = stored(df, name)
        followed.extend([out.count()] if name == "cc-edges" else [])
        return out

    stored = cc.stored
    monkeypatch.setattr(cc, "stored", spy)
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    linked = {r.doc_id for r in got if r.component_id != r.doc_id} | {r.component_id for r in got if r.component_id != r.doc_id}
    # each edge counts in both directions; the first links are at most one per node, later ones join components
    assert len(linked) <= sum(followed) <= 4 * len(linked)


def test_near_repeated_rows_empty_table_and_stage(spark):
    rows = near_rows()
    twice = near_dup.near_duplicates(documents(spark, rows + rows)).distinct().collect()
    once = near_dup.near_duplicates(documents(spark, rows)).distinct().collect()
    assert sorted(map(str, twice)) == sorted(map(str, once))
    empty = documents(spark, [])
    assert near_dup.near_duplicates(empty).collect() == [] and near_dup.keep_one_per_group(empty).collect() == []
    docs = documents(spark, rows)
    _, truth = near_truth(rows)
    kept = near_dup.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for c in truth.values()}


# ------------------------------------------------------------------------------------------------ lines

def line_truth(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    top = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if top.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_rows():
    r = random.Random(4)
    common = "This very line is held by every document"
    pool = [prose(3000 + k, r.randrange(2, 9)) for k in range(60)] + ["é" * 19, "é" * 20, "x" * 19, "X" * 20]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "  " + common + "\t"), (5, common.upper() + "\n" + common)]
    for i in range(10, 300):
        lines = [r.choice(pool) for _ in range(r.randrange(8))] + [common] * r.randrange(3)
        r.shuffle(lines)
        rows.append((i, "\n".join(r.choice(["", " ", "\x0b"]) + x for x in lines)))
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_lines_against_brute_force(spark, partitions):
    rows = line_rows()
    got = line_dedup.dedup_lines(documents(spark, rows), partitions=partitions).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == line_truth(rows)


def test_line_bitmaps(spark):
    rows = line_rows()
    truth = line_truth(rows)
    texts = dict(rows)
    maps = line_dedup.keep_bitmaps(documents(spark, rows)).collect()
    assert {m.id for m in maps} == {i for i, t in truth.items() if t[1]}
    for m in maps:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(m.keep), np.uint8))[:m.n_lines]
        assert m.n_lines == truth[m.id][0] and m.n_dropped == truth[m.id][1] == m.n_lines - bits.sum()
        assert line_dedup.kept_text(texts[m.id].encode(), m.n_lines, m.keep).decode() == truth[m.id][2]


def test_lines_awkward_and_empty(spark):
    docs = documents(spark, awkward())
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(awkward())
    same = [r for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


# ------------------------------------------------------------------------------------------------ substrings

def substring_truth(rows, width=20):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            if seen.setdefault(k, (i, p)) != (i, p):
                gone[p:p + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def substring_rows():
    r = random.Random(8)
    passages = [prose(500 + k, r.randrange(19, 90)) for k in range(12)]
    rows = [(1, None), (2, ""), (3, "z " * 200), (4, ("p q " * 60) + "end"), (5, "z " * 25), (6, prose(41, 19)),
            (7, prose(41, 19)), (8, prose(42, 20)), (9, prose(42, 20).replace(" ", "\t\n")), (10, prose(43, 6000)),
            (11, "u " + prose(43, 6000) + " é日本 x")]
    for i in range(20, 160):
        parts = [r.choice(passages) if r.random() < 0.5 else prose(i * 7 + k, r.randrange(0, 60))
                 for k in range(r.randrange(1, 7))]
        if r.random() < 0.2:
            parts = [mutated(i, " ".join(parts), 0.02)]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("segment_bits", [32, 1, 0])
def test_substrings_against_brute_force(spark, segment_bits):
    """Fewer segment bits make paths fail their verification, so the window fallback is exercised too."""
    rows = substring_rows()
    got = substring_dedup.dedup_substrings(documents(spark, rows), segment_bits=segment_bits).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == substring_truth(rows)


def test_substrings_awkward_repeated_and_empty(spark):
    got = substring_dedup.dedup_substrings(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    # the null id is the earliest, so its text stays and later copies go
    assert [r.n_removed for r in got if r.doc_id is None and r.n_words] == [0]
    assert all(r.n_removed == r.n_words == 120 for r in got if r.doc_id in (6, 7))
    assert substring_dedup.dedup_substrings(documents(spark, [])).collect() == []


def test_paths_compact_into_long_spans(spark):
    rows = [(1, prose(43, 3000)), (2, "a " + prose(43, 3000) + " b")]
    source = substring_dedup._source(documents(spark, rows), "doc_id", "text")
    spans = substring_dedup.repeated_spans(source).collect()
    long = max(spans, key=lambda s: s.stop - s.start)
    # interior segments form one path: a few spans cover 3000 words
    assert long.stop - long.start > 2900 and len(spans) < 60


def test_near_components_of_a_large_edited_group(spark):
    """Edited copies of one text and of its copies, at every similarity: the last step meets many pairs that hardly miss."""
    r = random.Random(11)
    base = prose(77, 90).split()
    rows, texts = [], [base]
    for i in range(260):
        t = list(texts[0] if i % 3 else r.choice(texts))
        for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8])):
            at = r.randrange(len(t))
            if r.random() < 0.3:
                del t[at]
            else:
                t[at] = r.choice(["edit", "other", f"w{r.randrange(400)}"])
        texts.append(t)
        rows.append((i, " ".join(t)))
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b
             and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    want = components(sets, edges)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 20
