import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from hybridctx.llm import exact_dedup, mixing
from tables import awkward, documents, prose, words


def test_exact_against_brute_force(spark):
    rows = awkward()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for keep, pick in (("max", max), ("min", min)):
        got = sorted(map(tuple, exact_dedup.exact_dedup(documents(spark, rows), keep=keep).collect()), key=str)
        want = []
        for r in rows:
            g = groups[r[1] or ""]
            k = pick([x for x in g if x is not None], default=None)
            want.append((r[0], k, len(g), r[0] == k, hashlib.sha256((r[1] or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_poor_hash_never_merges(spark):
    docs = documents(spark, awkward())
    weak = exact_dedup.exact_dedup(docs, content_hash=lambda c: F.length(c) % 2)
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_dedup.exact_dedup(docs).collect()))


def test_keep_exact_keeps_one_row_per_text(spark):
    docs = documents(spark, awkward())
    got = exact_dedup.keep_exact(docs, keep="max")
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in awkward()})


def test_exact_empty_table(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_dedup(docs).collect() == [] and exact_dedup.keep_exact(docs).collect() == []


def plain_targets(sizes, cap=3.0):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    left = float(total)
    while free:
        ww = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / ww >= cap * sizes[s]]
        if not full:
            target |= {s: left * w[s] / ww for s in free}
            break
        for s in full:
            target[s] = cap * sizes[s]
            free.discard(s)
        left = total - sum(target.values())
    return target


def test_mix_targets_and_nearness(spark):
    rows = awkward() + [(1000 + i, prose(i, 5 + i % 90), f"s{i % 7}") for i in range(700)]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs).withColumnRenamed("source", "src").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.src] and abs(r.target - want[r.src]) < 1e-6 * max(1, want[r.src])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.src] += r.taken
    for s in [f"s{i}" for i in range(7)]:
        assert abs(taken[s] - want[s]) <= 90
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(5)).withColumnRenamed("source", "src").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_long_document_leaves_its_source_near_the_target(spark):
    def draw(i):
        return int(hashlib.md5(f"{mixing.SALT}{i}".encode()).hexdigest()[:13], 16) / 16 ** 13

    early = min(range(5000, 7000), key=draw)  # the long document ranks first
    rows = [(early, prose(0, 22_000), "a")] + [(i, prose(i, 5 + i % 90), "a") for i in range(400)] \
        + [(1000 + i, prose(i, 100), "b" if i % 2 else "c") for i in range(400)]
    taken, target, whole = defaultdict(int), {}, {}
    for r in mixing.mix_sources(documents(spark, rows)).withColumnRenamed("source", "src").collect():
        taken[r.src] += r.taken
        target[r.src], whole[r.src] = r.target, r.target / r.source_size
    assert whole["a"] < 1 and 22_000 > target["a"]  # it is larger than all that is sampled
    assert abs(taken["a"] - target["a"]) <= 5  # the smallest document has 5 words
    assert abs(taken["b"] - target["b"]) <= 100 and abs(taken["c"] - target["c"]) <= 100


def test_importance_raises_inclusion(spark):
    rows = [(i, prose(i, 10), "a" if i % 2 else "b") for i in range(2000)]
    docs = documents(spark, rows).withColumn("imp", F.when(F.col("doc_id") % 4 < 2, 5.0).otherwise(1.0))
    got = mixing.mix_sources(docs, importance="imp").where("source = 'a'").select("doc_id", "copies").collect()
    odd = [r.copies for r in got if r.doc_id % 4 < 2]
    even = [r.copies for r in got if r.doc_id % 4 >= 2]
    assert sum(odd) / len(odd) > sum(even) / len(even) + 0.2


def test_mix_stage_rows(spark):
    docs = documents(spark, awkward())
    got = mixing.keep_mixed(docs)
    assert got.columns == docs.columns
    total = mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert got.count() == total
    empty = documents(spark, [])
    assert mixing.mix_sources(empty).collect() == [] and mixing.keep_mixed(empty).collect() == []
    none = documents(spark, [(1, None), (2, " "), (3, "")])
    assert [r.taken for r in mixing.mix_sources(none).collect()] == [0, 0, 0]


def test_columns_named_like_the_stages_own_come_back(spark):
    names = ["__stay", "__k", "__row", "stay", "sha", "nth", "stay_id", "row", "total", "rows", "k", "copies", "copy", "Bucket"]
    from hybridctx.llm import near_dup
    rows = [(i, prose(i % 3, 30), "s", *[f"{n}{i}" for n in names]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (exact_dedup.keep_exact, near_dup.keep_one_per_group, mixing.keep_mixed):
        got = stage(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert found and {tuple(r) for r in found} <= {tuple(r) for r in rows}


def test_shorter_documents_are_likelier(spark):
    rows = [(i, prose(i, 5 if i % 2 else 60), "a") for i in range(3000)] + [(9000 + i, prose(i, 100), "b") for i in range(300)]
    got = mixing.mix_sources(documents(spark, rows)).where("source = 'a'").select("size", "copies").collect()
    share = lambda n: sum(r.copies for r in got if r["size"] == n) / 1500
    assert share(5) > share(60) + 0.05
