import zlib

import numpy as np
from pyspark.sql import functions as F

from hybridctx.llm import quality
from tables import awkward, documents, prose


def labelled(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 80)
        rows.append((1000 + i, text.upper().replace(" ", "!! ") if bad else text, "s"))
        labels.append((1000 + i, 0 if bad else 1, None, "x"))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_ids(spark):
    rows, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.rank_documents(documents(spark, rows), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    test = [r for r in got.values() if r.held_out]
    right = sum(r.predicted == (0 if (r.doc_id - 1000) % 4 == 0 else 1) for r in test)
    assert len(test) > 50 and right / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = sorted(map(tuple, quality.rank_documents(documents(spark, rows), labels).collect()))
    two = sorted(map(tuple, quality.rank_documents(documents(spark, rows), wrong).collect()))
    assert one == two


def test_scores_depend_on_the_text_alone(spark):
    rows, labels = labelled(spark)
    model = quality.fit(documents(spark, rows), labels, ~quality.is_held_out())
    moved = [(9000 - r[0], r[1], "other") for r in rows]
    a = {r.doc_id: r.score for r in quality.score(documents(spark, rows), model).collect()}
    b = {9000 - r.doc_id: r.score for r in quality.score(documents(spark, moved), model).collect()}
    assert a == b


def test_awkward_rows_and_missing_labels(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows + awkward())
    got = quality.rank_documents(docs, labels).collect()
    assert len(got) == len(rows) + len(awkward()) and all(r.score is not None for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    n_good = sum(r.predicted for r in got)
    assert kept.count() == n_good
    none = labels.where("false")
    assert {r.score for r in quality.rank_documents(docs, none).collect()} == {0.5}
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert {r.score for r in quality.rank_documents(docs, nulls).collect()} == {0.5}
    assert quality.rank_documents(documents(spark, []), labels).collect() == []


def test_pairwise_fit_orders_and_threshold():
    r = np.random.default_rng(1)
    good, bad = r.normal(1, 1, (400, 5)), r.normal(-1, 1, (100, 5))
    w = quality.fit_pairs(good, bad, 5000)
    assert (good @ w).mean() > (bad @ w).mean()
    t = quality.quantile_threshold(good @ w, bad @ w, 0.2)
    share = 0.8 * (good @ w < t).mean() + 0.2 * (bad @ w < t).mean()
    assert abs(share - 0.2) < 0.01


def test_a_repeated_id_counts_once_in_the_fit(spark):
    rows, labels = labelled(spark)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    hot = next(r for r in train if (r[0] - 1000) % 4)
    once = quality.fit(documents(spark, rows), labels, ~quality.is_held_out())
    often = quality.fit(documents(spark, rows + [hot] * 400).repartition(6), labels, ~quality.is_held_out())
    assert np.array_equal(once.mean, often.mean) and np.array_equal(once.weights, often.weights)
    # with texts of its own in every row, one of them stands for the id
    texts = documents(spark, rows + [(hot[0], prose(i, 30).upper(), "s") for i in range(400)])
    a, b = (quality.fit(t, labels, ~quality.is_held_out()) for t in (texts, texts.repartition(6)))
    assert np.array_equal(a.weights, b.weights)
