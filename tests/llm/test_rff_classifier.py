import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from memweave.llm import rff_classifier as rc
from memweave.sources.tables import read_table

from .helpers import ODD, docs


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["the", "of", "on"]) + str(rng.randrange(400)) + ("" if good else rng.choice(["%%%", "###"]))
                        for _ in range(rng.randint(20, 200)))
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_split(spark):
    rows, labels = corpus(600)
    got = {r["doc_id"]: r for r in rc.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in rows)
    hits = [got[d]["predicted"] == y for d, y in labels if got[d]["held_out"]]
    assert len(hits) > 100 and np.mean(hits) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(300)
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    kind = "doc_id long, quality int"
    a, b = ([(r["doc_id"], r["score"]) for r in rc.classify(docs(spark, rows), spark.createDataFrame(x, kind))
             .orderBy("doc_id").collect()] for x in (labels, flipped))
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)


def test_odd_rows_and_no_labels(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (0, None)]
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = rc.classify(docs(spark, rows), none).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    assert rc.classify(docs(spark, []), none).collect() == []
    one = spark.createDataFrame([(0, 1), (4, 1), (1, 1), (3, 1), (5, 1)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in rc.classify(docs(spark, rows), one).collect())


def test_accepted_keeps_the_columns(spark):
    rows, labels = corpus(300)
    df = docs(spark, rows)
    kept = rc.accepted(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == df.columns
    gone = {d for d, _ in rows} - {r["doc_id"] for r in kept.select("doc_id").collect()}
    bad = {d for d, y in labels if not y}
    assert len(gone ^ bad) < 0.05 * len(rows)


def test_isotonic_is_least_squares_monotone():
    x, y, n = np.arange(6.0), np.array([0, 2, 1, 1, 4, 3.0]), np.array([1, 2, 1, 4, 4, 4.0])
    cx, cy = rc.isotonic(x, y, n)
    assert (np.diff(cy) > 0).all() and np.allclose(cy, [0, 4 / 7, 7 / 8])


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    kept = rc.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    good = read_table(spark, sf, "labels").where("quality = 1")
    rate = kept.where("held_out").join(good, "doc_id").agg(F.avg("predicted")).first()[0]
    assert rate > 0.95
