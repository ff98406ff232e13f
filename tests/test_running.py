import random

from pyspark.sql import functions as F

from memweave.operators.running import running


def check(spark, rows, parts):
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["k"], [F.col("o")], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, held = [], {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)):
        n, s = held.get(k, (0, 0))
        held[k] = (n + 1, s + (v or 0))
        want.append((k, o, *held[k]))
    assert sorted(((r.k, r.o, r.row_no, r.run_v) for r in got), key=repr) == sorted(want, key=repr)


def test_hot_key_spans_partitions(spark):
    rows = [(7 if i % 3 else i, i, i * i) for i in range(600)] + [(None, i, None) for i in range(40)]
    random.Random(1).shuffle(rows)
    check(spark, rows, 9)


def test_equal_rows_and_empty(spark):
    check(spark, [(1, 5, 2)] * 200 + [(2, 1, 1)], 6)
    assert running(spark.createDataFrame([], "k long, o long"), ["k"], [F.col("o")]).collect() == []
