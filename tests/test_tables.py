from pyspark.sql import functions as F

from memweave.sources import tables


def rows_per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_a_table_of_one_row_group_is_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 500)
    rows = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert max(rows_per_task(tables.read_table(spark, tmp_path, "documents"))) == 2000
    dealt = tables.texts(spark, tmp_path)
    assert len(rows_per_task(dealt)) == 4 and max(rows_per_task(dealt)) <= 520
    assert sorted(dealt.collect()) == sorted(rows.collect())


def test_few_rows_and_even_tables_stay_where_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 500)
    for name, n, files in (("documents", 400, 1), ("pages", 2000, 8), ("conversations", 0, 1)):
        spark.range(n).repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
        assert tables.needed_spread(tables.read_table(spark, tmp_path, name)) is None
