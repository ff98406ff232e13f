"""The bucketed store: only touched buckets are rewritten, schema versions mix, a bucket may become empty."""
import glob
import os

from conftest import mem_rows
from pyspark.sql import functions as F

from memweave.sources import memories as M


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_change_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    mem = mem_rows(spark, [dict(id=k, summary=f"s{k}", tags=["a"]) for k in range(40)], approved=False)
    M.write_buckets(mem.filter("id < 20").drop("tags", "confidence"), path, 8)      # an earlier schema version
    M.write_buckets(mem.filter("id >= 20"), path, 8)
    assert {r["id"]: r["tags"] for r in M.read_buckets(spark, path).collect()} == {
        k: [] if k < 20 else ["a"] for k in range(40)}
    before = _files(path)
    changed = mem.filter("id in (3, 30)").withColumn("approved", F.lit(True))
    new = mem_rows(spark, [dict(id=100, summary="new")])
    touched = M.change_buckets(spark, path, changed.unionByName(new), spark.createDataFrame([(30,), (None,)], "id bigint"), 8)
    after = _files(path)
    untouched = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 3 and untouched and all(after.get(f) == before[f] for f in untouched)
    assert not {f for f in before if f not in untouched} & set(after)
    got = {r["id"]: r["approved"] for r in M.read_buckets(spark, path).collect()}
    assert got == {k: k == 3 for k in range(40) if k != 30} | {100: True}


def test_a_bucket_whose_rows_are_all_forgotten(spark, tmp_path):
    path = str(tmp_path / "store")
    M.write_buckets(mem_rows(spark, [dict(id=k) for k in range(3)]), path, 64)
    assert M.change_buckets(spark, path) == []
    M.change_buckets(spark, path, forget=spark.createDataFrame([(1,), (999,)], "id bigint"))
    assert sorted(r["id"] for r in M.read_buckets(spark, path).collect()) == [0, 2]
    M.change_buckets(spark, path, forget=M.read_buckets(spark, path).select("id"))
    assert M.read_buckets(spark, path).isEmpty()
    M.change_buckets(spark, path, mem_rows(spark, [dict(id=1, summary="again")]))
    assert [r["summary"] for r in M.read_buckets(spark, path).collect()] == ["again"]
