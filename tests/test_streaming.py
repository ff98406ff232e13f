"""The streamed result over several micro-batches equals the batch result."""
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import mem_rows
from memweave.operators.gate import gate
from memweave.streaming import ingest


def test_stream_gate_equals_batch(spark):
    snap = mem_rows(spark, [dict(id=1, summary="we use flask", type="decision"),
                            dict(id=2, summary="we use chroma", type="decision", project="q")])
    recs = spark.createDataFrame(
        [(10, "p", "decision", "session", "we use django"), (11, "p", "blah", "session", "x"),
         (12, "q", "decision", "user", "Authorization: Basic " + "Q" * 12), (13, "q", "decision", "chat", "we use qdrant"),
         (14, "p", "bug", "chat", "plain note")],
        "id bigint, project string, type string, source string, text string")
    src = ingest.scratch_dir(spark, "test-src")
    for i, row in enumerate(recs.collect()):  # one file per record -> several micro-batches
        spark.createDataFrame([row], recs.schema).write.mode("overwrite").parquet(os.path.join(src, f"f{i}"))
    stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 2).option(
        "recursiveFileLookup", "true").parquet(src)
    out, ck = ingest.scratch_dir(spark, "test-out"), ingest.scratch_dir(spark, "test-ck")
    q = ingest.start_gate_stream(stream, snap, out, ck)
    q.awaitTermination(300)
    got = {r["id"]: r["status"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["status"] for r in gate(recs, snap).collect()}
    assert got == want
    assert want == {10: "conflict_detected", 11: "error", 12: "blocked", 13: "conflict_detected", 14: "pending"}


def test_archive_stream(spark):
    sessions = spark.createDataFrame([("p", "hello"), ("q", "world")], "project string, text string")
    src = ingest.scratch_dir(spark, "test-sessions")
    sessions.write.parquet(src)
    stream = spark.readStream.schema(sessions.schema).parquet(src)
    out, ck = ingest.scratch_dir(spark, "test-arch"), ingest.scratch_dir(spark, "test-arch-ck")
    q = ingest.start_archive_stream(stream, out, ck, captured_at=F.lit("2024-06-01 00:00:00").cast("timestamp"))
    q.awaitTermination(300)
    rows = sorted((r["project"], str(r["date"]), r["text"]) for r in spark.read.json(out).collect())
    assert rows == [("p", "2024-06-01", "hello"), ("q", "2024-06-01", "world")]
    local = out[len("file:"):] if out.startswith("file:") else out
    assert sorted(os.listdir(local))[:2] == ["_spark_metadata", "project=p"]


SAY = ["we use flask", "we use django", "use npm", "use yarn", "always test", "do not test", "always or do not", "redis and docker",
       "kubernetes", "redis", "avoid x", "prefer y", "nothing", "password = hunter2hunter2"]


@pytest.mark.parametrize("seed", range(2))
def test_auto_batches_with_replays_equal_one_batch(spark, seed):
    rnd = random.Random(seed)
    snap = mem_rows(spark, [dict(id=i, project=rnd.choice("pq"), type="decision", summary=rnd.choice(SAY[:4])) for i in range(2)])
    schema = "id bigint, project string, type string, source string, text string"
    rows = [(100 + i, rnd.choice("pq"), rnd.choice(["decision", "bug", "nonsense"]), "session", rnd.choice(SAY)) for i in range(60)]
    out, state = ingest.scratch_dir(spark, "auto-out"), ingest.scratch_dir(spark, "auto-state")
    run = ingest.gate_batches(snap, out, state, mode="auto")
    parts = [rows[:20], rows[20:25], [], rows[25:]]
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part, schema)
        run(batch, n)
        if n % 2:                                        # replayed by a new process, which must not see a newer snapshot
            run = ingest.gate_batches(snap.limit(0), out, state, mode="auto")
            run(batch, n)
    columns = ["id", "status", "conflict_with", "conflict_rule", "reason"]
    got = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    want = sorted(map(tuple, gate(spark.createDataFrame(rows, schema), snap, mode="auto").select(columns).collect()))
    assert got == want and len(got) == 60
    assert {"stored", "conflict_detected", "error"} <= {r[1] for r in got} and max(r[2] or 0 for r in got) > 100


def test_a_batch_never_reads_the_snapshot_again(spark):
    snap_dir = ingest.scratch_dir(spark, "snap")
    mem_rows(spark, [dict(id=1, summary="use npm", type="bug")]).write.parquet(snap_dir)
    out, state = ingest.scratch_dir(spark, "once-out"), ingest.scratch_dir(spark, "once-state")
    run = ingest.gate_batches(spark.read.parquet(snap_dir), out, state)
    mem_rows(spark, []).write.mode("overwrite").parquet(snap_dir)             # gone
    run(spark.createDataFrame([(5, "p", "bug", "session", "use yarn")], "id bigint, project string, type string, source string, text string"), 0)
    assert [(r["status"], r["conflict_with"]) for r in spark.read.parquet(out).collect()] == [("conflict_detected", 1)]


def test_a_table_is_a_file_or_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"We use flask {i}", "en", "src1") for i in range(6)], "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    docs.repartition(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "file/documents.parquet")
    for kind in ("folder", "file"):
        got = ingest.streamed_gate(spark, str(tmp_path / kind)).collect()
        assert sorted(r["id"] for r in got) == list(range(6)), kind
