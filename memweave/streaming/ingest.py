"""Structured Streaming ingest (R1 streaming gate, R2 streaming session archive).

R1: records arrive as files; the stateless part of the gate (type check,
redact, scan, confidence) is a plain projection, and each micro-batch runs the
conflict check inside ``foreachBatch``.  The approved snapshot is reduced once, to the first record
per (project, type) and rule side or technology set; a batch reads this small table, never the
snapshot's texts.  In mode ``auto`` the records that a batch stores are candidates of later ones:
batch n reads version n - 1 of their reduced table and writes version n, the minimum of both per key.
Each batch writes its result to ``<out>/batch_id=<n>`` and its version with overwrite, so a batch
replayed after a failure replaces its own output and reads what it read before (exactly-once effect
with the checkpointed source offsets).  The streamed result equals the batch gate (in ``auto``: of
records that arrive in id order).

R2: session texts are appended as JSON lines partitioned by project and date
by the file sink, whose commit log makes the output exactly-once.

Paths default to folders under the session's ``spark.checkpoint.dir``, which a
cluster must set to a shared folder (``memweave.session`` raises where it is unset).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.conflicts import first_records, merged_records, stored_records
from ..operators.gate import gate
from ..operators.summarize import archive_rows
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table, table_path


def scratch_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the files of a table, which is a folder or one file (schema taken from a batch read)."""
    path = table_path(sf_dir, name)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(sf_dir)     # a stream reads folders only


GATE_COLUMNS = ("id", "project", "type", "source", "status", "reason", "confidence", "clean_text",
                "conflict_with", "conflict_rule")


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def gate_batches(snapshot: DataFrame, out_dir: str, state_dir: str, mode: str = "approval_required"):
    """The function (batch, batch id) that runs the gate over one micro-batch.

    The reduced snapshot lies in ``state_dir/snapshot``.  In ``auto`` it is written once per state folder, so that replayed
    batches see what they saw; in the other modes at every start, so that a restart sees newly approved records.
    ``state_dir/batch=<n>`` holds the first records of all that batches 0 to n have stored (``auto`` only; a few rows per project,
    type and rule or technology set; versions older than the last two are not read again).
    """
    spark = snapshot.sparkSession
    base = os.path.join(state_dir, "snapshot")
    if mode != "auto" or not _complete(spark, base):
        first_records(snapshot.filter(F.col("approved"))).write.mode("overwrite").parquet(base)
    schema = spark.read.parquet(base).schema

    def version(batch_id: int) -> str:
        return os.path.join(state_dir, f"batch={batch_id}")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        read = batch.sparkSession.read.schema(schema)
        before = [read.parquet(version(batch_id - 1))] if mode == "auto" and batch_id > 0 else []
        first = merged_records(read.parquet(base), *before)
        out = os.path.join(out_dir, f"batch_id={batch_id}")
        gated = gate(batch, None, mode=mode, first=first).select(*GATE_COLUMNS)
        gated.write.mode("overwrite").parquet(out)
        if mode == "auto":
            stored = batch.sparkSession.read.schema(gated.schema).parquet(out).where("status = 'stored'")
            merged_records(stored_records(stored, batch_id), *before).write.mode("overwrite").parquet(version(batch_id))

    return per_batch


def start_gate_stream(records: DataFrame, snapshot: DataFrame, out_dir: str, checkpoint_dir: str,
                      mode: str = "approval_required", available_now: bool = True) -> StreamingQuery:
    """Run the gate per micro-batch; results land in ``out_dir/batch_id=n``, its state beside the checkpoint."""
    per_batch = gate_batches(snapshot, out_dir, checkpoint_dir.rstrip("/") + ".candidates", mode)
    writer = records.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_archive_stream(sessions: DataFrame, out_dir: str, checkpoint_dir: str,
                         captured_at=None, available_now: bool = True) -> StreamingQuery:
    """R2: append archive rows (project, date, captured_at, text) partitioned by project/date."""
    rows = archive_rows(sessions, captured_at=captured_at)
    writer = (rows.writeStream.format("json").partitionBy("project", "date")
              .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def finished(query: StreamingQuery) -> None:
    """Wait until the query has read all that there is; raises what it failed with."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def streamed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run R1 over the documents folder (as a stream) and return what the sinks hold."""
    from ..sources.memories import incoming_from_memories, memories_from_documents

    snapshot = memories_from_documents(read_table(spark, sf_dir, "documents"))
    stream = incoming_from_memories(memories_from_documents(
        read_table_stream(spark, sf_dir, "documents")))
    out, ck = scratch_dir(spark, "gate-out"), scratch_dir(spark, "gate-ck")
    finished(start_gate_stream(stream, snapshot, out, ck))
    return spark.read.parquet(out).drop("batch_id")


def streamed_archive(spark: SparkSession, sf_dir: str, captured_at=None) -> DataFrame:
    """Run R2 over whole conversations: turns are assembled per session in a batch
    step (a session needs all its turns), then appended through the file sink."""
    from ..operators.summarize import sessions_from_turns

    sessions = (sessions_from_turns(read_table(spark, sf_dir, "conversations"))
                .withColumn("project", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))))
    staged = scratch_dir(spark, "sessions")
    sessions.write.mode("overwrite").parquet(staged)
    stream = spark.readStream.schema(spark.read.parquet(staged).schema).parquet(staged)
    out, ck = scratch_dir(spark, "archive-out"), scratch_dir(spark, "archive-ck")
    finished(start_archive_stream(stream, out, ck, captured_at=captured_at))
    return spark.read.schema("text string, captured_at string, project string, date string").json(out)
