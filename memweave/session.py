"""Spark session helpers.

The library never creates its own storage outside what the session names:
lineage is cut with ``DataFrame.checkpoint()`` into ``spark.checkpoint.dir``,
a folder that the driver and all executors share.  Where it is unset, a scratch folder
stands in for local masters only; on a cluster that is an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "memweave",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a scratch one only where it is unset on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="memweave-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet, once, to be read again.  Unlike a checkpoint, a later step reads only
    the columns that it needs, so that whole texts are not read where none is asked for."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    void = {f.name for f in df.schema if isinstance(f.dataType, NullType)}          # Parquet has no such type
    held = df.drop(*void)
    held.write.parquet(path)
    out = spark.read.schema(held.schema).parquet(path)
    return out.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns])


ARROW_ROWS = "1000"      # rows are whole texts: 10,000 of them, Spark's default, take tens of MB per task and buffer


# Python workers live on between tasks and stages.  By default their allocators keep freed arrays of up to 32 MB each for
# later (the C library raises its thresholds as arrays are freed, Arrow has a pool of its own), so that every worker
# comes to hold the most that any of its tasks took.  With fixed thresholds large arrays go back as they are freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2",
                 "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession, give_back: bool = False) -> SparkSession:
    """Set the checkpoint folder, bound Arrow batches, and let Python workers import this package from
    where the driver has it.  ``give_back``: workers return what they free (for jobs of many stages, at some CPU time)."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items() if give_back else ():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark
