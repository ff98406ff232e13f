"""Access to the input tables (one Parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


SPREAD = "spark.memweave.source.spread"     # session setting: tasks that rows of texts are dealt to (if unset, see needed_spread)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """A table; with ``spread``, its rows are dealt to that many tasks.

    One row group is one task, whatever its size: a table written as a few large ones keeps all
    expensive expressions on few cores.  Tables of many row groups need no spread."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df if spread is None else df.repartition(spread)


ROWS_PER_TASK = 5_000                       # texts that a task gets where a table is dealt because its own tasks are uneven


def spread_of(spark: SparkSession) -> int | None:
    """The session's spread for texts (``spark.memweave.source.spread``), None where it is unset."""
    value = spark.conf.get(SPREAD, None)
    return int(value) if value else None


def needed_spread(df: DataFrame) -> int | None:
    """The tasks to deal a table to, where one task of its own would read over one and a half times a core's share of the rows (a row
    group is one task at least); None where its tasks are even or its rows few.  Counts rows per task; no column is read for it."""
    per_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    rows, most = per_task.agg(F.sum("n"), F.max("n")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if (rows or 0) <= ROWS_PER_TASK or 2 * cores * most <= 3 * rows:
        return None
    return max(cores, -(-rows // ROWS_PER_TASK))


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt as the session sets it; where that is unset, evenly if its own tasks are not."""
    df = read_table(spark, sf_dir, name)
    spread = spread_of(spark) or needed_spread(df)
    return df if spread is None else df.repartition(spread)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .memories import memories_from_documents
    return memories_from_documents(texts(spark, sf_dir))
