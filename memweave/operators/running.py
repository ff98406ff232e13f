"""Running numbers and sums within keys, for keys of any size (segmented prefix sums).

A window over one key puts all of its rows into one task.  Here rows are sorted by *ranges* of (key, order), so
that a key with a third of all rows spans as many partitions as it needs.  Every partition numbers and sums its own
rows in one streaming pass; what the partitions before hold of a key that spans several is added from
a table of at most two rows a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import ensure_checkpoint_dir


def _key_starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has another key than the row before it (nulls are equal)."""
    out = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return out


def _adder(keys: list[str], sums: list[str], number: str):
    def run(batches):
        part, last, totals = TaskContext.get().partitionId(), None, [0] * (len(sums) + 1)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cols = [batch.column(k) for k in keys]
            new = np.ones(n, bool)
            new[1:] = _key_starts(cols)
            here = [c[0].as_py() for c in cols]
            new[0] = here != last
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))       # -1: the key of the batch before
            values = [np.ones(n, np.int64)] + [batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in sums]
            out = []
            for j, v in enumerate(values):
                total = np.cumsum(v)
                before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
                got = total - before + np.where(first < 0, totals[j], 0)
                totals[j] = int(got[-1])
                out.append(pa.array(got))
            last = [c[n - 1].as_py() for c in cols]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), *out],
                                             names=[*batch.schema.names, "_part", number, *[f"run_{s}" for s in sums]])
    return run


def running(df: DataFrame, keys: list[str], order: list[Column], sums: list[str] = (), number: str = "row_no") -> DataFrame:
    """``df`` with ``row_no`` (1, 2, ... within the key, by ``order``) and ``run_<s>``, the sum of the long column ``s``
    up to and including the row.

    Rows equal in key and order come in any order (null sums count 0).  The result is checkpointed: its numbers
    do not change if executors are lost.  Columns of ``df`` must not be called ``_part`` or ``_tie``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sums = list(sums)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())     # splits rows that are equal in key and order
    for s in sums:
        tied = tied.withColumn(s, F.coalesce(F.col(s).cast("long"), F.lit(0).cast("long")))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("_tie")]
    ordered = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    schema = StructType([*ordered.schema.fields, StructField("_part", IntegerType()), StructField(number, LongType()),
                         *[StructField(f"run_{s}", LongType()) for s in sums]])
    local = ordered.mapInArrow(_adder(list(keys), sums, number), schema).checkpoint()
    names = [number, *[f"run_{s}" for s in sums]]
    key = F.struct(*keys).alias("_key")
    whole = local.groupBy(key, "_part").agg(F.max(F.struct(number, *names[1:])).alias("t"))
    spread = whole.groupBy("_key").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).where("lo < hi")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition shares at most its first and its last key with others: the table is bounded by their number
    spans = whole.join(F.broadcast(spread.select(F.col("_key").alias("_k"))), F.col("_key").eqNullSafe(F.col("_k"))).select(
        F.col("_key").alias("_k"), F.col("_part").alias("_p"), *[F.sum(f"t.{n}").over(before).alias(f"_b_{n}") for n in names])
    return local.join(F.broadcast(spans), (F.col("_part") == F.col("_p")) & key.eqNullSafe(F.col("_k")), "left").select(
        *df.columns, *[(F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in names])
