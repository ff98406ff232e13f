"""Approximate recall (T1): an inverted-file index of clustered lists, written as partitions that a search prunes.

Fit: k-means over the unit vectors of a bounded sample (``SAMPLE_ROWS`` rows, taken by a hash of the id) gives the
centres of ``lists`` lists, about the square root of the row count and ``MAX_LISTS`` at most.  Build: every row goes to the list of
its nearest centre, and the lists are written as Parquet partitions; a list with many rows spans many files and tasks.
Search: a query asks the ``probes`` lists nearest to it.  Only asked lists are scanned (their numbers, at most
``MAX_LISTS``, prune the partitions), each row once.  Neighbouring lists stand on one shelf, of about ``TILE_ROWS`` rows or one large
list; a query is sent once to each shelf where it asks lists, with their numbers.  Shelves meet their queries in (shelf, tile, block)
groups of bounded sizes, where each list is scored exactly for those who ask it.  What is lost are neighbours in lists that were not asked: ``quality`` measures that against exact search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recall import BLOCK_QUERIES, TILE_ROWS, _unit, best_pairs, top_k

SAMPLE_ROWS, MAX_LISTS, ITERATIONS, SEED = 100_000, 4096, 12, 17


def _usable(index: DataFrame) -> DataFrame:
    """Rows with a whole vector; others can't be searched."""
    return index.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def _unit_column(c: str):
    size = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def fit_centres(index: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres (lists, dims) from a sample of at most about ``sample_rows`` rows; no rows: no centres."""
    rows = _usable(index)
    n = rows.count()
    if n == 0:
        return np.zeros((0, 0))
    k = max(1, min(lists or math.ceil(math.sqrt(n)), MAX_LISTS, n))
    share = int(min(1.0, sample_rows / n) * 1_000_000)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < share).select(
        array_to_vector(_unit_column("embedding")).alias("features")).checkpoint()
    model = KMeans(k=k, seed=SEED, maxIter=ITERATIONS, initMode="random").fit(sample)
    return np.array(model.clusterCenters())


def _nearest(centres: np.ndarray, probes: int):
    """vectors -> the numbers of their nearest centres, nearest first."""
    half = (centres ** 2).sum(axis=1) / 2

    def of(vectors) -> np.ndarray:
        near = _unit(np.stack(vectors).astype(np.float64)) @ centres.T - half
        best = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1)
    return of


def build(index: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Write the index (id, embedding) under ``path``, one partition a list; returns the centres."""
    spark = index.sparkSession
    centres = fit_centres(index, lists, sample_rows)
    rows = _usable(index).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    held = spark.sparkContext.broadcast(centres)            # at most MAX_LISTS vectors

    def assign(batches):
        of = _nearest(held.value, 1) if len(held.value) else None
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=of(pdf["embedding"])[:, 0].astype(np.int32))
    # by ranges of (list, id): a long list is many sorted files, a short one shares its task
    (rows.mapInPandas(assign, "id long, embedding array<float>, list int").repartitionByRange("list", "id")
     .write.mode("overwrite").partitionBy("list").parquet(path))
    return centres


SENT_ROWS = 8192         # rows (a query and a shelf) that a task makes at a time


def _shelves(spark: SparkSession, path: str, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's shelf and each shelf's number of tiles, from the lists' sizes (at most ``MAX_LISTS`` numbers)."""
    sizes = np.zeros(lists, np.int64)
    for r in spark.read.schema("list int").parquet(path).groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    shelf, rows = np.zeros(lists, np.int32), []
    for i, n in enumerate(sizes):
        if not rows or rows[-1] + n > TILE_ROWS:
            rows.append(0)
        shelf[i] = len(rows) - 1
        rows[-1] += n
    return shelf, np.array([max(1, -(-n // TILE_ROWS)) for n in rows])


def _shelf_scorer(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(queries) == 0:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        asks = queries["lists"].to_numpy()
        asked, of = np.concatenate(asks), np.repeat(np.arange(len(queries)), [len(x) for x in asks])
        by_list = np.argsort(asked, kind="stable")
        asked, of = asked[by_list], of[by_list]
        held = rows["list"].to_numpy()
        order = np.lexsort((rows["id"].to_numpy(), held))
        begins = np.flatnonzero(np.diff(held[order], prepend=-1))
        parts = ((0, at, of[slice(*np.searchsorted(asked, (held[at[0]], held[at[0]] + 1)))]) for at in np.split(order, begins[1:]))
        of, _, score, ids = best_pairs(rows, queries, parts, k)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[of], "id": ids, "score": score})
    return run


def search(spark: SparkSession, path: str, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, id, score, rank): the best k rows of the ``probes`` lists nearest to each query."""
    schema = "query_id long, id long, score double"
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be at least 1")
    if len(centres) == 0:
        return spark.createDataFrame([], schema + ", rank int")
    probes = min(probes, len(centres))
    shelf_of, tiles_of = _shelves(spark, path, len(centres))
    held = spark.sparkContext.broadcast((centres, shelf_of))

    def ask(batches):
        all_centres, shelves = held.value
        of, step = _nearest(all_centres, probes), max(1, SENT_ROWS // (int(shelves.max()) + 1))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                some = pdf.iloc[lo: lo + step]
                got = np.sort(of(some["qvec"]), axis=1).astype(np.int32)           # a shelf's lists are neighbours
                cuts = np.flatnonzero(np.diff(shelves[got], axis=1, prepend=-1).ravel())
                whose = cuts // probes
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[whose], "shelf": shelves[got].ravel()[cuts],
                                    "lists": np.split(got.ravel(), cuts[1:]), "qvec": some["qvec"].to_numpy()[whose]})
    asked = queries.where("qvec is not null and query_id is not null").select(
        F.col("query_id").cast("long").alias("query_id"), "qvec").mapInPandas(
        ask, "query_id long, shelf int, lists array<int>, qvec array<double>").checkpoint()
    wanted = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]            # at most MAX_LISTS numbers
    rows = spark.read.schema("id long, embedding array<float>, list int").parquet(path).where(F.col("list").isin(wanted))
    lists = spark.createDataFrame([(i, int(s), int(tiles_of[s])) for i, s in enumerate(shelf_of)], "list int, shelf int, tiles long")
    blocks = asked.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    grid = lists.join(blocks, "shelf")                                             # one row a list
    left = (rows.join(F.broadcast(grid), "list").withColumn("_tile", F.pmod(F.xxhash64("id"), "tiles"))
            .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    right = (asked.join(F.broadcast(grid.select("shelf", "tiles", "blocks").distinct()), "shelf")
             .withColumn("_b", F.pmod(F.xxhash64("query_id"), "blocks"))
             .withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
    found = (left.select("shelf", "_tile", "_block", "list", "id", "embedding").groupBy("shelf", "_tile", "_block")
             .cogroup(right.select("shelf", "_t", "_b", "lists", "query_id", "qvec").groupBy("shelf", "_t", "_b"))
             .applyInPandas(_shelf_scorer(k), schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def quality(found: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: queries, and the share of the exact top k that ``found`` holds (ties at the k-th score count by score)."""
    exact = top_k(_usable(index), queries, k)
    least = exact.groupBy("query_id").agg(F.min(F.round("score", 9)).alias("least"), F.count("*").alias("n"))
    hits = (found.join(least, "query_id").where(F.round("score", 9) >= F.col("least")).groupBy("query_id", "n")
            .agg(F.count("*").alias("hits")))
    return least.join(hits, ["query_id", "n"], "left").agg(
        F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")) / F.sum("n")).alias("recall"))


def share_read(spark: SparkSession, path: str, centres: np.ndarray, queries: DataFrame, probes: int) -> float:
    """The share of all (query, row) pairs that a search scores."""
    sizes = {r["list"]: r["n"] for r in spark.read.schema("id long, embedding array<float>, list int").parquet(path)
             .groupBy("list").agg(F.count("*").alias("n")).collect()}              # at most MAX_LISTS rows
    held = spark.sparkContext.broadcast((centres, np.array([sizes.get(i, 0) for i in range(len(centres))])))
    probes = min(probes, len(centres))

    def count(batches):
        all_centres, n = held.value
        of = _nearest(all_centres, probes)
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"read": n[of(pdf["qvec"])].sum(axis=1)})
    got = queries.where("qvec is not null").select("qvec").mapInPandas(count, "read long").agg(F.sum("read"), F.count("*")).first()
    return (got[0] or 0) / max(1, (got[1] or 0) * sum(sizes.values()))


def calibrate(index: DataFrame, centres: np.ndarray, k: int, target: float = 0.94, sample: int = 400) -> int:
    """The least number of probes that finds ``target`` of the exact top k of ``sample`` index rows taken as queries.

    Where vectors form no clusters many lists are needed, and the index saves little; ``share_read`` tells.
    """
    rows = _usable(index)
    n = rows.count()
    if n == 0 or len(centres) == 0:
        return 1
    share = max(1, int(min(1.0, sample / n) * 1_000_000))
    own = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1_000_000)) < share).limit(2 * sample)
    asked = own.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qvec")).checkpoint()
    near = top_k(rows, asked, k + 1).where("query_id <> id").join(rows.select("id", "embedding"), "id").join(asked, "query_id")
    got = near.select("qvec", "embedding").collect()                               # 2 * sample * (k + 1) rows at most
    if not got:
        return len(centres)
    ranked, nearest, at = _nearest(centres, len(centres)), _nearest(centres, 1), []
    for lo in range(0, len(got), 500):                                             # all ranks of some rows at a time
        some = got[lo: lo + 500]
        at.append((ranked([r["qvec"] for r in some]) == nearest([r["embedding"] for r in some])).argmax(axis=1))
    at = np.sort(np.concatenate(at))
    return int(at[min(len(at) - 1, math.ceil(target * len(at)) - 1)]) + 1
