"""Exact top-k inner products by norm-bucketed retrieval.

Method: vectors are grouped by length into buckets whose lengths differ by at
most a tenth, large buckets into tiles by a hash.  A query starts with a lower bound of its
k-th score, from the longest vectors of all.  In each bucket, that bound
divided by the query's and the bucket's lengths is a local cosine threshold.
Above 1 the bucket is passed over; if it is high, vectors are pruned by coordinates (on the
query's largest coordinates, a vector within the angle must lie in an interval); if it is low,
by length alone.  What is left is verified with exact integer products, and the bound rises.

The stated query set meets all tiles in blocks; a block and a tile have bounded sizes.

Components are floor(256 * x) as integers, held within +-2**62.  Products are taken in doubles where these are exact, in
64-bit integers where these can't overflow, and else in integers of any size; scores are held within 64 bits.

Defined results: vectors that are null, or hold null or non-finite components, or have no
vec_id, take no part.  Only vectors of one dimension are compared.  A query's own vec_id is no
candidate.  Candidate rows that repeat (vec_id and vector) count as often as they occur; a query id
that occurs with several vectors asks with each of them once, and gets the best of all.  Fewer than k candidates: all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEEDS, TILE, QUERY_BLOCK, STEP = 1024, 8192, 2048, 1024
FOCUS, COORDINATES_FROM = 6, 0.3
LIMIT = float(1 << 62)
EPS = 1e-9


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<long>, dim, bucket (of the length; -1 for zero): the vectors that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double"))
                                     | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(256 * c.cast("double"), F.lit(-LIMIT)), F.lit(LIMIT))))
    v = (vectors.where(good & F.col("vec_id").isNotNull())
         .select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<bigint>").alias("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return v.withColumn("dim", F.size("v")).withColumn("square", square).withColumn(
        "bucket", F.when(F.col("square") > 0, F.floor(F.log("square") / (2 * float(np.log(1 / 0.9))))).otherwise(-1)
        .cast("int"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class _Tile:
    """The vectors of a tile, longest first, and one query's search in them."""

    def __init__(self, ids, v):
        length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.where(self.length[:, None] > 0, self.v / self.length[:, None], 0.0)
        self.fast = float(np.abs(v).max(initial=0)) * v.shape[1]
        self.real = self.v.astype(np.float64)

    def search(self, qid: int, q: np.ndarray, bound, k: int):
        """(ids, scores) of the best k whose scores are no less than ``bound`` (None: any)."""
        size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        unit = q / size if size else np.zeros(len(q))
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        most = self.fast * float(np.abs(q).max(initial=0))
        real = q.astype(np.float64)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, len(self.ids), STEP):
            hi = min(lo + STEP, len(self.ids))
            at = slice(lo, hi)
            if bound is not None and bound > 0:
                top = size * self.length[lo]
                cosine = bound / top if top else 2.0
                if cosine > 1 + EPS:                      # lengths only fall from here
                    break
                if cosine >= COORDINATES_FROM:
                    at = self._by_coordinates(lo, hi, unit, focus, min(1.0, cosine - EPS))
                else:
                    at = slice(lo, lo + int(np.searchsorted(-self.length[lo:hi], -(bound / size) * (1 - EPS),
                                                            side="right")))
            if most < 2.0 ** 53:
                got = (self.real[at] @ real).astype(np.int64)
            elif most < 2.0 ** 62:
                got = self.v[at] @ q
            else:
                whole = self.v[at].astype(object) @ q.astype(object)
                got = np.array([min(max(x, -1 << 63), (1 << 63) - 1) for x in whole], np.int64)
            mine = self.ids[at]
            keep = mine != qid
            if bound is not None:
                keep &= got >= bound
            if not keep.any():
                continue
            ids, scores = np.append(ids, mine[keep]), np.append(scores, got[keep])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                bound = int(scores[-1]) if bound is None else max(bound, int(scores[-1]))
        return ids, scores

    def _by_coordinates(self, lo: int, hi: int, unit, focus, cosine: float) -> np.ndarray:
        angle = np.arccos(cosine)
        at = np.arange(lo, hi)
        for f in focus:
            own = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - EPS, np.cos(max(0.0, own - angle)) + EPS
            c = self.unit[at, f]
            at = at[(c >= low) & (c <= high)]
        return at


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; ``vectors`` and ``queries`` hold vec_id and embedding."""
    spark = vectors.sparkSession
    # equal rows once, with how often they occur; more than k + 1 of them can't matter
    held = cut(quantized(vectors).groupBy("vec_id", "v", "dim", "square", "bucket").agg(F.count("*").alias("times")))
    asked = quantized(queries).select("vec_id", "v", "dim").distinct()
    dims = [r["dim"] for r in held.select("dim").distinct().limit(1000).collect()]
    longest = {}
    for d in dims:      # as a rule one
        rows = held.where(F.col("dim") == d).orderBy(F.desc("square"), "vec_id").limit(SEEDS).collect()
        longest[d] = (np.array([r["vec_id"] for r in rows], np.int64),
                      np.array([r["v"] for r in rows], np.int64).reshape(len(rows), d))
    seeds = spark.sparkContext.broadcast(longest)       # at most SEEDS vectors a dimension

    def bounds(batches):
        tiles = {d: _Tile(*x) for d, x in seeds.value.items()}
        for b in batches:
            out = []
            for qid, q in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                tile = tiles.get(len(q))
                _, s = tile.search(qid, np.array(q, np.int64), None, k) if tile else ([], [])
                out.append(int(s[k - 1]) if len(s) >= k else None)
            yield b.append_column("bound", pa.array(out, pa.int64()))

    asked = cut(asked.mapInArrow(bounds, "vec_id long, v array<long>, dim int, bound long"))
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    keys = ["dim", "bucket", "tile", "qb"]
    tiles = held.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    pieces = (held.join(tiles, ["dim", "bucket"])
              .withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.col("tiles")).cast("int"))
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    spread = (tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .join(asked, "dim").select(*[F.col(c).alias(f"of_{c}") for c in keys], "vec_id", "v", "bound"))

    def cell(key, cands, qs):
        out = ([], [], [])
        if cands.num_rows and qs.num_rows:
            dim = key[0].as_py()
            ids, times = cands.column("vec_id").to_numpy(), cands.column("times").to_numpy()
            v = _matrix(cands.column("v"), dim)
            again = np.repeat(np.arange(len(ids)), np.minimum(times, k))
            tile = _Tile(ids[again], v[again])
            qv = _matrix(qs.column("v"), dim)
            for qid, q, bound in zip(qs.column("vec_id").to_pylist(), qv, qs.column("bound").to_pylist()):
                got, scores = tile.search(qid, q, bound, k)
                out[0].extend([qid] * len(got))
                out[1].extend(got.tolist())
                out[2].extend(scores.tolist())
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out)})

    found = (pieces.select(*keys, "vec_id", "v", "times").groupBy(*keys).cogroup(spread.groupBy(*[f"of_{c}" for c in keys]))
             .applyInArrow(cell, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, e.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
