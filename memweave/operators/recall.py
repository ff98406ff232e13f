"""Recall: cosine top-k (T1), recall with citations (T2, D1), pattern recall
(T3), debug suggestions (T5, A7, U1), text recall and the vector index (S9, S10, A6, P8).

Plan: the metadata filter runs first (it reaches the Parquet scan).  Queries
are dealt to blocks and index rows to tiles by hashes, both of bounded sizes; each
(tile, block) pair is one group, whose score matrix is computed a slice of rows at a
time and pruned to the k best per query after each slice (ties broken by id, so the
union of local top-k sets holds the global top-k).  One shuffle on the query key
then keeps ``row_number() <= k``.  Nothing passes through the driver but two counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..session import ensure_checkpoint_dir

TILE_ROWS, BLOCK_QUERIES, SLICE_ROWS, FOUND_ROWS = 16384, 2048, 1024, 500_000


def vector_index(mem: DataFrame, embeddings: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Index rows for approved memories that have a vector:
    (id, document, project, type, source, embedding)."""
    vec = embeddings.select(F.col(id_col).alias("id"), "embedding")
    return (mem.filter(F.col("approved"))
            .select("id", F.col("summary").alias("document"), "project", "type", "source")
            .join(vec, "id"))


def label_centroids(embeddings: DataFrame) -> DataFrame:
    """One query per label: the mean vector (query_id = label)."""
    parts = embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return (means.groupBy("label")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
                 .alias("qvec"))
            .select(F.col("label").cast("bigint").alias("query_id"), "qvec"))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero, so that its cosine with anything is 0."""
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _leading(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each column; of equal ones the first rows.  No number counts least."""
    n = len(sims)
    if n <= k:
        return tuple(x.ravel() for x in np.indices(sims.shape))
    kth = np.partition(sims, n - k, axis=0)[n - k]
    kept = sims >= kth
    if np.count_nonzero(kept) > k * sims.shape[1]:
        over = sims > kth
        tied = kept & ~over
        kept = over | (tied & (np.cumsum(tied, axis=0) <= k - over.sum(axis=0)))
    return np.nonzero(kept)


def _best(found: list[tuple], k: int) -> tuple:
    """The k best rows of each (query, group); found: arrays of (query, group, score, id)."""
    of, group, score, ids = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -np.nan_to_num(score, nan=-np.inf), group, of))
    of, group, score, ids = of[order], group[order], score[order], ids[order]
    begins = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (group[1:] != group[:-1])])
    rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.r_[begins, len(of)]))
    return of[rank < k], group[rank < k], score[rank < k], ids[rank < k]


def best_pairs(rows: pd.DataFrame, queries: pd.DataFrame, parts, k: int) -> tuple:
    """Arrays (query's place, group, score, id): the k best cosines of each (query, group).

    parts: (group, places of its rows in the order of their ids, places of the queries that ask them); several parts may be of one
    group.  A slice of rows is scored and pruned at a time."""
    ids = rows["id"].to_numpy()
    vectors, asked = (_unit(np.stack(x.to_numpy()).astype(np.float64)) for x in (rows["embedding"], queries["qvec"]))
    found, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0
    for group, at, of in parts:
        q = asked[of].T
        for lo in range(0, len(at), SLICE_ROWS):
            part = at[lo: lo + SLICE_ROWS]
            sims = vectors[part] @ q
            row, col = _leading(np.nan_to_num(sims, nan=-np.inf), k)
            found.append((of[col], np.full(len(col), group), sims[row, col], ids[part[row]]))
            size += len(col)
            if size > FOUND_ROWS:
                found = [_best(found, k)]
                size = len(found[0][0]) // 2             # what stays may be much: pruned again at half as much more
    return _best(found, k)


def _scorer(k: int, group_col: str | None):
    names = ["query_id", "id", "score"] + ([group_col] if group_col else [])

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(queries) == 0:
            return pd.DataFrame({c: [] for c in names})
        codes, values = pd.factorize(rows[group_col]) if group_col else (np.zeros(len(rows), np.int64), None)
        order = np.lexsort((rows["id"].to_numpy(), codes))
        order = order[codes[order] >= 0]                 # rows without a group are in no one's list
        everyone = np.arange(len(queries))
        begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
        parts = ((codes[at[0]], at, everyone) for at in np.split(order, begins[1:]) if len(at))
        of, group, score, ids = best_pairs(rows, queries, parts, k)
        found = {"query_id": queries["query_id"].to_numpy()[of], "id": ids, "score": score}
        if group_col:
            found[group_col] = np.asarray(values)[group]
        return pd.DataFrame(found)[names]
    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = rules.RECALL_TOP_K,
          group_col: str | None = None, project: str | None = None, type_: str | None = None,
          types=None) -> DataFrame:
    """Exact cosine top-k per query (and per ``group_col`` value when given).

    queries: (query_id bigint, qvec array<double>).  Returns
    (query_id, id, score double unrounded, rank[, group_col]).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    idx = index
    if project:
        idx = idx.filter(F.col("project") == project)
    if type_:
        idx = idx.filter(F.col("type") == type_)
    if types:
        idx = idx.filter(F.col("type").isin(*types))
    group = [group_col] if group_col else []
    idx = idx.select("id", "embedding", *group).where("embedding is not null")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("score", T.DoubleType()),
                           *[T.StructField(c, idx.schema[c].dataType) for c in group]])
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "qvec").where("query_id is not null")
    tiles, blocks = (max(1, -(-df.count() // size)) for df, size in ((idx, TILE_ROWS), (queries, BLOCK_QUERIES)))
    rows = (idx.withColumn("_tile", F.pmod(F.xxhash64("id"), F.lit(tiles)))
            .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
             .withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))))
    scored = (rows.groupBy("_tile", "_block").cogroup(asked.groupBy("_t", "_b"))
              .applyInPandas(_scorer(k, group_col), schema))
    w = Window.partitionBy("query_id", *group).orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(mem: DataFrame, index: DataFrame, queries: DataFrame, k: int = rules.RECALL_TOP_K,
           project: str | None = None, type_: str | None = None) -> DataFrame:
    """Top-k hits with citations; hits whose memory is gone are dropped
    after the cut (so a query may return fewer than k)."""
    if type_ is not None and type_ not in rules.MEMORY_TYPES:
        raise ValueError(f"Invalid memory type '{type_}'")
    return cite(mem, top_k(index, queries, k, project=project, type_=type_))


def cite(mem: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with their memories' text and citation; hits without a memory are dropped."""
    return (hits.select("query_id", "rank", "id", "score").join(
        mem.select("id", F.col("summary"), "source", "project", "type", "created_at", "confidence", "related_files",
                   "tags", "so_url"), "id")
        .select("query_id", "rank", "id", "summary", F.round("score", 4).alias("score"), "source", "project", "type",
                "created_at", "confidence", "related_files", "tags", "so_url"))


def recall_patterns(mem: DataFrame, index: DataFrame, queries: DataFrame,
                    k: int = rules.RECALL_TOP_K, project: str | None = None) -> DataFrame:
    """Pattern memories with their source URL."""
    r = recall(mem, index, queries, k, project=project, type_="pattern")
    return r.select("query_id", "rank", "id", "summary", "score", "so_url", "confidence", "project",
                    F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


def debug_suggest(mem: DataFrame, index: DataFrame, queries: DataFrame,
                  k: int = rules.RECALL_TOP_K, project: str | None = None) -> DataFrame:
    """T5: top-k per type for bug/fix/pattern, cite (drop orphans), keep the best
    hit per id, then the top k by the score as shown (4 places), ties in the
    order bug, fix, pattern and within a type by rank.  so_url only on patterns."""
    if k < 1:
        raise ValueError("top_k must be at least 1.")
    per_type = top_k(index, queries, k, group_col="type", project=project, types=rules.DEBUG_TYPES)
    hits = (per_type.withColumnRenamed("rank", "trank").join(
        mem.select("id", "summary", "source", "confidence", "created_at", "so_url"), "id")
        .withColumn("score", F.round("score", 4))
        .withColumn("tpos", F.array_position(F.array(*map(F.lit, rules.DEBUG_TYPES)), F.col("type"))))
    order = [F.col("score").desc(), F.col("tpos"), F.col("trank"), F.col("id")]
    best = (hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*order)))
            .filter("_n = 1"))
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(
        F.col("rank") <= k)
    return top.select("query_id", "rank", "id", "type", "summary", "score", "source", "confidence",
                      F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
                      F.when(F.col("type") == "pattern", F.col("so_url")).alias("so_url"))


# ------------------------------------------------------------------ text recall
WORDS = r"[\p{L}\p{N}_]+"


def _counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): lower-case words of each text."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0))
    return texts.select(key, words.alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


BLOCK_POSTINGS, CHAMPIONS = 4096, 4
TILE_POSTINGS, ASKED_QUERIES = 200_000, 256


def _written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: computed once, small, and of a size that Spark knows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/text-{df.sparkSession.range(1).select(F.uuid()).first()[0]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _weights(searched: DataFrame, queries: DataFrame):
    """TF-IDF of both sides: postings (id, token, w, nw, df) of tokens that some query holds, where nw is w over the memory's
    length, and asked (query_id, token, qw, qsize)."""
    tf = _written(_counts(searched, "id", "summary"))                     # texts are read into words once
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = searched.agg(F.count(F.lit(1)).alias("n"))
    idf = _written(df.join(F.broadcast(total)).select(          # total: one row
        "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    weight = (1 + F.log("tf")) * F.col("idf")
    docs = tf.join(idf, "token").select("id", "token", "df", weight.alias("w"))
    size = docs.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    q = _counts(queries, "query_id", "text").join(idf, "token").select("query_id", "token", weight.alias("qw"))
    q = _written(q)
    qsize = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qsize"))
    postings = (docs.join(q.select("token").distinct(), "token", "left_semi").join(size, "id")
                .select("id", "token", "w", "size", (F.col("w") / F.col("size")).alias("nw"), "df"))
    return _written(postings), q.join(qsize, "query_id")


def _dots(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, id, score): whole cosines of the pairs (query_id, id), by (memory, token), so that no hot token is a key."""
    wanted = pairs.join(asked, "query_id")
    dot = (wanted.join(postings.select("id", "token", "w", "size"), ["id", "token"]).groupBy("query_id", "id")
           .agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("size").alias("size"), F.first("qsize").alias("qsize")))
    return dot.select("query_id", "id", (F.col("dot") / (F.col("size") * F.col("qsize"))).alias("score"))


def _sums(rows: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    """Whole cosines of the pairs of one tile of memories and one block of queries; ``other`` holds the pairs (token null) and the
    words that the queries ask."""
    asks, pairs = other[other["token"].notna()], other[other["token"].isna()]
    if len(rows) == 0 or len(asks) == 0 or len(pairs) == 0:
        return pd.DataFrame({"query_id": [], "id": [], "score": []})
    words, docs, queries = (pd.Index(x.unique()) for x in (asks["token"], rows["id"], asks["query_id"]))
    word, row, nw = words.get_indexer(rows["token"]), docs.get_indexer(rows["id"]), rows["nw"].to_numpy()
    order = np.argsort(word, kind="stable")
    ends = np.searchsorted(word[order], np.arange(len(words) + 1))
    of, col, q = words.get_indexer(asks["token"]), queries.get_indexer(asks["query_id"]), asks["q"].to_numpy()
    by_word = np.argsort(of, kind="stable")
    asked = np.searchsorted(of[by_word], np.arange(len(words) + 1))
    sums = np.zeros((len(docs), len(queries)))
    for w in range(len(words)):
        some, who = order[ends[w]: ends[w + 1]], by_word[asked[w]: asked[w + 1]]
        sums[np.ix_(row[some], col[who])] += np.outer(nw[some], q[who])
    at, by = docs.get_indexer(pairs["id"]), queries.get_indexer(pairs["query_id"])
    score = np.where((at >= 0) & (by >= 0), sums[at, by], 0.0)
    return pd.DataFrame({"query_id": pairs["query_id"].to_numpy(), "id": pairs["id"].to_numpy(), "score": score})[score > 0]


def _many_dots(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """As ``_dots``, where a query has many pairs: by (tile of memories, block of queries), both of bounded sizes, so that a pair is
    one row and not one for each word that its query asks."""
    tiles = max(1, -(-postings.count() // TILE_POSTINGS))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // ASKED_QUERIES))
    tile, block = F.pmod(F.xxhash64("id"), F.lit(tiles)), F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    each = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (tiles, blocks)}
    rows = postings.select(tile.alias("_tile"), each[blocks].alias("_block"), "id", "token", "nw")
    words = asked.select(each[tiles].alias("_t"), block.alias("_b"), "query_id", F.lit(0).cast("long").alias("id"), "token",
                         (F.col("qw") / F.col("qsize")).alias("q"))
    other = words.unionByName(pairs.select(tile.alias("_t"), block.alias("_b"), "query_id", "id", F.lit(None).cast("string").alias("token"),
                                           F.lit(0.0).alias("q")))
    return (rows.groupBy("_tile", "_block").cogroup(other.groupBy("_t", "_b"))
            .applyInPandas(lambda left, right: _sums(left, right), "query_id long, id long, score double"))


def _blocks(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The impact-ordered index: postings with (long, class, tile), and blocks (token, long, class, tiles, bound).

    ``long`` is the class of the memory's length and ``class`` that of the posting's weight, each within one factor of sqrt(2);
    a large block is dealt to tiles of about ``BLOCK_POSTINGS`` rows by the memory's id."""
    steps = [F.least(F.greatest(F.floor(2 * F.log2(x)), F.lit(0)), F.lit(63)).cast("int") for x in (F.col("size"), 1 / F.col("nw"))]
    classed = postings.withColumn("long", steps[0]).withColumn("class", steps[1])
    key = ["token", "long", "class"]
    blocks = (classed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("nw").alias("bound"), F.max("df").alias("df"))
              .withColumn("tiles", F.ceil(F.col("n") / BLOCK_POSTINGS)).drop("n").checkpoint())
    tiled = (classed.select("id", *key, "nw").join(blocks.select(*key, "tiles"), key)
             .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).drop("tiles"))
    return tiled, blocks


def _reached(pairs: DataFrame, by: str, n: int, asked: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query_id, least): a score that k memories reach: the k-th best whole cosine of a query's ``n`` best pairs by
    the column ``by``; no row for queries with fewer than k pairs."""
    best = Window.partitionBy("query_id").orderBy(F.col(by).desc(), "id")
    seeds = pairs.select("query_id", "id", by).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n)
    kth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    return (_dots(seeds.select("query_id", "id"), asked, postings).withColumn("_n", F.row_number().over(kth))
            .where(F.col("_n") == k).select("query_id", F.col("score").alias("least")))


def _thresholds(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, least): a first threshold from each token's heaviest memories."""
    by_weight = Window.partitionBy("token").orderBy(F.col("nw").desc(), "id")
    heavy = (postings.select("id", "token", "nw").withColumn("_n", F.row_number().over(by_weight))
             .where(F.col("_n") <= CHAMPIONS * k).drop("_n"))
    part = heavy.join(asked, "token").groupBy("query_id", "id").agg(F.sum(F.col("nw") * F.col("qw")).alias("part"))
    return _reached(part, "part", 2 * k, asked, postings, k)


def _matches(tiled: DataFrame, blocks: DataFrame, asked: DataFrame, least: DataFrame) -> DataFrame:
    """(query_id, id, gives, unread, rest, least): the postings that a query reads.

    Memories of one class of lengths have bounds of their own.  A query's tokens are taken from the most frequent to the
    rarest.  A memory that reaches ``least`` has a last token of this order; all before it give at most the sum of
    their bounds, so that this posting alone has to give the difference.  So a query reads of each token only the
    blocks that hold such weights: few of frequent tokens, all of rare ones.  ``unread`` is the most that an unread posting of
    the token could give, ``rest`` the sum over the query's tokens.
    """
    tops = blocks.groupBy("token", "long").agg(F.max("bound").alias("top"), F.max("df").alias("df"))
    group = Window.partitionBy("query_id", "long")
    before = group.orderBy(F.col("df").desc(), "token").rowsBetween(Window.unboundedPreceding, -1)
    q = F.col("qw") / F.col("qsize")
    most = q * F.col("top")                                                # the most that a token can give
    slack = 1e-8                                                           # scores are rounded to 9 places
    need = (asked.join(tops, "token").join(least, "query_id", "left")
            .withColumn("least", F.coalesce(F.col("least") - slack, F.lit(0.0)))
            .withColumn("need", F.col("least") - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
            .withColumn("unread", F.greatest(F.least(most, F.col("need")), F.lit(0.0)))
            .withColumn("rest", F.sum("unread").over(group)))
    asks = (need.join(blocks.select("token", "long", "class", "tiles", "bound"), ["token", "long"])
            .where(q * F.col("bound") >= F.col("need"))
            .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
            .select("query_id", "token", "long", "class", "tile", "need", "unread", "rest", "least", q.alias("q")))
    gives = F.col("q") * F.col("nw")
    return (tiled.join(asks, ["token", "long", "class", "tile"]).where(gives >= F.col("need"))
            .select("query_id", "id", gives.alias("gives"), "unread", "rest", "least"))


def _hopeful(read: DataFrame, asked: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query_id, id): what may still be among the k best: read weights and all that unread ones could add reach the threshold,
    also the closer one of the memories whose read weights alone are best."""
    sums = (read.groupBy("query_id", "id")
            .agg(F.sum("gives").alias("sure"), (F.sum(F.col("gives") - F.col("unread")) + F.first("rest")).alias("most"),
                 F.first("least").alias("least")).where("most >= least").drop("least").checkpoint())
    closer = _reached(sums, "sure", CHAMPIONS * k, asked, postings, k)
    return (sums.join(closer, "query_id", "left").where("least is null or most >= least - 1e-8").select("query_id", "id"))


def recall_text(mem: DataFrame, queries: DataFrame, k: int = rules.RECALL_TOP_K, project: str | None = None,
                type_: str | None = None) -> DataFrame:
    """T2 from query texts: (query_id, text) -> cited top k of the approved memories.

    Score: cosine of TF-IDF vectors, weight (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1) with N and df over the
    approved memories searched.  Exact, by max-score pruning over an impact-ordered index: k scores that are reached for
    certain bound what a query has to read (``_thresholds``, ``_matches``) and which memories' whole cosines
    are taken (``_hopeful``).  Memories sharing no token have
    score 0 and are no hits.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    searched = mem.filter(F.col("approved"))
    if project:
        searched = searched.filter(F.col("project") == project)
    if type_:
        searched = searched.filter(F.col("type") == type_)
    postings, asked = _weights(searched, queries)
    tiled, blocks = _blocks(postings)
    read = _matches(tiled, blocks, asked, _thresholds(postings, asked, k))
    scored = _many_dots(_hopeful(read, asked, postings, k), asked, postings).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return cite(mem, scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
