"""Language-model scoring by cross-entropy difference.

Method: two interpolated bigram models, of a target corpus and of the whole
background, are counted over all documents with one shared vocabulary (all words of the
corpus, and one class for any other) and equal weights:

    p(w | v) = 0.6 c(v w) / c(v) + 0.3 c(w) / N + 0.1 / V

(the first term's weight goes to the second where v never stood).  Every text
opens with a start mark, which is only a history, and closes with an end mark, which is a token.
A document's score is the mean over its tokens of target loss minus background loss,
in nats: the lower, the closer to the target.

Texts are dealt to blocks by a hash of the doc_id.  A block packs the distinct n-grams that it
holds, with its counts, by shard of their hash; a shard sums them over all blocks and sends back
to each block only what other blocks hold too; the block then scores its own texts.  A frequent
n-gram so costs one entry per block, and no model is held whole anywhere.

Defined results: a null or empty text (or one without words) has the end mark as its only
token and is scored like others.  A null doc_id is never target.  Every input row gives one row;
rows that repeat a doc_id share its block.  Labels that disagree count as target if any says so.
Without target documents all target counts are 0.  N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_strings, mix64

BLOCK_BYTES = 16 << 20
PIECE_ROWS, PIECE_TOKENS = 2000, 1 << 18     # texts split, and tokens scored, at a time
WEIGHTS = (0.6, 0.3, 0.1)
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
ONE = np.uint64(1)


def _ranked(a: np.ndarray):
    """Distinct values in order, how often each occurs, and the order and place of every value among them."""
    order = np.argsort(a)
    a = a[order]
    first = np.append(True, a[1:] != a[:-1])[: len(a)]
    at = np.empty(len(a), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    lo = np.flatnonzero(first)
    return a[lo], np.diff(np.append(lo, len(a))), order, at


def _tokens(texts: pa.ChunkedArray):
    """The distinct words' hashes, END last (a word may occur in more places than one), the place of every token among them, each text
    closed by END, and lengths (end mark included).  Arrow splits and numbers the words of some texts at a time; Python sees distinct ones."""
    known, at, sizes, n = [], [], [], 0
    for batch in pa.table([texts], ["text"]).combine_chunks().to_batches(max_chunksize=PIECE_ROWS):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(0), "")))
        numbered = split.flatten().dictionary_encode()
        distinct = byte_strings(numbered.dictionary)
        known.append(np.array(list(map(xxhash.xxh3_64_intdigest, distinct)), np.uint64))
        here, ends = numbered.indices.to_numpy(), np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
        if b"" in distinct:                                # stands where a text begins or ends with a blank
            known[-1][distinct.index(b"")] = END           # no word of its own
            word = here != distinct.index(b"")
            ends, here = np.append(0, np.cumsum(word))[ends], here[word]
        at.append(np.insert(here + np.int32(n), ends, -1))
        sizes.append(np.diff(ends, prepend=0) + 1)
        n += len(distinct)
    out = np.concatenate([*at, np.zeros(0, np.int32)])
    out[out < 0] = n
    sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
    return np.concatenate([*known, np.array([END])]), out, sizes


def _grams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of the bigram that each token ends (even)."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return mix64(mix64(before) ^ tokens) & ~ONE


def _packed(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    wide = a.dtype.itemsize
    return bytes([wide]) + zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, wide).T).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view({4: np.uint32, 8: np.uint64}[b[0]]).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their distances."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _keys_of(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b), dtype=np.uint64)


ROW = "block int, shard int, keys binary, target binary, every binary"


def _counted(table: pa.Table, targets: set):
    """Ids, lengths, keys in order (of unigrams odd, of bigrams even), the place of each token's unigram and bigram
    among them, and counts in target and background."""
    ids = table.column("doc_id").to_pylist()
    words, at, sizes = _tokens(table.column("text"))
    starts = np.cumsum(sizes) - sizes
    marked = np.repeat(np.array([i in targets for i in ids], bool), sizes)
    uni, _, _, place = _ranked(mix64(words) | ONE)
    bi, every, order, b = _ranked(_grams(words[at], starts))
    hit = np.add.reduceat(marked[order], np.cumsum(every) - every, dtype=np.int64) if len(bi) else every
    u = place[at]
    del at, order, words
    # two ascending lists become one
    at_uni = np.arange(len(uni)) + np.searchsorted(bi, uni)
    at_bi = np.arange(len(bi)) + np.searchsorted(uni, bi)
    keys = np.empty(len(uni) + len(bi), np.uint64)
    keys[at_uni], keys[at_bi] = uni, bi
    counts = []
    for n_bi, weights in ((hit, marked), (every, None)):
        n = np.empty(len(keys), np.int64)
        n[at_bi] = n_bi
        n[at_uni] = np.bincount(u, weights=weights, minlength=len(uni))
        counts.append(n)
    return ids, sizes, keys, at_uni.astype(np.int32)[u], at_bi.astype(np.int32)[b], *counts


def score(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score; ``labels``: doc_id of the target's documents."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, math.ceil(((size[0] or 0) + 64 * size[1]) / block_bytes))
    block = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(n))
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", block.cast("int"))
             .repartition(n, "block"))
    marks = (labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
             .withColumn("block", block_of(n)))
    no_text = marks.select("block", "doc_id")

    def count(key, docs_, marks_):
        if docs_.num_rows == 0:
            return _rows([])
        _, _, keys, _, _, hit, every = _counted(docs_, set(marks_.column("doc_id").to_pylist()))
        # keys are sorted: a shard is a range of hashes, thus a slice
        shard = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(keys))
        return _rows([(key[0].as_py(), int(shard[lo]), _packed_keys(keys[lo:hi]), _packed(hit[lo:hi].astype(np.uint32)),
                       _packed(every[lo:hi].astype(np.uint32))) for lo, hi in zip(cuts, cuts[1:])])

    counted = (dealt.groupBy("block").cogroup(no_text.groupBy("block"))
               .applyInArrow(count, ROW))

    def merge(key, table):
        cols = {c: table.column(c).to_pylist() for c in ("block", "keys", "target", "every")}
        keys = [_keys_of(x) for x in cols["keys"]]
        sizes = [len(k) for k in keys]
        flat, held, _, at = _ranked(np.concatenate(keys))
        del keys
        sums = [np.bincount(at, weights=np.concatenate([_unpacked(x) for x in cols[c]]).astype(float),
                            minlength=len(flat)).astype(np.uint64) for c in ("target", "every")]
        odd = (flat & ONE) == ONE
        stats = [int(odd.sum()), int(sums[0][odd].sum()), int(sums[1][odd].sum())]
        out, lo = [], 0
        for block, size in zip(cols["block"], sizes):
            mine = at[lo: lo + size]
            there = np.flatnonzero(held[mine] > 1)           # the rest no other block holds
            lo += size
            out.append((block, key[0].as_py(), _packed_keys(flat[mine[there]]), _packed(sums[0][mine[there]]),
                        _packed(sums[1][mine[there]]), *(stats if not out else (0, 0, 0))))
        cols = list(zip(*out))
        return pa.table({"block": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()),
                         "keys": pa.array(cols[2], pa.binary()), "target": pa.array(cols[3], pa.binary()),
                         "every": pa.array(cols[4], pa.binary()),
                         **{c: pa.array(cols[5 + k], pa.int64()) for k, c in enumerate(("v", "nt", "nb"))}})

    # neither shuffle is made twice: what both branches read is one exchange
    merged = counted.groupBy("shard").applyInArrow(merge, ROW + ", v long, nt long, nb long")
    totals = merged.agg(*[F.sum(c).alias(c) for c in ("v", "nt", "nb")])
    replies = merged.select("block", "keys", "target", "every", F.lit(None).cast("long").alias("doc_id")).crossJoin(
        F.broadcast(totals))      # one row
    # the target's doc_ids once more, as rows beside the sums
    both = replies.unionByName(no_text.select("block", "doc_id"), allowMissingColumns=True).select(
        F.col("block").alias("of"), "keys", "target", "every", "doc_id", "v", "nt", "nb")

    def losses(key, docs_, sent):
        if docs_.num_rows == 0:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()),
                             "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64())})
        targets = set(sent.column("doc_id").drop_null().to_pylist())
        v, n_target, n_every = (pc.max(sent.column(c)).as_py() for c in ("v", "nt", "nb"))
        vocabulary = v + 1
        ids, sizes, keys, u, b, hit, every = _counted(docs_, targets)
        for k, t, e in zip(*(sent.column(c) for c in ("keys", "target", "every"))):
            if k.is_valid:
                at = np.searchsorted(keys, _keys_of(k.as_py()))
                hit[at], every[at] = _unpacked(t.as_py()), _unpacked(e.as_py())
        starts = np.cumsum(sizes) - sizes
        past = np.empty_like(u)
        past[1:] = u[:-1]
        past[starts] = u[-1]                               # a start mark for every end mark
        out = []
        for c, total in ((hit, n_target), (every, n_every)):
            loss = np.empty(len(u))
            for lo in range(0, len(u), PIECE_TOKENS):
                piece = slice(lo, lo + PIECE_TOKENS)
                before = c[past[piece]]
                w1 = np.where(before > 0, WEIGHTS[1], WEIGHTS[0] + WEIGHTS[1])
                loss[piece] = -np.log(WEIGHTS[0] * c[b[piece]] / np.maximum(before, 1) + w1 * c[u[piece]] / max(total, 1)
                                      + WEIGHTS[2] / vocabulary)
            out.append(np.add.reduceat(loss, starts) / sizes)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": sizes, "target_loss": out[0],
                         "background_loss": out[1]})

    return (dealt.groupBy("block").cogroup(both.groupBy("of"))
            .applyInArrow(losses, "doc_id long, n_tokens long, target_loss double, background_loss double")
            .withColumn("score", F.col("target_loss") - F.col("background_loss")))


def block_of(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    return pa.table({"block": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()),
                     **{c: pa.array(cols[2 + k], pa.binary()) for k, c in enumerate(("keys", "target", "every"))}})


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    target = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = score(read_table(spark, sf_dir, "documents"), target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, d.doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws,
         d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target
  FROM documents d),
t AS (
  SELECT rid, doc_id, target, i, CASE WHEN i > len(ws) THEN ' end' ELSE ws[i] END AS w,
         CASE WHEN i = 1 THEN ' start' ELSE ws[i - 1] END AS v
  FROM (SELECT *, unnest(range(1, len(ws) + 2)) AS i FROM d)),
uni AS (SELECT w, count(*) AS cb, count(*) FILTER (target) AS ct FROM t GROUP BY w),
his AS (SELECT w AS v, cb, ct FROM uni WHERE w <> ' end' UNION ALL SELECT ' start', cb, ct FROM uni WHERE w = ' end'),
bi AS (SELECT v, w, count(*) AS cb, count(*) FILTER (target) AS ct FROM t GROUP BY v, w),
n AS (SELECT CAST(sum(cb) AS DOUBLE) AS nb, CAST(sum(ct) AS DOUBLE) AS nt, count(*) + 1 AS vocab FROM uni),
p AS (
  SELECT t.rid, t.doc_id,
    CASE WHEN his.ct > 0 THEN 0.6 * bi.ct / his.ct + 0.3 * uni.ct / n.nt
         ELSE 0.9 * uni.ct / greatest(n.nt, 1) END + 0.1 / n.vocab AS pt,
    0.6 * bi.cb / his.cb + 0.3 * uni.cb / n.nb + 0.1 / n.vocab AS pb
  FROM t JOIN uni ON t.w = uni.w JOIN his ON t.v = his.v JOIN bi ON t.v = bi.v AND t.w = bi.w, n)
SELECT doc_id, count(*) AS n_tokens, round(avg(-ln(pt)), 6) AS target_loss, round(avg(-ln(pb)), 6) AS background_loss,
       round(avg(-ln(pt)) - avg(-ln(pb)), 6) AS score
FROM p GROUP BY rid, doc_id
"""
