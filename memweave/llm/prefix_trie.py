"""Conversation prefix trie in node tables with minimal perfect hashes.

Method: every prefix of every conversation gets a 128-bit digest, taken from running sums of position-wise hashes
(``operators.running``), so that a conversation of any length spans tasks.  One aggregation enumerates the distinct digests, with
their least member and counts, and checks that equal digests have the same parent, last turn and depth: by induction from the
root no two prefixes share a digest, or the job fails.

Nodes that two or more conversations share are accumulated in *units*: a node's level is the power of ``limit`` within
which its member count lies, and a unit is a subtree of one level.  So a unit has at most ``limit`` nodes of a depth, however hot
its first turn is, and there are log(members) levels.  Units are dealt to shards.  A shard assigns its digests collision-verified
slots by a minimal perfect hash (levels of bit arrays; the digest stored at a slot is compared), scatters the counts into
flat numpy arrays, and adds every node to its parent's slot in order of depth, deepest first.  What units' tops hold goes, summed by parent
digest, to the next level.  A node of one member needs no table: its subtree is a chain.

Defined results: rows of a null conv_id are of no conversation and take no part.  Equal turns of one conversation are
ordered by the digest of role and text.  A null role or text is empty.  ``conv_id - conv_id % 5`` is SQL's remainder (towards zero).
An empty table has no conversations and no nodes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import cut, mix64
from .repair import CRC_TABLE, crc_sql

LIMIT = 4096             # members of a unit's top, over the members of its smallest nodes
SHARD_NODES = 1 << 17
SALTS = 64               # pieces into which the rows of a hot prefix are dealt
LEVELS = 8               # powers of the limit that are told apart (64-bit ones)
CHUNK_BITS = 12          # conv_ids of one text piece of a node's list: 4,096
LANES = 4


# ------------------------------------------------------- minimal perfect hash
class SlotTable:
    """Digests (two uint64 lanes) -> slots 0 .. n-1, each used once.

    Level by level the digests left are hashed to a bit array; those alone on their bit are placed, and the slot is the
    bit's rank.  ``find`` compares the digest stored at the slot, so an unknown digest gives -1.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        n = len(hi)
        rest, self.levels, base = np.arange(n), [], 0
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("equal digests")
            size = 2 * len(rest) + 1
            at = self._at(hi[rest], lo[rest], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append((size, bits, base + np.cumsum(bits) - 1))
            base += int(bits.sum())
            rest = rest[~bits[at]]
        slots = self._slots(hi, lo)
        if n and not (np.bincount(slots, minlength=n) == 1).all():
            raise ValueError("slots are not a permutation")
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[slots], self.lo[slots], self.slots = hi, lo, slots

    @staticmethod
    def _at(hi, lo, level, size):
        return (mix64(hi ^ mix64(lo + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) % np.uint64(size)).astype(np.int64)

    def _slots(self, hi, lo) -> np.ndarray:
        out, rest = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (size, bits, rank) in enumerate(self.levels):
            at = self._at(hi[rest], lo[rest], level, size)
            out[rest[bits[at]]] = rank[at[bits[at]]]
            rest = rest[~bits[at]]
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slots = self._slots(hi, lo)
        at = np.maximum(slots, 0)
        known = (slots >= 0) & (self.hi[at] == hi) & (self.lo[at] == lo) if len(self.hi) else np.zeros(len(hi), bool)
        return np.where(known, slots, -1)


SHARED = ["n_convs", "n_ends", "bytes", "in_convs", "in_children", "in_leaves", "in_saved"]
RESULT = "hi long, lo long, phi long, plo long, top boolean, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _accumulate(table: pa.Table) -> pa.Table:
    """One shard: flat arrays by slot, summed into parents' slots from the deepest nodes up."""
    hi, lo, phi, plo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo", "phi", "plo"))
    slots = SlotTable(hi, lo)
    at, parent_of = slots.slots, slots.find(phi, plo)
    depth, parent = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    depth[at], parent[at] = table.column("depth").to_numpy(), parent_of
    convs, ends, size, shared, children, leaves, saved = (np.zeros(len(at), np.int64) for _ in SHARED)
    for array, name in zip((convs, ends, size, shared, children, leaves, saved), SHARED):
        array[at] = table.column(name).to_numpy()
    saved += (convs - 1) * size
    order = np.argsort(-depth, kind="stable")
    steps = np.flatnonzero(np.diff(depth[order])) + 1
    for here in np.split(order, steps):                        # all nodes of one depth
        alone = convs[here] - ends[here] - shared[here]        # members whose next turn no other member has
        children[here] += alone
        leaves[here] += alone + (children[here] == 0)
        inner = here[parent[here] >= 0]
        up = parent[inner]
        for total, value in ((shared, convs[inner]), (children, 1), (leaves, leaves[inner]), (saved, saved[inner])):
            np.add.at(total, up, value)
    return pa.table({"hi": table.column("hi"), "lo": table.column("lo"), "phi": table.column("phi"), "plo": table.column("plo"),
                     "top": pa.array(parent_of < 0), "n_convs": pa.array(convs[at]), "n_children": pa.array(children[at]),
                     "n_leaves": pa.array(leaves[at]), "saved_tokens": pa.array(saved[at])})


# ------------------------------------------------------------------ prefixes
def _digest(depth: Column, lanes: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *lanes).alias("hi"), F.xxhash64(*reversed(lanes), depth, F.lit(1)).alias("lo")]


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All prefixes of all conversations: conv_id, depth, hi, lo, phi, plo, said, bytes, is_end.

    turns: conv_id, depth (1, 2, ... without holes), said (digest of the turn), bytes; convs: conv_id, n_turns.
    """
    lanes = [F.xxhash64("said", "depth", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"l{k}") for k in range(LANES)]
    names = [f"l{k}" for k in range(LANES)]
    summed = running(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "said", "bytes", *lanes),
                     ["conv_id"], [F.col("depth")], names)
    own = _digest(F.col("depth"), [F.col(f"run_{n}") for n in names])
    up = _digest(F.col("depth") - 1, [F.col(f"run_{n}") - F.col(n) for n in names])
    deep = summed.select("conv_id", "depth", *own, up[0].alias("phi"), up[1].alias("plo"), "said", "bytes")
    none = F.lit(None).cast("long")
    zero = [F.lit(0).cast("long")] * (LANES + 1)
    roots = convs.select("conv_id", zero[0].alias("depth"), *_digest(zero[0], zero[1:]), none.alias("phi"), none.alias("plo"),
                         F.lit("").alias("said"), zero[0].alias("bytes"))
    return deep.unionByName(roots).join(convs, "conv_id").withColumn("is_end", F.col("depth") == F.col("n_turns")).drop("n_turns")


def _nodes(prefix: DataFrame) -> DataFrame:
    """One row per distinct digest; equal digests of different prefixes raise."""
    facts = F.struct("depth", "said", "bytes", "phi", "plo")
    got = prefix.groupBy("hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                         F.count_if("is_end").alias("n_ends"), F.min(facts).alias("f"), F.max(facts).alias("g"))
    depth = F.when(F.col("f").eqNullSafe(F.col("g")), F.col("f.depth")).otherwise(
        F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return got.select("hi", "lo", "conv_id", "n_convs", "n_ends", depth.alias("depth"), "f.bytes", "f.phi", "f.plo")


def _end_lists(prefix: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the nodes at which conversations end.

    Lists are joined in pieces of one range of conv_ids, and the pieces stream through the digest in order.
    """
    piece = F.shiftright("conv_id", CHUNK_BITS)
    pieces = prefix.where("is_end").groupBy("hi", "lo", piece.alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        key, sha = None, None
        for b in batches:
            done = []
            for hi, lo, ids in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
                if key != (hi, lo):
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield table(done)
        if key:
            yield table([(*key, sha.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))],
                                          names=["hi", "lo", "ends_sha256"])
    return (pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "piece")
            .mapInArrow(run, "hi long, lo long, ends_sha256 string"))


def _salted(df: DataFrame) -> DataFrame:
    """A row for every salt, for the few prefixes that many rows ask."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def trie(turns: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of last turns that its subtree holds once and its members repeat), ends_sha256.

    turns, convs: as ``prefixes`` takes them.
    """
    prefix = cut(prefixes(turns, convs))
    level = sum((F.col("n_convs") > limit ** k).cast("int") for k in range(1, LEVELS) if limit ** k < 1 << 62)
    nodes = cut(_nodes(prefix).withColumn("level", level))
    shared = nodes.where("n_convs > 1")
    big = nodes.where("level > 0").select("hi", "lo", F.col("conv_id").alias("owner"), "level")

    # the unit of a node: the first prefix of its level on the way down, the same for all of its members
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")
    tops = (prefix.select("conv_id", "depth", "hi", "lo", salt).join(_salted(big.drop("owner")), ["hi", "lo", "salt"], "left")
            .groupBy("conv_id", F.coalesce("level", F.lit(0)).alias("level"))
            .agg(F.min(F.struct("depth", "hi", "lo")).alias("u")).select("conv_id", "level", F.col("u.hi").alias("uhi"), F.col("u.lo").alias("ulo")))
    placed = cut(shared.join(tops, ["conv_id", "level"]))
    sizes = {r["level"]: r["n"] for r in placed.groupBy("level").agg(F.count("*").alias("n")).collect()}    # LEVELS rows at most
    results, sent = None, None
    for v in sorted(sizes):
        here = placed.where(F.col("level") == v)
        if sent is None:
            zeros = [F.lit(0).cast("long").alias(c) for c in SHARED[3:]]
            here = here.select("*", *zeros)
        else:
            got = sent.groupBy("phi", "plo").agg(
                F.sum("n_convs").alias("in_convs"), F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"),
                F.sum("saved_tokens").alias("in_saved")).withColumnsRenamed({"phi": "hi", "plo": "lo"})
            here = here.join(got, ["hi", "lo"], "left").fillna(0, SHARED[3:])
        shards = -(-sizes[v] // SHARD_NODES)
        dealt = here.withColumn("shard", F.pmod(F.xxhash64("uhi", "ulo"), F.lit(shards))).select(
            "shard", "hi", "lo", F.coalesce("phi", F.lit(0).cast("long")).alias("phi"), F.coalesce("plo", F.lit(0).cast("long")).alias("plo"),
            "depth", *SHARED)
        done = cut(dealt.groupBy("shard").applyInArrow(_accumulate, RESULT))
        results = done if results is None else results.union(done)
        tops_done = done.where("top").select("phi", "plo", "n_convs", "n_leaves", "saved_tokens")
        sent = tops_done if sent is None else sent.union(tops_done)
    counted = nodes if results is None else nodes.join(
        results.select("hi", "lo", "n_children", "n_leaves", "saved_tokens"), ["hi", "lo"], "left")
    if results is None:
        counted = counted.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])

    # the parent's least member: the node's own, if no other conversation shares the parent
    small = shared.where("level = 0").select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("small_owner"))
    large = _salted(big.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("owner").alias("large_owner")))
    parent = F.when(F.col("depth") > 0, F.coalesce("small_owner", "large_owner", "conv_id"))
    named = (counted.withColumn("salt", salt).join(small, ["phi", "plo"], "left").join(large, ["phi", "plo", "salt"], "left")
             .join(_end_lists(prefix), ["hi", "lo"], "left"))
    return named.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", 1 - F.col("n_ends")).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


# --------------------------------------------------------------------- query
def rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) as ``trie`` takes them: conversation c begins with the first h turns of conversation c - c % family,
    h = crc32(c) % heads, and goes on with its own turns after the first h."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"),
                               F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    own = running(own, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("said")])
    lengths = own.groupBy("conv_id").agg(F.max("row_no").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    plan = lengths.select("conv_id", "n", base, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    plan = cut(plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
               .withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))))
    # at most heads - 1 rows of a base, for at most 2 * family - 1 conversations
    first = own.where(F.col("row_no") < heads).select(F.col("conv_id").alias("base"), "row_no", "said", "bytes")
    head = plan.join(first, "base").where(F.col("row_no") <= F.col("head")).select(
        "conv_id", F.col("row_no").alias("depth"), "said", "bytes")
    tail = own.join(plan, "conv_id").where(F.col("row_no") > F.col("h")).select(
        "conv_id", (F.col("row_no") - F.col("h") + F.col("head")).alias("depth"), "said", "bytes")
    convs = plan.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return head.unionByName(tail), convs


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return trie(*rebuilt(read_table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH crc AS ({CRC_TABLE}),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS j
  FROM conversations WHERE conv_id IS NOT NULL),
plan AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
head AS (SELECT p.conv_id, j AS depth, role, text FROM plan p JOIN own o ON o.conv_id = base WHERE j <= h),
turns AS (
  SELECT * FROM head UNION ALL
  SELECT o.conv_id, j - h + (SELECT count(*) FROM head WHERE head.conv_id = o.conv_id) AS depth, role, text
  FROM own o JOIN plan p ON p.conv_id = o.conv_id WHERE j > h),
pre AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
    sha256(string_agg(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k,
    depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM plan),
node AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM pre GROUP BY k, depth),
kid AS (
  SELECT c.*, p.k AS pk, m.conv_id AS parent_conv_id
  FROM node c LEFT JOIN pre p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1 LEFT JOIN node m ON m.k = p.k AND m.depth = p.depth),
kids AS (SELECT pk, depth - 1 AS depth, count(*) AS n FROM kid WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT kid.*, coalesce(kids.n, 0) AS n_children FROM kid LEFT JOIN kids ON kids.pk = kid.k AND kids.depth = kid.depth),
below AS (      -- the ancestors of a node stand on its least member's path
  SELECT a.k, a.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w.bytes) AS saved
  FROM whole w JOIN pre a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.k, a.depth)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM whole w JOIN below b ON b.k = w.k AND b.depth = w.depth
"""
