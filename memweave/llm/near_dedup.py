"""MinHash near-duplicate detection with SuperMinHash signatures.

Method: every distinct shingle draws a permutation of the ``m`` signature
positions step by step (Fisher-Yates).  In step ``j`` it offers ``j + u`` to its
next position, and a position keeps its smallest offer.  Offers of step ``j``
are below those of all later steps, so a text stops as soon as all of its
positions are filled.  Signatures are cut into bands of ``rows`` values;
texts that share a band are candidates; candidates are verified on their full
shingle sets; verified links are grouped by union-find, first inside each
partition, then by contracting whole partitions' results against each other.

Nothing lists all pairs of a bucket.  Texts with equal sets are one class from
the start.  Rounds of stars (each member against one centre of its bucket, a
new centre per round and band) link most of a bucket.  Only members of *different* groups
that remain in one bucket are then compared, by their signatures, tile by tile; what may reach the threshold is joined to
*families*, and a family's members outside its largest group meet all of its members in exact matrix products of their full sets,
again tile by tile.  Both steps put out forests of links and no pairs, so rows stay fewer than members times tiles.

Defined results: a null or empty text (or one without words) has no shingles,
is its own component and is kept.  Links are between classes of equal sets, so that rows that repeat a
``doc_id`` are judged each by its own text: ``component_id`` is the least doc_id of the row's group of linked
classes (two groups have the same one if that doc_id has a text in each).  One row of a group is kept: that of
least doc_id, then text hash, then any.  Rows of a null ``doc_id`` link like all others, rank last, and show a null
component and as kept here; ``survivors`` drops them like all others.  Other columns play no part and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, mix64, words_of

BANDS, ROWS = 40, 6            # a pair at 0.8 shares no band with probability (1 - 0.8**6)**40 = 5e-6
STAR_ROUNDS = 2
ROUNDS_BY_ID = 3
ONE_TASK_LINKS = 250_000       # links that one task may hold: some 60 MB of union-find
TILE = 1024                    # members of one tile when what is left of a bucket is compared
SLACK = 0.12                   # 4.6 standard deviations of a 240-value estimate at 0.8: passes over 2e-6 of such pairs
TILE_ELEMENTS = 150_000        # shingles of the sets of one tile when a family is verified
COLUMNS = 4096                 # elements of one matrix product
CHUNK_ELEMENTS = 60_000        # shingles whose permutations are held at a time


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter sequence is one shingle."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    acc = words[: len(words) - width + 1]
    for j in range(1, width):
        acc = mix64(acc) ^ words[j: len(words) - width + 1 + j]
    return np.unique(mix64(acc ^ np.uint64(width)))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """Signatures (n_sets, m) of the sets that own the elements; values are (step << 32 | fraction)."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_sets * m, empty, np.uint64)
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    rows = np.arange(len(elements))
    for j in range(m):
        draw = mix64(elements + np.uint64((j + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        at = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        flat = owner * m + at
        new = sig[flat] >= np.uint64(j << 32)          # filled in an earlier step: final
        np.minimum.at(sig, flat[new], (np.uint64(j << 32) | (draw[new] & np.uint64(0xFFFFFFFF))))
        if j % 2 == 0 or j < 4:
            full = (sig.reshape(n_sets, m) != empty).all(axis=1)
            live = ~full[owner]
            if not live.any():
                break
            if not live.all():
                elements, owner, rows = elements[live], owner[live], rows[live]
    return sig.reshape(n_sets, m)


def _set_hash(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hi = np.array([mix64(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    lo = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0 for s in sets],
                  np.uint64)
    return hi.view(np.int64), lo.view(np.int64)


def _sets(batch: pa.RecordBatch, hashes: WordHashes, k: int, lower: bool):
    for i, t in enumerate(batch.column("text")):
        yield i, shingle_hashes(hashes.of(words_of(t.as_py(), lower)), k)


def _signer(k: int, lower: bool, bands: int, rows: int):
    m = bands * rows

    def flush(batch, ids, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        sig = super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), m)
        acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
        cube = sig.reshape(len(sets), bands, rows)
        for r in range(rows):
            acc = mix64(acc) ^ cube[:, :, r]
        keys = mix64(acc).view(np.int64)
        keys[sizes == 0] = 0
        hi, lo = _set_hash(sets)
        offsets = np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32)
        none = sizes == 0
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(ids)), batch.column("text_hash").take(pa.array(ids)),
             pa.array(sizes), pa.array(hi), pa.array(lo),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
             pa.array([None if z else r.tobytes() for z, r in zip(none, (sig & np.uint64(255)).astype(np.uint8))],
                      pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "hi", "lo", "bands", "sketch"])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, sets, held = [], [], 0
            for i, s in _sets(batch, hashes, k, lower):
                ids.append(i)
                sets.append(s)
                held += len(s)
                if held >= CHUNK_ELEMENTS:
                    yield flush(batch, ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield flush(batch, ids, sets)
    return run


def _key():
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")


def _same(x: DataFrame, y: DataFrame):
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_hash"] == y["text_hash"])


def signatures(docs: DataFrame, k: int = 5, lower: bool = True, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text hash, n_shingles, 128-bit set hash (hi, lo), band keys and an 8-bit sketch of the signature."""
    return docs.select(*_key(), "text").mapInArrow(
        _signer(k, lower, bands, rows),
        "doc_id long, text_hash long, n_shingles long, hi long, lo long, bands array<long>, sketch binary")


def _full_sets(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets, held = [], 0
            for i, s in _sets(batch, hashes, k, lower):
                sets.append(s)
                held += len(s)
                if held >= 1_000_000 or i == batch.num_rows - 1:
                    hi, lo = _set_hash(sets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hi), pa.array(lo), pa.array([x.tobytes() for x in sets], pa.binary())],
                        names=["hi", "lo", "full"])
                    sets, held = [], 0
    return docs.select("text").mapInArrow(run, "hi long, lo long, full binary")


# ---------------------------------------------------------------- union-find
def _find(parent: dict, x):
    root = x
    while parent[root] != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def _forest(batches):
    """Union-find over one partition's links: what they connect, as links to the smallest id."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in (a, b):
                parent.setdefault(x, x)
            ra, rb = _find(parent, a), _find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:
            yield _links(parent)
            parent = {}
    yield _links(parent)


def _links(parent: dict) -> pa.RecordBatch:
    pairs = [(x, root) for x in parent if (root := _find(parent, x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _rooted(batches):
    """All nodes of one partition's links with their roots, for as many links as one task may hold."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = (_find(parent, parent.setdefault(x, x)) for x in (a, b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([_find(parent, x) for x in parent], pa.int64())],
                                     names=["id", "comp"])


def connected(links: DataFrame) -> DataFrame:
    """(id, comp): every linked id with the smallest id that it reaches.

    Each round merges every node into its least neighbour, until no link is left
    between different groups; ``least`` is by id at first, which ends stars at once,
    then by a hash that changes each round, so that chains shrink by a constant share too.  Once
    ``ONE_TASK_LINKS`` links or fewer are left, one task's union-find ends it.
    """
    links = cut(links.select("a", "b").mapInArrow(_forest, "a long, b long"))
    if links.count() <= ONE_TASK_LINKS:
        tree = cut(links.repartition(1).mapInArrow(_rooted, "id long, comp long"))
        return tree
    root = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("root", F.col("id"))
    level = 0
    while (left := links.count()):
        if left <= ONE_TASK_LINKS:
            to = cut(links.repartition(1).mapInArrow(_rooted, "id long, comp long")).toDF("root", "to")
            root = root.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
            break
        level += 1
        both = links.union(links.select("b", "a"))
        if level <= ROUNDS_BY_ID:
            to = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to"))
        else:
            own = F.struct(F.xxhash64("a", F.lit(level)).alias("h"), F.col("a").alias("b"))
            to = (both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(level)).alias("h"), "b")).alias("m"))
                  .select("a", F.least("m", own)["b"].alias("to")))
        to = cut(to)
        links = cut(links.join(to, "a").select(F.col("to").alias("x"), "b")
                    .join(to.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
                    .where("a <> b").mapInArrow(_forest, "a long, b long"))
        root = (root.join(to.withColumnRenamed("a", "root"), "root", "left")
                .select("id", F.coalesce("to", "root").alias("root")))
    root = cut(root)
    low = root.groupBy("root").agg(F.min("id").alias("comp"))
    return cut(root.join(low, "root").select("id", "comp"))


# -------------------------------------------------------------- verification
def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wide = (pairs.join(sets.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("fa"), batch.column("fb")):
                keep.append(_reaches(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))
    return wide.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _size_ok(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _joined(labels: np.ndarray, i: int, others: np.ndarray, ids: np.ndarray, ids_of_others: np.ndarray) -> list:
    """Put i and others into one local group; the links that this took (one for each group that joined)."""
    mine, found = labels[i], []
    groups, first = np.unique(labels[others], return_index=True)
    for g, at in zip(groups.tolist(), first.tolist()):
        if g != mine:
            found.append((ids[i], ids_of_others[at]))
            labels[labels == g] = mine
    return found


def _pairs_table(found: list) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _families(members: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(id, fam): members of different groups whose signatures may reach the threshold, in families closed under that.

    A bucket is dealt to tiles of about TILE members by a hash of the id, and every pair of its tiles is one task-sized
    group, so no group grows with the bucket.  Within it, only members outside its largest group look for
    others.  What a group of tiles finds comes out as a forest: fewer rows than members, however many pairs there are.
    """
    counts = members.groupBy("band").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tiled = members.join(counts, "band").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    grid = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "band", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "id", "n", "comp",
        "sketch")

    def run(key, table):
        ids, n, comp, tile = (table.column(c).to_numpy() for c in ("id", "n", "comp", "tile"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        groups, sizes = np.unique(comp, return_counts=True)
        large = groups[np.argmax(sizes)]
        across = key[1].as_py() != key[2].as_py()
        labels, found = np.arange(len(ids)), []
        for i in np.flatnonzero(comp != large):
            ok = (comp != comp[i]) & ((comp == large) | (ids > ids[i]))
            ok &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            if across:
                ok &= tile != tile[i]
            at = np.flatnonzero(ok)
            at = at[(sketch[at] == sketch[i]).mean(axis=1) >= percent / 100 - SLACK]
            if len(at):
                found += _joined(labels, i, at, ids, ids[at])
        return _pairs_table(found)
    near = (grid.repartition(partitions, "band", "t1", "t2").groupBy("band", "t1", "t2")
            .applyInArrow(run, "a long, b long"))
    return connected(cut(near)).withColumnRenamed("comp", "fam")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b: products of 0/1 matrices over the elements that
    two or more sets hold, some thousand elements at a time."""
    both = [*a, *b]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, element, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    element = shared[element]
    owner, element = owner[element >= 0], element[element >= 0]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((len(a), len(b)), np.float32)               # exact: sizes are below 2 ** 24
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
        i, j = np.searchsorted(element, [lo, lo + COLUMNS])
        held = np.zeros((len(both), COLUMNS), np.float32)
        held[owner[i:j], element[i:j] - lo] = 1
        out += held[:len(a)] @ held[len(a):].T
    return out.astype(np.int64)


def _family_links(families: DataFrame, sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links (a, b) between groups of one family, by exact intersections, as a forest of each pair of tiles.

    families: id, fam, n, comp.  Members outside the family's largest group meet all members; tiles hold a bounded
    number of elements and members, and every set is sent once to each tile of the others.
    """
    group = families.groupBy("fam", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("elements"))
    large = group.groupBy("fam").agg(F.max(F.struct("c", "comp")).alias("m")).select("fam", F.col("m.comp").alias("large"))
    n_tiles = F.greatest(F.ceil(F.sum("elements") / TILE_ELEMENTS), F.ceil(F.sum("c") / TILE))
    side = (F.col("comp") == F.col("large")).alias("rest")
    tiles = group.join(large, "fam").groupBy("fam", side).agg(n_tiles.alias("tiles"))
    tiles = tiles.groupBy("fam").agg(F.coalesce(F.max(F.when(~F.col("rest"), F.col("tiles"))), F.lit(0)).alias("few"),
                                     F.coalesce(F.max(F.when(F.col("rest"), F.col("tiles"))), F.lit(0)).alias("rest_tiles"))
    own = families.join(large, "fam").join(tiles, "fam").withColumn("rest", side).withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rest_tiles")).otherwise(F.col("few"))))
    nothing = F.array().cast("array<long>")

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(nothing)
    # pair of tiles (i, rest, j): tile i of the few with tile j of the few (j >= i) or of the rest
    small = F.concat(
        F.transform(upto(F.col("few")), lambda x: F.struct(F.least(x, "tile").alias("i"), F.lit(False).alias("r"), F.greatest(x, "tile").alias("j"))),
        F.transform(upto(F.col("rest_tiles")), lambda x: F.struct(F.col("tile").alias("i"), F.lit(True).alias("r"), x.alias("j"))))
    big = F.transform(upto(F.col("few")), lambda x: F.struct(x.alias("i"), F.lit(True).alias("r"), F.col("tile").alias("j")))
    dealt = own.withColumn("g", F.explode(F.when(F.col("rest"), big).otherwise(small))).join(sets, "id").select(
        "fam", "g.i", "g.r", "g.j", "id", "comp", "tile", "rest", "full")

    def run(key, table):
        i, r, j = (x.as_py() for x in key[1:])
        ids, comp, tile = (table.column(c).to_numpy() for c in ("id", "comp", "tile"))
        rest = table.column("rest").to_numpy(zero_copy_only=False)
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("full")]
        at_a = np.flatnonzero(~rest & (tile == i))
        at_b = np.flatnonzero(rest) if r else np.flatnonzero(tile == j)
        a, b = [full[x] for x in at_a], [full[x] for x in at_b]
        common = _common(a, b)
        union = np.array([len(x) for x in a], np.int64)[:, None] + np.array([len(x) for x in b], np.int64)[None, :] - common
        linked = (100 * common >= percent * union) & (comp[at_a][:, None] != comp[at_b][None, :])
        labels, found = np.arange(len(ids)), []
        for x in np.flatnonzero(linked.any(axis=1)):
            others = at_b[linked[x]]
            found += _joined(labels, at_a[x], others, ids, ids[others])
        return _pairs_table(found)
    return (dealt.repartition(partitions, "fam", "i", "r", "j").groupBy("fam", "i", "r", "j")
            .applyInArrow(run, "a long, b long"))


def _judged(docs: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id, and whether it is its group's one row.

    A class of equal sets is known by ``at``, the number of its first row (doc_id, text hash, any).
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = cut(signatures(docs, k, lower).withColumn("at", F.monotonically_increasing_id()))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "at")).alias("best")
    classes = cut(sig.where("n_shingles > 0").groupBy("n_shingles", "hi", "lo").agg(first_row, F.count("*").alias("c")))
    reps = classes.select(F.col("best.at").alias("id"), "n_shingles", "hi", "lo")
    rep_sig = sig.join(reps.select(F.col("id").alias("at")), "at", "left_semi")
    bands = rep_sig.select(F.explode("bands").alias("band"), F.col("at").alias("id"), F.col("n_shingles").alias("n"))
    shared = bands.groupBy("band").agg(F.count("*").alias("c"), F.min("id").alias("centre")).where("c > 1")
    inside = cut(bands.join(shared.select("band", "centre"), "band").select("band", "id", "n", "centre").distinct())
    # the texts of candidates only
    needed = classes.select(F.col("best.at").alias("id"), "best.doc_id", "best.text_hash").join(
        inside.select("id").distinct(), "id", "left_semi")
    texts = docs.select(*_key(), "text")
    sets = cut(_full_sets(texts.join(needed, _same(texts, needed), "left_semi"), k, lower)
               .join(reps, ["hi", "lo"]).where("n_shingles * 8 = octet_length(full)").select("id", "full")
               .dropDuplicates(["id"]))
    size = reps.select(F.col("id").alias("centre"), F.col("n_shingles").alias("nb"))
    first = (inside.where("id <> centre").groupBy("id", "centre").agg(F.first("n").alias("na"), F.count("*").alias("c"))
             .groupBy("id", "na").agg(F.max(F.struct("c", -F.col("centre"))).alias("best"))
             .select("id", "na", (-F.col("best.col2")).alias("centre")))
    pairs = (first.join(size, "centre").where(_size_ok(percent)).select(F.col("centre").alias("a"), F.col("id").alias("b")))
    comp = connected(cut(_verify(pairs, sets, percent)))
    buckets = inside.select("band", "id", "n")
    for step in range(STAR_ROUNDS + 1):
        # buckets whose members are not yet one group
        now = (buckets.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        mixed = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        buckets = cut(now.join(mixed.select("band"), "band", "left_semi").select("band", "id", "n", "comp"))
        if buckets.isEmpty():
            break
        if step < STAR_ROUNDS:
            # first the member with the most company in all of its buckets: of copies of one text, the least changed one
            size_of = buckets.groupBy("band").agg(F.count("*").alias("c"))
            company = buckets.join(size_of, "band").groupBy("id").agg(F.sum("c").alias("company"))
            first_of = F.struct(-F.col("company") if step == 0 else F.xxhash64("id", "band"), F.col("id"),
                                F.col("n").alias("nb"), F.col("comp").alias("cb"))
            centre = (buckets.join(company, "id") if step == 0 else buckets).groupBy("band").agg(
                F.min(first_of).alias("s")).select("band", "s.id", "s.nb", "s.cb")
            pairs = (buckets.join(centre.withColumnRenamed("id", "centre"), "band")
                     .where("comp <> cb").withColumnRenamed("n", "na").where(_size_ok(percent))
                     .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
        else:
            sketch = rep_sig.select(F.col("at").alias("id"), "sketch")
            families = _families(buckets.join(sketch, "id"), percent, partitions)
            families = cut(families.join(buckets.select("id", "n", "comp").distinct(), "id"))
        grouped = comp.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
        found = _verify(pairs, sets, percent) if step < STAR_ROUNDS else _family_links(families, sets, percent, partitions)
        comp = connected(cut(found).union(grouped))      # cut: one Python worker a task at a time
        buckets = buckets.select("band", "id", "n")
    linked = classes.join(comp.select(F.col("id").alias("cid"), "comp"), F.col("best.at") == F.col("cid"), "left")
    group = linked.where("comp is not null").groupBy("comp").agg(F.min("best").alias("least"))
    # classes of one row without a link need no verdict
    verdict = (linked.where("c > 1 or comp is not null").join(group, "comp", "left")
               .select("n_shingles", "hi", "lo", F.coalesce("least", "best").alias("least")))
    return sig.select("doc_id", "text_hash", "n_shingles", "hi", "lo", "at").join(
        verdict, ["n_shingles", "hi", "lo"], "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("least.at") == F.col("at"), F.lit(True)).alias("one"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links are 100 * intersection >= percent * union of the distinct k-word
    shingle sets of the whole texts.
    """
    return _judged(docs, k, percent, lower).select(
        "doc_id", "n_shingles", "component_id", (F.col("one") | F.col("doc_id").isNull()).alias("kept"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, and all without shingles.

    Rows are told apart by doc_id and text hash; of rows that repeat both, one is taken.
    """
    keys = cut(_judged(docs, k, percent, lower).groupBy("doc_id", "text_hash").agg(
        F.max("one").alias("one"), F.min("one").alias("all")).where("not all"))
    own = docs.select(F.struct(*docs.columns).alias("own_row"), *_key())

    def rows(of: DataFrame, how: str) -> DataFrame:
        return own.join(of, _same(own, of), how)
    out = rows(keys.select("doc_id", "text_hash"), "left_anti").select("own_row.*")
    twice = keys.where("one").select("doc_id", "text_hash")
    if twice.isEmpty():
        return out
    return out.union(rows(twice, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("own_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=2)
