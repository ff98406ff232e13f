"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Method: every document of a source has the same copy rate, target / source size;
its whole part is certain, its fractional part is a probability.  Two fractional documents
at a time trade *words*: a random one of the two directions, weighted so that no
probability changes on average, moves mass until one of them is integral.  A source's
expected words therefore stay what they are, whatever was drawn.  Documents are dealt to
small groups of about equal sizes by a hash; each group is folded to one residual; residuals meet in
further groups, level by level, until one is left per source, which rounds to its nearer side.

All draws are hashes of the documents traded, so that reruns agree, on any partitioning.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` of
all words; none takes more than ``most`` times its words, and what it can't take is reshared by weight.

Defined results: a null or empty text has size 0 and takes no words.  Repeated rows are single
documents each.  Null doc_ids and sources are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS, SHARE, MOST, GROUP = (3, 1, 2), 1.5, 2.0, 32

#: Folds a group: u holds structs (s: words, k1, k2, dup: the document's key, p: fraction left).
_FOLD = """
aggregate(slice(u, 2, size(u)),
  named_struct('s', u[0].s, 'k1', u[0].k1, 'k2', u[0].k2, 'dup', u[0].dup, 'p', u[0].p,
               'done', cast(array() AS array<struct<k1: bigint, k2: bigint, dup: int, copies: int>>)),
  (a, b) -> transform(array(named_struct(
      'up', least((1 - a.p) * a.s, b.p * b.s), 'down', least(a.p * a.s, (1 - b.p) * b.s),
      'draw', shiftrightunsigned(xxhash64(a.k1, a.k2, a.dup, b.k1, b.k2, b.dup, 71), 11) / 9007199254740992D)),
    m -> if(m.draw * (m.up + m.down) < m.down,
      if((1 - a.p) * a.s <= b.p * b.s, {b_up}, {a_up}),
      if(a.p * a.s <= (1 - b.p) * b.s, {b_down}, {a_down})))[0])
"""


def _left(stays: str, p: str, other: str, copies: int) -> str:
    keys = ", ".join(f"'{c}', {stays}.{c}" for c in ("s", "k1", "k2", "dup"))
    return (f"named_struct({keys}, 'p', greatest(0D, least(1D, {p})), 'done', concat(a.done, array(named_struct("
            f"'k1', {other}.k1, 'k2', {other}.k2, 'dup', {other}.dup, 'copies', {copies}))))")


FOLD = _FOLD.format(b_up=_left("b", "b.p - m.up / b.s", "a", 1), a_up=_left("a", "a.p + m.up / a.s", "b", 0),
                    b_down=_left("b", "b.p + m.down / b.s", "a", 0), a_down=_left("a", "a.p - m.down / a.s", "b", 1))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> the same with target; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)),
                                                 (1 + (F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int")))
    cap = MOST * F.col("source_size")
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    # the level of words a unit of weight if all sources that fill up sooner are full
    level = ((SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_cap), F.lit(0))))
    weighed = weighed.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return weighed.withColumn("water", water).select(
        "source", "source_size",
        F.when(F.col("level") <= F.col("ratio"), F.col("w") * F.col("water")).otherwise(F.col("cap")).alias("target"))


def _fold(units: DataFrame, *by: str) -> DataFrame:
    """One row per group: its residual and what it has decided."""
    return (units.groupBy("sid", *by).agg(F.array_sort(F.collect_list(F.struct("s", "k1", "k2", "dup", "p"))).alias("u"))
            .select("sid", F.expr(FOLD).alias("r")))


def copies(docs: DataFrame) -> DataFrame:
    """k1, k2, dup (a document's key), doc_id, source, size, source_size, target, copies."""
    keyed = docs.select(
        F.xxhash64("doc_id", "source", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("k2"),
        F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    units = (keyed.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").cast("int").alias("c"))
             .withColumn("dup", F.explode(F.sequence(F.lit(1), "c"))).drop("c"))
    units = cut(units)
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sizes).withColumn("sid", F.xxhash64("source", F.lit(3))).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = cut(rates)
    units = units.withColumn("of", F.struct("source")).join(
        rates.select(F.struct("source").alias("of"), "sid", "source_size", "target", "rate"), "of").drop("of")
    units = (units.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.col("whole"))
             .withColumn("class", F.floor(2 * F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int")))
    units = cut(units)
    open_ = units.where("p > 0 and size > 0").select("sid", "class", F.col("size").cast("double").alias("s"), "k1", "k2",
                                                     "dup", "p")
    decided = []
    level = 0
    by = ["class"]
    while True:
        counts = open_.groupBy("sid", *by).agg(F.ceil(F.count("*") / GROUP).alias("groups"))
        last = not counts.agg(F.max("groups")).first()[0] or (level > 0 and counts.agg(F.max("groups")).first()[0] == 1)
        dealt = open_.join(counts, ["sid", *by]).withColumn(
            "g", F.pmod(F.xxhash64("k1", "k2", "dup", F.lit(level)), "groups"))
        folded = cut(_fold(dealt, *by, "g"))
        decided.append(folded.select(F.explode("r.done").alias("d")).select("d.*"))
        open_ = folded.select("sid", "r.s", "r.k1", "r.k2", "r.dup", "r.p")
        if last:
            break
        level, by = level + 1, []
    decided.append(open_.select("k1", "k2", "dup", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("copies")))
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    return units.join(extra, ["k1", "k2", "dup"], "left").select(
        "k1", "k2", "dup", "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("copies", F.lit(0))).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` (all columns), each as often as it is taken."""
    taken = copies(docs).groupBy("k1", "k2").agg(F.sum("copies").cast("int").alias("_copies"), F.max("dup").alias("_rows"))
    key = [F.xxhash64("doc_id", "source", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("k2")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key).join(taken, ["k1", "k2"])
    # a row that the input repeats stands for an equal part of what its copies take together
    nth = F.when(F.col("_rows") > 1, F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))).otherwise(1)
    own = F.floor(F.col("_copies") * F.col("n") / F.col("_rows")) - F.floor(F.col("_copies") * (F.col("n") - 1) / F.col("_rows"))
    return (rows.withColumn("n", nth).withColumn("own", own.cast("int")).where("own > 0")
            .select("row", F.explode(F.sequence(F.lit(1), "own")).alias("_")).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return copies(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
