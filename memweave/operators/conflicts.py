"""Contradiction detection (D6), conflict log (D13) and resolution.

Semantics matched: a new record is compared with the approved records of the
same (project, type), newest first; for each candidate, rules 1..11 are tried
in order, then the technology rule (12).  The first hit wins.  So the winner
is the lexicographic minimum of (candidate order, rule number).

Set form, no nested loop and no pair blow-up.  Whether and with what a record
conflicts depends on its (project, type) and its *signature* alone: the rule
sides and technologies that its text names.  So

* the snapshot is reduced to its first record per (project, type, rule, side) and per
  (project, type, technologies), one ``min`` with partial aggregation;
* incoming rows are reduced to their distinct signatures, which meet the other
  side's few keys; the theta part (disjoint technologies) compares signatures only;
* the outcome joins back to the rows on the signature, so that rows need no unique id.
  Rows without any signature get scattered keys that match nothing.

Where records are stored one after another (mode ``auto``), a record also meets those of its batch that were stored before it:
``with_batch_conflicts`` decides signatures first come, first served.  A stream keeps the first records of what it stored
(``stored_records``, ``merged_records``) and never reads a snapshot's texts again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import rule_label, rule_sides, tech_set
from ..session import written

TECH_RULE = len(rules.OPPOSITE_RULES) + 1


def order_key(created_at="created_at", id_col="id"):
    """Newest first, then smaller id: the snapshot's listing order."""
    return F.struct((-F.unix_micros(F.col(created_at))).alias("k_time"), F.col(id_col).alias("k_id"))


def with_signals(df: DataFrame, text_col: str, when=None) -> DataFrame:
    """Add ``sides`` (rule flags) and ``tech`` (technology set) computed from text_col.

    ``when`` limits the work to rows that need it (others get empty arrays)."""
    sides, tech = rule_sides(text_col), tech_set(text_col)
    # the technology set only feeds the technology rule, which only applies
    # to a few types: skip the 35-term regex for every other row
    tech_when = F.col("type").isin(*rules.TECH_CONFLICT_TYPES)
    if when is not None:
        sides = F.when(when, sides).otherwise(F.array().cast(sides_type()))
        tech_when = tech_when & when
    tech = F.when(tech_when, tech).otherwise(F.array().cast("array<string>"))
    return df.withColumn("sides", sides).withColumn("tech", tech)


def sides_type() -> str:
    return "array<struct<rule:int,side:string>>"


_KEYS = ["project", "type", "rule", "side", "tech"]


def first_records(snapshot: DataFrame) -> DataFrame:
    """The first record (order key, id, preview) per (project, type) and rule side or technology set: all that the
    conflict check needs of a snapshot, far fewer rows than it has.  snapshot: approved records."""
    return _firsts(snapshot.select("project", "type", "id", "summary", _ordered(0, order_key())))


def stored_records(stored: DataFrame, batch: int) -> DataFrame:
    """``first_records`` of the records that batch ``batch`` (from 0) of a stream has stored (id, project, type, clean_text):
    later batches come first, and in a batch the greater id."""
    newest = F.struct((-F.col("id")).alias("k_time"), F.col("id").alias("k_id"))
    return _firsts(stored.select("project", "type", "id", F.col("clean_text").alias("summary"), _ordered(-1 - batch, newest)))


def _ordered(batch: int, key):
    return F.struct(F.lit(batch).cast("long").alias("k_batch"), key.alias("k_record")).alias("ord")


def merged_records(*firsts: DataFrame) -> DataFrame:
    """The first of the records of several ``first_records`` tables for each of their keys."""
    both = firsts[0]
    for f in firsts[1:]:
        both = both.unionByName(f)
    return both.groupBy("project", "type", "rule", "side", "tech").agg(F.min("e").alias("e"))


def _firsts(records: DataFrame) -> DataFrame:
    # the patterns run once per row: without the cut, each use of the result and each predicate on what they find repeats them
    ex = written(with_signals(records, "summary").select("project", "type", "ord", F.col("id").alias("eid"),
                                                         F.substring("summary", 1, 100).alias("esum"), "sides", "tech"))
    keys = F.concat(
        F.transform("sides", lambda x: F.struct(x["rule"].alias("rule"), x["side"].alias("side"),
                                                F.lit(None).cast("array<string>").alias("tech"))),
        F.when(F.size("tech") > 0, F.array(F.struct(F.lit(TECH_RULE).alias("rule"), F.lit("t").alias("side"),
                                                    F.col("tech").alias("tech"))))
        .otherwise(F.array().cast("array<struct<rule:int,side:string,tech:array<string>>>")))
    return (ex.select("project", "type", "ord", "eid", "esum", F.col("tech").alias("etech"), F.explode(keys).alias("k"))
            .groupBy("project", "type", "k.rule", "k.side", "k.tech")
            .agg(F.min(F.struct("ord", "eid", "esum", "etech")).alias("e")))


def _signed(rows: DataFrame, text_col: str, when) -> DataFrame:
    """``rows`` with ``sides``, ``tech``, ``_sig``, ``_head`` (the text's beginning, all that a conflict shows of it) and ``_tie``
    (a number); rows without a signal get scattered signatures that begin with #."""
    # the patterns run once per row: without the cut, predicates on what they find would be pushed
    # below them and repeat every pattern many times over
    scattered = F.concat(F.lit("#"), F.pmod(F.xxhash64(text_col), F.lit(1 << 20)).cast("string"))
    nw = written(with_signals(rows, text_col, when=when).withColumn("_head", F.substring(text_col, 1, 100))
                 .withColumn("_scattered", scattered).withColumn("_tie", F.monotonically_increasing_id()))
    named = F.concat_ws("|", F.array_join(F.transform("sides", lambda x: F.concat(x["rule"].cast("string"), x["side"])), ","),
                        F.array_join("tech", ","))
    blank = (F.size("sides") == 0) & (F.size("tech") == 0)
    return nw.withColumn("_sig", F.when(blank, F.col("_scattered")).otherwise(named)).drop("_scattered")


def _prepared(rows: DataFrame, text_col: str, when, snapshot: DataFrame | None, first: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``_signed`` rows, and the snapshot's first records where none are given.  Both read all texts and do not need each other: they
    are two jobs at once, so that the last tasks of one leave no core idle."""
    if first is not None:
        return _signed(rows, text_col, when), first
    with ThreadPoolExecutor(1) as pool:
        made = pool.submit(inheritable_thread_target(snapshot.sparkSession)(first_records), snapshot)
        return _signed(rows, text_col, when), made.result()


def _told(df: DataFrame) -> DataFrame:
    return df.where((F.size("sides") > 0) | (F.size("tech") > 0))


def _winners(sigs: DataFrame, first: DataFrame) -> DataFrame:
    """(project, type, _sig, _w): the first of the records ``first`` (see ``first_records``) that conflicts with a
    signature, and by which rule."""
    by_rule = (sigs.select("project", "type", "_sig", F.explode("sides").alias("rs"))
               .select("project", "type", "_sig", F.col("rs.rule").alias("rule"),
                       F.when(F.col("rs.side") == "a", "b").otherwise("a").alias("side"))
               .join(first.drop("tech"), ["project", "type", "rule", "side"]).select("project", "type", "_sig", "rule", "e"))
    by_tech = (sigs.where(F.size("tech") > 0).withColumnRenamed("tech", "ntech")
               .join(first.where(F.col("rule") == TECH_RULE).drop("side"), ["project", "type"])
               .where(~F.arrays_overlap("ntech", "tech")).select("project", "type", "_sig", "rule", "e"))
    return (by_rule.unionByName(by_tech).groupBy("project", "type", "_sig")
            .agg(F.min(F.struct(F.col("e.ord").alias("ord"), "rule", "e")).alias("_w")))


def _described(out: DataFrame, own: list[str]) -> DataFrame:
    """The rows' own columns and the conflict that ``_w`` (rule, e) holds."""
    rule, e = F.col("_w.rule"), F.col("_w.e")
    desc = F.when(
        rule == TECH_RULE,
        F.concat(F.lit("Possible technology conflict in '"), F.col("type"),
                 F.lit("' memories.\n  Existing ["), e["eid"].cast("string"),
                 F.lit("] mentions: "), F.array_join(e["etech"], ", "),
                 F.lit("\n  New memory mentions: "), F.array_join("tech", ", "),
                 F.lit("\n  Please confirm which is correct.")),
    ).otherwise(
        F.concat(F.lit("Possible "), rule_label(rule),
                 F.lit(" conflict detected.\n  Existing ["), e["eid"].cast("string"),
                 F.lit("]: "), e["esum"], F.lit("\n  New memory: "), F.col("_head")))
    return out.select(*own, e["eid"].alias("conflict_with"), rule.alias("conflict_rule"),
                      F.when(rule.isNotNull(), desc).alias("conflict_description"))


def with_conflicts(rows: DataFrame, snapshot: DataFrame | None, text_col: str = "text", when=None,
                   first: DataFrame | None = None) -> DataFrame:
    """Every row of ``rows`` (project, type, <text_col>, ...) with conflict_with, conflict_rule and
    conflict_description (null without a conflict).

    snapshot: approved records (id, project, type, summary, created_at), for which their ``first_records`` may be given
    instead.  ``when`` limits the check to some rows.  Repeated or null ids do no harm: rows are never joined by id.
    """
    nw, first = _prepared(rows, text_col, when, snapshot, first)
    sigs = _told(nw).select("project", "type", "_sig", "sides", "tech").distinct()
    return _described(nw.join(_winners(sigs, first), ["project", "type", "_sig"], "left"), rows.columns)


def _conflicting(sigs: DataFrame) -> DataFrame:
    """(n, m, rule): signatures of one project and type that conflict (each pair both ways, a signature that names
    both sides of a rule also with itself), with the least rule by which they do."""
    sides = sigs.select("n", "project", "type", F.explode("sides").alias("s")).select("n", "project", "type", "s.rule", "s.side")
    other = sides.select(F.col("n").alias("m"), "project", "type", "rule", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"))
    by_rule = sides.join(other, ["project", "type", "rule", "side"]).select("n", "m", "rule")
    tech = sigs.where(F.size("tech") > 0).select("n", "project", "type", "tech")
    by_tech = (tech.join(tech.select(F.col("n").alias("m"), "project", "type", F.col("tech").alias("t2")), ["project", "type"])
               .where(~F.arrays_overlap("tech", "t2")).select("n", "m", F.lit(TECH_RULE).alias("rule")))
    return by_rule.unionByName(by_tech).groupBy("n", "m").agg(F.min("rule").alias("rule"))


def _first_come(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n, stored): whether a signature's first record is stored, decided in rounds.

    sigs: n, first (order of its first record), barred (conflicts with the snapshot).  A signature is refused if one that
    conflicts with it and comes earlier is stored, and stored once all such ones are refused.  There are as many rounds as
    the longest chain of such decisions; each reads signatures and pairs only, never records.
    """
    order = sigs.select(F.col("n").alias("m"), F.col("first").alias("m_first"))
    before = (pairs.where("n <> m").join(sigs.select("n", "first"), "n").join(order, "m").where("m_first < first")
              .select("n", "m").checkpoint())
    state = sigs.select("n", F.when(F.col("barred"), F.lit(False)).alias("stored")).checkpoint()
    while not state.where("stored is null").isEmpty():
        seen = (before.join(state.select(F.col("n").alias("m"), F.col("stored").alias("s")), "m").groupBy("n")
                .agg(F.max("s").alias("any_stored"), F.count_if(F.col("s").isNull()).alias("open")))
        decided = F.when(F.col("any_stored"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = state.join(seen, "n", "left").select("n", F.coalesce("stored", decided).alias("stored")).checkpoint()
    return state


def with_batch_conflicts(rows: DataFrame, snapshot: DataFrame | None, text_col: str = "text", when=None,
                         order: list[str] = ("id",), first: DataFrame | None = None) -> DataFrame:
    """As ``with_conflicts``, for records that are stored one after another: each is also compared with the
    records of the batch before it that were stored.  ``order``: columns of the batch's order (ties: any order, but the
    same one for all steps, as the rows are written with their numbers first).

    Whether a record is stored depends on its signature: if the signature's first record is stored, nothing that conflicts
    with it can be stored later, so its later records are stored as well (unless the signature conflicts with itself);
    if it is not, what it conflicts with stays, and neither are its later ones.  So only first records are decided, on the
    graph of signatures.  A refused record names the newest stored record before it that conflicts, by a running
    window over the records of the signatures that conflict with its own.
    """
    nw, first = _prepared(rows, text_col, when, snapshot, first)
    nw = nw.withColumn("_at", F.struct(*order, "_tie"))
    keys = ["project", "type", "_sig"]
    won = _winners(_told(nw).select(*keys, "sides", "tech").distinct(), first).checkpoint()
    sigs = (_told(nw).groupBy(*keys, "sides", "tech").agg(F.min("_at").alias("first"))
            .join(won, keys, "left").withColumn("barred", F.col("_w").isNotNull()).drop("_w")
            .withColumn("n", F.monotonically_increasing_id()).checkpoint())
    pairs = _conflicting(sigs).checkpoint()
    state = _first_come(sigs, pairs)
    # stored records: all of a stored signature, the first only if it conflicts with itself
    own = pairs.where("n = m").select("n", F.lit(True).alias("own"))
    known = sigs.join(state, "n").join(own, "n", "left").select(*keys, "n", "first", "stored", F.coalesce("own", F.lit(False)).alias("own"))
    nw = nw.join(known, keys, "left")             # not written again: each use reads its own columns of the rows
    e = F.struct(F.col("id").alias("eid"), F.col("_head").alias("esum"), F.col("tech").alias("etech"))
    kept = nw.where(F.col("stored") & (~F.col("own") | (F.col("_at") == F.col("first")))).select(
        F.col("n").alias("m"), "_at", e.alias("e"))
    # what asks: records that the batch may refuse; what answers: stored records, once for each signature that asks
    refused = pairs.join(state.where("not stored").select("n"), "n", "left_semi").unionByName(pairs.where("n = m"))
    answers = kept.join(refused.distinct(), "m").select("n", "_at", F.struct("rule", "e").alias("b"), F.lit(None).cast("boolean").alias("ask"))
    asks = nw.where(F.col("stored").isNotNull() & (~F.col("stored") | F.col("own"))).withColumn(
        "b", F.lit(None).cast(answers.schema["b"].dataType)).withColumn("ask", F.lit(True))
    both = asks.unionByName(answers, allowMissingColumns=True)
    before = Window.partitionBy("n").orderBy("_at", F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("b", F.last("b", ignorenulls=True).over(before)).where("ask").drop("ask")
    rest = nw.where(F.col("stored").isNull() | (F.col("stored") & ~F.col("own"))).withColumn("b", F.lit(None).cast(answers.schema["b"].dataType))
    w = won.withColumn("_w", F.struct("_w.rule", F.struct("_w.e.eid", "_w.e.esum", "_w.e.etech").alias("e")))
    out = told.unionByName(rest).join(w, keys, "left").withColumn("_w", F.coalesce("b", "_w"))
    return _described(out, rows.columns)


def detect_conflicts(new: DataFrame, snapshot: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``new`` that conflict: (id, conflict_with, conflict_rule, conflict_description)."""
    return (with_conflicts(new, snapshot, text_col).where("conflict_with is not null")
            .select("id", "conflict_with", "conflict_rule", "conflict_description"))


def flag_conflicts(mem: DataFrame, gated: DataFrame):
    """Conflict rows to append, and the memory table with conflict_flag set.

    Returns (conflicts_df, mem_with_flags).  Conflict ids are a SHA-256 of both
    ids and the description, so a rerun of the same batch is idempotent.
    """
    hits = gated.filter(F.col("status") == "conflict_detected")
    conflicts = hits.select(
        F.sha2(F.concat_ws("\n", F.col("id").cast("string"), F.col("conflict_with").cast("string"),
                           "conflict_description"), 256).alias("id"),
        F.col("id").alias("new_id"),
        F.col("conflict_with").alias("memory_id_a"),
        F.col("conflict_description").alias("description"),
        F.current_timestamp().alias("detected_at"),
        F.lit(False).alias("resolved"))
    flagged = hits.select(F.col("conflict_with").alias("id")).distinct().withColumn("_hit", F.lit(True))
    new_mem = (mem.join(flagged, "id", "left")
               .withColumn("conflict_flag", F.col("conflict_flag") | F.coalesce("_hit", F.lit(False)))
               .drop("_hit"))
    return conflicts, new_mem.select(*mem.columns)


def resolve_conflicts(mem: DataFrame, conflicts: DataFrame, decisions: DataFrame):
    """decisions(conflict_id, keep).  When keep differs from memory_id_a, that
    memory is dropped; the conflict is marked resolved; conflict_flag stays.

    Returns (mem_after, conflicts_after, dropped_ids).
    """
    open_c = conflicts.filter(~F.col("resolved"))
    chosen = open_c.join(decisions.withColumnRenamed("conflict_id", "id"), "id")
    dropped = chosen.filter(F.col("keep") != F.col("memory_id_a")).select(
        F.col("memory_id_a").alias("id")).distinct()
    mem_after = mem.join(dropped, "id", "left_anti")
    resolved_ids = chosen.select("id").withColumn("_done", F.lit(True))
    conflicts_after = (conflicts.join(resolved_ids, "id", "left")
                       .withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False)))
                       .drop("_done"))
    return mem_after, conflicts_after.select(*conflicts.columns), dropped
