"""Conversation structure repair: the cheapest edits that make roles alternate.

Method: a path through the DAG of (row, state of the role grammar, audit position) is one edit script.  Its weight is
a single big integer: the high digits carry the cost, and below them every audit position has one digit of fixed
width for its letter (D 1, I 2, K 3, R 4; 0 pads the end).  The least integer is so the cheapest script, and of
equally cheap ones the one of ASCII-least audit; nothing but integer minima decides.  Two nodes of one row and state
are both kept only while neither is certain to lose: the dearer one goes, and of equally dear ones that which is greater within
the letters that both have.

Rows are dealt by conversation and sorted, and stream through their task: a window of ``WINDOW`` rows is solved at
a time, the audit's prefix on which all remaining nodes agree is put out with its rows, and what is left goes into
the next window's digits.  So a task holds a window and not a conversation.  One conversation is one sequence (its repaired
text has one digest), and streams through one task whatever its length.

The roles' initials must read ``(s?(ua)+)?`` afterwards.  Keep (K) costs 0, Rerole (R) to user or assistant 2, Delete
(D) 3, Insert (I) of an empty user or assistant turn 2; a truncated row that stays adds 1; blank and duplicate rows must go.

Defined results: rows are in the order of turn (nulls first), role and text; equal rows follow each other.  Rows of a null
conv_id are one conversation.  Null roles and texts are empty (the query puts a space for them first).  A role without
characters has no initial and can't be kept.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP_CLASS

WINDOW = 256
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}       # a new role: inserted or given
DIGIT, LETTER, BITS = {"D": 1, "I": 2, "K": 3, "R": 4}, " DIKR", 3
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
# MIMIC[p, q]: by at most this more cost a script in state p can go on as any script in state q does (inserts first; a
# system row that only START can keep is deleted), so that a script dearer by more than that in state q can't win
MIMIC = {(ASSISTANT, USER): 2, (ASSISTANT, SYSTEM): 0, (ASSISTANT, START): 3, (USER, ASSISTANT): 2, (USER, SYSTEM): 2,
         (USER, START): 5, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4, (SYSTEM, START): 4, (START, USER): 2,
         (START, ASSISTANT): 4, (START, SYSTEM): 0}


# ------------------------------------------------------------- integer minima
class _Weights:
    """Weights of scripts of at most ``width`` letters."""

    def __init__(self, width: int):
        self.width, self.shift = width, BITS * width
        self.step = {e: COST[e] << self.shift for e in DIGIT}
        self.one = 1 << self.shift

    def add(self, weight: int, at: int, edit: str) -> int:
        return weight + self.step[edit] + (DIGIT[edit] << BITS * (self.width - 1 - at))

    def pack(self, cost: int, audit: str) -> int:
        weight = cost << self.shift
        for at, edit in enumerate(audit):
            weight += DIGIT[edit] << BITS * (self.width - 1 - at)
        return weight

    def unpack(self, weight: int, n: int) -> tuple[int, str]:
        return weight >> self.shift, "".join(LETTER[weight >> BITS * (self.width - 1 - at) & 7] for at in range(n))

    def prune(self, nodes: dict) -> dict:
        """Of each state the cheapest nodes, but for those that a node of another length is sure to beat."""
        least: dict[int, int] = {}
        for (state, _), weight in nodes.items():
            cost = weight >> self.shift
            if state not in least or cost < least[state]:
                least[state] = cost
        lost = {q for (p, q), extra in MIMIC.items() if p in least and q in least and least[q] > least[p] + extra}
        kept: dict = {}
        lists: dict[int, list] = {}
        for (state, n), weight in sorted(nodes.items()):
            if state in lost or weight >> self.shift > least[state]:
                continue
            mine, beaten = lists.setdefault(state, []), False
            while mine:
                m, other = mine[-1]                        # m < n: compared within the first m letters
                drop = BITS * (self.width - m)
                if weight >> drop < other >> drop:
                    mine.pop()
                    continue
                beaten = weight >> drop > other >> drop
                break
            if not beaten:
                mine.append((n, weight))
        for state, mine in lists.items():
            for n, weight in mine:
                kept[state, n] = weight
        return kept


def _lower(nodes: dict, key: tuple, weight: int) -> None:
    if key not in nodes or weight < nodes[key]:
        nodes[key] = weight


def _with_inserts(nodes: dict, w: _Weights) -> dict:
    """Up to two inserts: three never pay, as the first and third of them give the same state."""
    out, new = dict(nodes), nodes
    for _ in range(2):
        more: dict = {}
        for (state, n), weight in new.items():
            _lower(more, (NEXT[state], n + 1), w.add(weight, n, "I"))
        for key, weight in more.items():
            _lower(out, key, weight)
        new = more
    return w.prune(out)


def _advance(nodes: dict, w: _Weights, initial: str, fault: str | None) -> dict:
    new: dict = {}
    for (state, n), weight in _with_inserts(nodes, w).items():
        _lower(new, (state, n + 1), w.add(weight, n, "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        if fault == TRUNCATED:
            weight += w.one
        if (state, initial) in KEEP:
            _lower(new, (KEEP[state, initial], n + 1), w.add(weight, n, "K"))
        _lower(new, (NEXT[state], n + 1), w.add(weight, n, "R"))
    return w.prune(new)


class _Solver:
    """Solves the rows of one conversation window by window; ``push`` and ``finish`` give (edit, row) pairs."""

    def __init__(self, window: int):
        self.window, self.live, self.state = window, {(START, ""): 0}, START
        self.pending, self.fresh = deque(), []

    def push(self, row: tuple) -> list:
        self.fresh.append(row)
        return self._solve(False) if len(self.fresh) >= self.window else []

    def finish(self) -> list:
        return self._solve(True)

    def _solve(self, last: bool) -> list:
        held = max(len(audit) for _, audit in self.live)
        w = _Weights(held + 3 * len(self.fresh) + 2)
        nodes = {(state, len(audit)): w.pack(cost, audit) for (state, audit), cost in self.live.items()}
        for row in self.fresh:
            nodes = _advance(nodes, w, row[1][:1], row[4])
        self.pending.extend(self.fresh)
        self.fresh = []
        if last:
            nodes = {k: v for k, v in _with_inserts(nodes, w).items() if k[0] in (START, ASSISTANT)}
            key = min(nodes, key=nodes.get)
            return self._replay(w.unpack(nodes[key], key[1])[1])
        told = {key: w.unpack(weight, key[1]) for key, weight in nodes.items()}
        base = min(cost for cost, _ in told.values())
        sure = len(os.path.commonprefix([audit for _, audit in told.values()]))
        prefix = next(iter(told.values()))[1][:sure]
        self.live = {(key[0], audit[sure:]): cost - base for key, (cost, audit) in told.items()}
        return self._replay(prefix)

    def _replay(self, audit: str) -> list:
        out = []
        for edit in audit:
            if edit == "I":
                self.state = NEXT[self.state]
                out.append((edit, "user" if self.state == USER else "assistant", None))
                continue
            row = self.pending.popleft()
            if edit == "D":
                out.append((edit, None, row))
            elif edit == "K":
                self.state = KEEP[self.state, row[1][:1]]
                out.append((edit, row[1], row))
            else:
                self.state = NEXT[self.state]
                out.append((edit, "user" if self.state == USER else "assistant", row))
        return out


# ---------------------------------------------------------------------- Spark
EDITS = ("conv_id long, seq long, edit string, turn long, role string, text string, old_role string, fault string, "
         "cost int")


def _order() -> list:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the flags ``blank``, ``truncated`` and ``late``: role and text stand at an earlier turn.

    Equal rows of one turn follow each other in order, and are told by the row before.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.regexp_replace("text", GAP_CLASS + r"\z", "")
    own = own.withColumn("blank", bare == "").withColumn("truncated", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    key = [F.col("conv_id"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said")]
    later = (own.where("not blank").groupBy(*key).agg(F.min(when).alias("first"), F.max(when).alias("last"))
             .where("first < last").withColumnsRenamed({"conv_id": "c", "said": "s"}).drop("last"))
    return own.join(later, F.col("conv_id").eqNullSafe(F.col("c")) & (key[1] == F.col("s")), "left").select(
        "conv_id", "turn", "role", "text", "blank", "truncated", F.coalesce(when > F.col("first"), F.lit(False)).alias("late"))


def _batch(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = [c.split()[0] for c in EDITS.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def repair(turns: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per edit, in order within its partition: conv_id, seq, edit (K, R, D or I), the row's turn, the role and
    text that stay (null: deleted), the role before (null: inserted), the row's fault and the edit's cost.

    The rows without deleted ones, by (conv_id, seq), are the repaired conversations.
    """
    def run(batches):
        conv, solver, seq, before, out, size = None, None, 0, None, [], 0

        def emit(edits):
            nonlocal seq, size
            for edit, role, row in edits:
                seq += 1
                if row is None:
                    out.append((conv[0], seq, edit, None, role, "", None, None, COST[edit]))
                    continue
                turn, old, text, _, fault = row
                gone = edit == "D"
                size += 0 if gone else len(text)
                out.append((conv[0], seq, edit, turn, role, None if gone else text, old, fault,
                            COST[edit] + (fault == TRUNCATED and not gone)))
        for batch in batches:
            for c, turn, role, text, blank, cut_off, late in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if conv is None or conv[0] != c:
                    if solver:
                        emit(solver.finish())
                    conv, solver, seq, before = (c,), _Solver(window), 0, None
                again = late or before == (turn, role, text)
                before = (turn, role, text)
                fault = BLANK if blank else DUPLICATE if again else TRUNCATED if cut_off else None
                emit(solver.push((turn, role, text, None, fault)))
                if len(out) >= 1000 or size >= 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
        if solver:
            emit(solver.finish())
        if out:
            yield _batch(out)
    dealt = faults(turns).repartition("conv_id").sortWithinPartitions(*_order())
    return dealt.mapInArrow(run, EDITS)


DIGESTS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result (as it comes: whole conversations in order)."""
    def run(batches):
        conv, got = None, None

        def fresh():
            return {"low": None, "turns": 0, "turn": None, "n": dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0), "illegal": 0,
                    "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0, "role": None}

        def row():
            gaps = 0 if got["low"] is None else got["turn"] - got["low"] + 1 - got["turns"]
            return (conv[0], gaps, *got["n"].values(), got["illegal"], got["cost"], "".join(got["audit"]), got["sha"].hexdigest())

        def table(rows):
            types = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                                              names=[c.split()[0] for c in DIGESTS.split(", ")])
        for batch in batches:
            done = []
            for c, _, edit, turn, role, text, old, fault, cost in zip(*(x.to_pylist() for x in batch.columns)):
                if conv is None or conv[0] != c:
                    if conv:
                        done.append(row())
                    conv, got = (c,), fresh()
                got["audit"].append(edit)
                got["cost"] += cost
                if old is not None:                        # a row of the input, in order
                    if turn is not None and turn != got["turn"]:
                        got["low"] = turn if got["low"] is None else got["low"]
                        got["turn"], got["turns"] = turn, got["turns"] + 1
                    if fault:
                        got["n"][fault] += 1
                    if got["role"] is not None:
                        got["illegal"] += got["role"][:1] + old[:1] not in ("su", "ua", "au")
                    got["role"] = old
                if role is not None:
                    got["sha"].update((("\n" if got["lines"] else "") + role + ":" + text).encode())
                    got["lines"] += 1
            if done:
                yield table(done)
        if conv:
            yield table([row()])
    return edits.mapInArrow(run, DIGESTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """The table that the query repairs: rows dropped, emptied, stripped of sentence marks, repeated or given another role."""
    space = F.lit(" ")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    spot = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = own.withColumn("kind", F.crc32(spot.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                      text.alias("text"), copies.alias("copy")).drop("copy")


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` (the null one included): what its damage and repair come to."""
    got = summaries(repair(damaged(conversations))).withColumnRenamed("conv_id", "of")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    return every.join(got, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return digests(read_table(spark, sf_dir, "conversations"))


CRC_TABLE = """
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
              ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, given ``crc.t`` of CRC_TABLE."""
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), "
            f"lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, crc.t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295)")


# rows one after another; each round tries every edit of the next row, with up to two inserts before it, from every node kept
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations, crc),
dmg AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM dmg),
flt AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS prev
  FROM num),
stat AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS last,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flt GROUP BY conv_id),
ins AS (      -- state: 0 start, 1 after system, 2 after user, 3 after assistant; inserts before a row or the end
  SELECT * FROM (VALUES
    (0, 0, 0, '', []), (1, 0, 1, '', []), (2, 0, 2, '', []), (3, 0, 3, '', []),
    (0, 1, 2, 'I', ['user:']), (1, 1, 2, 'I', ['user:']), (3, 1, 2, 'I', ['user:']), (2, 1, 3, 'I', ['assistant:']),
    (0, 2, 3, 'II', ['user:', 'assistant:']), (1, 2, 3, 'II', ['user:', 'assistant:']),
    (3, 2, 3, 'II', ['user:', 'assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:'])) AS v(state, k, then_state, letters, made)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM stat
  UNION ALL
  SELECT conv_id, n, state, cost, audit, lines FROM (
    SELECT f.conv_id, f.n,
      CASE op WHEN 'D' THEN then_state WHEN 'R' THEN CASE WHEN then_state = 2 THEN 3 ELSE 2 END
        ELSE CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
      w.cost + 2 * k + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
        + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      w.audit || letters || op AS audit,
      list_concat(w.lines, made, CASE op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text]
        ELSE [CASE WHEN then_state = 2 THEN 'assistant:' ELSE 'user:' END || f.text] END) AS lines
    FROM walk w JOIN flt f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1
      JOIN ins i ON i.state = w.state CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS o(op)
    WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (op = 'R'
      OR left(f.role, 1) = 's' AND then_state = 0 OR left(f.role, 1) = 'u' AND then_state IN (0, 1, 3)
      OR left(f.role, 1) = 'a' AND then_state = 2))
  QUALIFY cost = min(cost) OVER (PARTITION BY conv_id, state)
    AND row_number() OVER (PARTITION BY conv_id, state, length(audit) ORDER BY cost, audit) = 1),
fin AS (
  SELECT s.conv_id, w.cost + 2 * k AS cost, w.audit || letters AS audit, list_concat(w.lines, made) AS lines
  FROM walk w JOIN stat s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.last = w.n JOIN ins i ON i.state = w.state
  WHERE then_state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY w.cost + 2 * k, w.audit || letters) = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""
