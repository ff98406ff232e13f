"""Chat formatting with rotated perspectives.

Method: for every participant of a conversation the dialogue is rendered once,
with that speaker's turns as the assistant's, the others' as named users', and
system turns as they are.  The loss mask covers what the assistant says, with its end
mark: ``loss`` holds (begin, end) character offsets into the rendered text.

A conversation of more than ``PART_TURNS`` turn numbers is rendered in parts of that many, each with the
offset at which it stands in the whole; the parts one after another are the whole
rendering, so that no conversation has to fit one row or task.

Defined results: turns are in the order of turn, role and text (null turns last).  A null role is the
speaker ``unknown``; a null text is empty.  Characters other than letters, digits, ``_``, ``.`` and ``-`` become
``_`` in names.  Template marks inside a text are broken by a space.  Repeated rows are turns of their
own.  System turns alone have no participant and give no row.  Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"


def render(turns: list[dict], speaker: str) -> tuple[str, list[tuple[int, int]]]:
    out, loss, at = [], [], 0
    for t in turns:
        own = t["role"] == speaker
        who = t["role"] if t["role"] == SYSTEM else "assistant" if own else f"user name={t['name']}"
        head, body = f"{OPEN}{who}\n", t["text"] + CLOSE
        if own:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "\n"]
        at += len(head) + len(body) + 1
    return "".join(out), loss


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, part, part_offset, n_turns, text, loss."""
    role = F.coalesce("role", F.lit(UNKNOWN))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    turns = conversations.select(
        F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("of"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), F.regexp_replace(role, r"[^\p{L}\p{N}_.-]", "_").alias("name"), text.alias("text"),
        F.floor(F.col("turn") / PART_TURNS).cast("long").alias("part"))
    people = turns.where(F.col("role") != SYSTEM).select("of", F.col("role").alias("speaker")).distinct()
    parts = turns.groupBy("of", "part").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").isNull().alias("late"), "turn", "role", "text", "name"))).alias("turns"))

    def run(batches):
        for b in batches:
            got = [render(t, s) for t, s in zip(b.column("turns").to_pylist(), b.column("speaker").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("speaker"), b.column("part"),
                 pa.array([len(t) for t in b.column("turns")], pa.int64()), pa.array([g[0] for g in got], pa.string()),
                 pa.array([len(g[0]) for g in got], pa.int64()),
                 pa.array([[{"begin": x, "end": y} for x, y in g[1]] for g in got],
                          pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["conv_id", "speaker", "part", "n_turns", "text", "n_chars", "loss"])
    views = parts.join(people, "of").select("of.conv_id", "speaker", "part", "turns").mapInArrow(
        run, "conv_id long, speaker string, part long, n_turns long, text string, n_chars long, "
             "loss array<struct<begin: long, end: long>>")
    before = (Window.partitionBy("conv_id", "speaker").orderBy(F.col("part").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    return views.withColumn("part_offset", F.coalesce(F.sum("n_chars").over(before), F.lit(0))).select(
        "conv_id", "speaker", "part", "part_offset", "n_turns", "text", "loss")


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    spans = F.array_join(F.transform("loss", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), " ")
    return rotate(read_table(spark, sf_dir, "conversations")).withColumn("loss", spans)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text,
         turn // 1024 AS part, row_number() OVER () AS rid
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
s AS (
  SELECT t.*, speaker,
    '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = speaker THEN 'assistant'
      ELSE 'user name=' || regexp_replace(role, '[^\p{L}\p{N}_.-]', '_', 'g') END || chr(10) AS head,
    text || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, speaker, part ORDER BY turn NULLS LAST, role, text, rid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b
  FROM s),
g AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns,
    string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, role, text, rid) AS text,
    coalesce(string_agg(CASE WHEN role = speaker THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b AS BIGINT) + length(body) AS VARCHAR) END,
      ' ' ORDER BY turn NULLS LAST, role, text, rid), '') AS loss
  FROM o GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part, CAST(coalesce(sum(length(text)) OVER (
    PARTITION BY conv_id, speaker ORDER BY part NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS part_offset, n_turns, text, loss
FROM g
"""
