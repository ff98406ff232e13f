"""Extractive summary (T4), session assembly and summary (C3), session archive (S3).

Semantics matched: strip; split after ``.``/``!``/``?`` on whitespace runs;
score = number of keywords contained as substrings of the lower-cased sentence
plus ``max(0, 5 - i div 10)`` with i over all sentences; keep sentences of at
least five words; stable sort by score (ties keep text order); first six,
joined by a space in score order; none left -> first 500 characters of the
original text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.regex import WS
from .running import running

SPLITTER = f"(?<=[.!?])[{WS}]+"
FIVE_WORDS = f"^[{WS}]*[^{WS}]+(?:[{WS}]+[^{WS}]+){{4}}"


def _keyword_score(low_sentence):
    return sum(F.when(F.instr(low_sentence, kw) > 0, 1).otherwise(0) for kw in rules.SUMMARY_KEYWORDS)


def sessions_from_turns(turns: DataFrame, session_col: str = "conv_id", order_col: str = "turn",
                        text_col: str = "text") -> DataFrame:
    """Concatenate the turns of each session in turn order (newline separated).

    A session is the unit the summary needs whole; its turns are gathered per
    session only, and sorted there (bounded by one conversation).
    """
    return (turns.groupBy(session_col)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))),
                                          lambda x: x[text_col]), "\n").alias("text"),
                 F.count(F.lit(1)).alias("turns")))


def session_memories(summaries: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """C3 auto-store: each session's summary as a record for the gate (type general, source session).

    summaries: (id_col, project, summary).  The gate leaves them pending (approval_required)."""
    return summaries.select(F.col(id_col).alias("id"), "project", F.lit("general").alias("type"),
                            F.lit("session").alias("source"), F.col("summary").alias("text"))


def archive_rows(sessions: DataFrame, captured_at=None) -> DataFrame:
    """S3 rows: (project, date, captured_at, text) - raw text, unscanned."""
    ts = captured_at if captured_at is not None else F.current_timestamp()
    return sessions.select("project", F.date_format(ts, "yyyy-MM-dd").alias("date"),
                           F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("captured_at"),
                           "text")


def write_archive(rows: DataFrame, path: str) -> None:
    """S3 sink: JSON lines partitioned by project and date, appended."""
    rows.write.mode("append").partitionBy("project", "date").json(path)


def summarize_rows(df: DataFrame, id_col: str, text_col: str = "text",
                   max_sentences: int = rules.SUMMARY_MAX_SENTENCES) -> DataFrame:
    """T4 for a table of texts with unique ids: (id_col, summary).

    Sentences become rows so scoring runs in whole-stage codegen; the top
    ``max_sentences`` per text are cut with ``row_number()``, planned as a
    partial per-partition limit before the shuffle (all sentences of a text sit
    in its input partition), so the shuffle moves at most n + 1 rows per text.
    One more piece per text (ordered last) carries the 500-character prefix for
    texts with no sentence of five words.
    """
    t = F.col(text_col)
    stripped = F.regexp_replace(t, F.lit(f"(?d)\\A[{WS}]+|[{WS}]+\\z"), F.lit(""))
    pairs = F.arrays_zip(F.split(stripped, SPLITTER, -1).alias("s"),
                         F.split(F.lower(stripped), SPLITTER, -1).alias("low"))
    prefix = F.struct(F.substring(t, 1, rules.SUMMARY_FALLBACK_CHARS).alias("s"), F.lit(None).cast("string").alias("low"))
    pieces = F.concat(F.coalesce(pairs, F.array().cast("array<struct<s:string,low:string>>")), F.array(prefix))
    fb = F.col("low").isNull()
    top = (df.select(F.col(id_col).alias("_id"), F.posexplode(pieces).alias("i", "p"))
           .select("_id", "i", F.col("p.s").alias("s"), F.col("p.low").alias("low"))
           .filter(fb | F.col("s").rlike(FIVE_WORDS))
           .select("_id", fb.alias("fb"), F.when(fb, 0).otherwise(_rank("low", "i")).alias("neg"), "i", "s"))
    return _best(top, max_sentences).select(F.col("_id").alias(id_col), "summary")


def _rank(low: str, i: str):
    """Minus the score of sentence number ``i`` (from 0) with the lower-case text ``low``."""
    return -(_keyword_score(F.col(low)) + F.greatest(F.lit(0), F.lit(5) - F.floor(F.col(i) / 10).cast("int")))


def _best(top: DataFrame, max_sentences: int) -> DataFrame:
    """(_id, summary) from rows (_id, fb, neg, i, s): the best sentences; without any, the row marked ``fb``."""
    w = Window.partitionBy("_id").orderBy("fb", "neg", "i")
    top = top.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_sentences)
    agg = top.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("fb", "neg", "i", "s"))).alias("top"))
    real = F.filter("top", lambda x: ~x["fb"])
    summary = F.when(F.size(real) > 0, F.array_join(F.transform(real, lambda x: x["s"]), " ")).otherwise(
        F.element_at(F.col("top"), 1)["s"])
    return agg.select("_id", summary.alias("summary"))


def summarize_sessions(turns: DataFrame, session_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
                       max_sentences: int = rules.SUMMARY_MAX_SENTENCES) -> DataFrame:
    """C3 from turns: (session_col, turns, summary), the summary of the turns joined by line ends in turn order.

    Equals ``summarize_rows`` of ``sessions_from_turns`` without ever putting a session together, so that one that holds
    a third of all rows is worked on by many tasks.  A turn and the line end after it are cut like a text; the last
    piece of a turn goes on in the first one of the next.  A piece's sentence number is the number of cuts before it,
    a running sum over turns (``running``).  Only first and last pieces of turns meet by
    (session, sentence): one sentence at a time.  The prefix that stands for a session without a sentence
    of five words comes from the turns that begin within its first 500 characters.  Turns of null text count as turns and
    hold nothing; equal turn numbers are ordered by text; a session without text has the summary ''.
    """
    rows = turns.select(F.col(session_col).alias("_id"), F.col(order_col).alias("_at"), F.col(text_col).alias("_text"))
    cut = (rows.where("_text is not null").withColumn("_pieces", F.split(F.concat("_text", F.lit("\n")), SPLITTER, -1))
           .withColumn("_cuts", F.size("_pieces") - 1).withColumn("_chars", F.length("_text") + 1))
    numbered = running(cut, ["_id"], [F.col("_at").asc_nulls_first(), F.col("_text")], ["_cuts", "_chars"])
    pieces = (numbered.select("_id", "row_no", (F.col("run__cuts") - F.col("_cuts")).alias("_before"), "_cuts",
                              F.posexplode("_pieces").alias("j", "s"))
              .select("_id", "row_no", (F.col("_before") + F.col("j")).alias("i"), "s",
                      ((F.col("j") == 0) | (F.col("j") == F.col("_cuts"))).alias("edge")))
    joined = (pieces.where("edge").groupBy("_id", "i")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "s"))), lambda x: x["s"]), "").alias("s")))
    trimmed = F.regexp_replace("s", F.lit(f"(?d)\\A[{WS}]+|[{WS}]+\\z"), F.lit(""))
    sentences = (pieces.where("not edge").select("_id", "i", "s").unionByName(joined.select("_id", "i", trimmed.alias("s")))
                 .where(F.col("s").rlike(FIVE_WORDS)).withColumn("low", F.lower("s"))
                 .select("_id", F.lit(False).alias("fb"), _rank("low", "i").alias("neg"), "i", "s"))
    n = rules.SUMMARY_FALLBACK_CHARS
    start = F.col("run__chars") - F.col("_chars")
    prefix = (numbered.where(start < n).groupBy("_id")
              .agg(F.array_sort(F.collect_list(F.struct("row_no", F.substring("_text", 1, n).alias("s")))).alias("p"))
              .select("_id", F.lit(True).alias("fb"), F.lit(0).alias("neg"), F.lit(0).cast("long").alias("i"),
                      F.substring(F.array_join(F.transform("p", lambda x: x["s"]), "\n"), 1, n).alias("s")))
    found = _best(sentences.unionByName(prefix), max_sentences)
    counts = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("turns"))
    return (counts.join(found.withColumnRenamed("_id", "_of"), F.col("_id").eqNullSafe(F.col("_of")), "left")
            .select(F.col("_id").alias(session_col), "turns", F.coalesce("summary", F.lit("")).alias("summary")))
