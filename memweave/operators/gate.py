"""Memory gate (C1) and its roll-ups.

Every record gets a ``status``: error (invalid type) -> blocked (secret left
after redaction) -> conflict_detected (D6 against the approved snapshot) ->
stored (mode ``auto``) / pending (other modes).  Nothing raises; the reason is
a column.  Each sink filters the one result DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import confidence_from_source, invalid_type_reason, is_valid_type, redact_and_scan
from ..session import written
from .conflicts import with_batch_conflicts, with_conflicts


def screen(records: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless part of the gate: type check, redact, scan, confidence."""
    return (records
            .withColumn("valid_type", is_valid_type("type"))
            .withColumn("_screened", redact_and_scan(text_col))
            .withColumn("clean_text", F.col("_screened.clean_text"))
            .withColumn("findings", F.col("_screened.findings"))
            .withColumn("confidence", confidence_from_source("source")).drop("_screened"))


def gate(records: DataFrame, snapshot: DataFrame | None, mode: str = "approval_required",
         check_conflicts: bool = True, order: list[str] = ("id",), first: DataFrame | None = None) -> DataFrame:
    """records: (id, project, type, source, text, ...); snapshot: memories table
    (approved rows are the candidates).  One row per record, also if ids repeat.
    ``first`` stands for the snapshot where its ``first_records`` are at hand already.

    Every record is checked against the snapshot as it stands before the batch.  With ``auto``, records are stored
    in the order of the columns ``order``, and each also against those of the batch that were stored before it.
    """
    if mode not in rules.APPROVAL_MODES:
        raise ValueError(f"unknown approval mode {mode!r}")
    s = screen(records).drop("text")             # the cleaned text stands for it from here on
    passed = F.col("valid_type") & (F.size("findings") == 0)
    if check_conflicts:
        approved = snapshot.filter(F.col("approved")) if first is None else None
        if mode == "auto":
            s = with_batch_conflicts(s, approved, "clean_text", when=passed, order=order, first=first)
        else:
            s = with_conflicts(s, approved, "clean_text", when=passed, first=first)
    else:
        s = (written(s).withColumn("conflict_with", F.lit(None).cast("bigint"))
             .withColumn("conflict_rule", F.lit(None).cast("int"))
             .withColumn("conflict_description", F.lit(None).cast("string")))
    final = "stored" if mode == "auto" else "pending"
    status = (F.when(~F.col("valid_type"), F.lit("error"))
              .when(F.size("findings") > 0, F.lit("blocked"))
              .when(F.col("conflict_with").isNotNull(), F.lit("conflict_detected"))
              .otherwise(F.lit(final)))
    reason = (F.when(~F.col("valid_type"), invalid_type_reason("type"))
              .when(F.size("findings") > 0,
                    F.concat(F.lit("Secret scan failed: "), F.array_join("findings", ", "),
                             F.lit(". Redact before storing.")))
              .when(F.col("conflict_with").isNotNull(), F.col("conflict_description")))
    return s.withColumn("status", status).withColumn("reason", reason)


def status_counts(gated: DataFrame) -> DataFrame:
    """C1 roll-up per project/type/status."""
    return (gated.groupBy("project", "type", "status")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg("confidence"), 4).alias("avg_confidence")))


def ingest_tally(gated: DataFrame) -> DataFrame:
    """A4: stored / skipped per project."""
    outcome = F.when(F.col("status").isin("stored", "pending"), "stored").otherwise("skipped")
    return gated.groupBy("project", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def findings_frequency(gated: DataFrame) -> DataFrame:
    """How often each secret kind is found (after redaction)."""
    return (gated.select(F.explode("findings").alias("finding"))
            .groupBy("finding").agg(F.count(F.lit(1)).alias("n")))
