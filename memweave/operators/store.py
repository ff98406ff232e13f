"""Store operators: listings (P1-P8), look-up joins (D2-D5) and update joins
(D9-D11, S9, S10).

Plain Parquet has no MERGE, so updates return the next version of the table;
the caller writes it to a new path (or appends change rows and resolves the
latest per id on read with ``latest_per_key``).  Nothing is collected to the
driver, and no operator emits all pairs inside a group: same-commit look-ups
return the group as rows keyed by the commit, and callers semi-join the ids
they ask about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import iso_ts, preview


# P1 / P2 / P7 -----------------------------------------------------------------
def list_memories(mem: DataFrame, project: str | None = None, approved_only: bool = True) -> DataFrame:
    """Newest first; a falsy project means every project."""
    out = mem
    if project:
        out = out.filter(F.col("project") == project)
    if approved_only:
        out = out.filter(F.col("approved"))
    return out.orderBy(F.col("created_at").desc(), F.col("id"))


def list_pending(mem: DataFrame, project: str | None = None) -> DataFrame:
    out = mem.filter(~F.col("approved"))
    if project:
        out = out.filter(F.col("project") == project)
    return out.orderBy(F.col("created_at").desc(), F.col("id"))


def memory_listing(mem: DataFrame, project: str | None = None, include_pending: bool = False) -> DataFrame:
    """Listing rows with a 120-char preview and parsed tags."""
    return list_memories(mem, project, approved_only=not include_pending).select(
        "id", preview("summary").alias("summary"), "type", "project", "confidence", "approved",
        iso_ts("created_at").alias("created_at"), "source", "tags")


def audit_listing(mem: DataFrame, project: str | None = None) -> DataFrame:
    """Every memory, pending included, seven columns."""
    return list_memories(mem, project, approved_only=False).select(
        "id", "project", "type", F.substring("summary", 1, 60).alias("summary"), "confidence",
        "approved", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


# P3 / P4 / P5 -----------------------------------------------------------------
def get_many(mem: DataFrame, ids: DataFrame) -> DataFrame:
    """P3 for a batch of ids (semi join; unknown ids simply do not match)."""
    return mem.join(ids.select("id").distinct(), "id", "left_semi")


def by_so_url(mem: DataFrame, urls: DataFrame) -> DataFrame:
    """Stored memories for canonical URLs (any project, any approval)."""
    return mem.join(urls.select(F.col("url").alias("so_url")).distinct(), "so_url", "left_semi")


def list_conflicts(conflicts: DataFrame, resolved: bool = False) -> DataFrame:
    return conflicts.filter(F.col("resolved") == F.lit(resolved))


# D2 ---------------------------------------------------------------------------
def commit_groups(mem: DataFrame) -> DataFrame:
    """Memories keyed by commit: (commit_sha, id, summary[:100], group_size).

    ``commits_for_memory(x)`` is the group of x's commit minus x; returning
    groups as rows keeps the output linear in the table size.
    """
    linked = mem.filter(F.col("commit_sha").isNotNull())
    sizes = linked.groupBy("commit_sha").agg(F.count(F.lit(1)).alias("group_size"))
    return linked.select("commit_sha", "id", F.substring("summary", 1, 100).alias("summary")).join(
        sizes, "commit_sha")


def commits_for_memory(mem: DataFrame, ids: DataFrame) -> DataFrame:
    """D2 for requested ids: (memory_id, commit_sha, id, summary), self excluded."""
    asked = (mem.join(ids.select("id").distinct(), "id", "left_semi")
             .filter(F.col("commit_sha").isNotNull())
             .select(F.col("id").alias("memory_id"), "commit_sha"))
    members = mem.filter(F.col("commit_sha").isNotNull()).select(
        "commit_sha", "id", F.substring("summary", 1, 100).alias("summary"))
    return asked.join(members, "commit_sha").filter(F.col("id") != F.col("memory_id"))


# D3 ---------------------------------------------------------------------------
def related_memories(mem: DataFrame) -> DataFrame:
    """Explicit links in list order; missing targets skipped."""
    links = mem.select(F.col("id").alias("memory_id"),
                       F.posexplode("related_to").alias("pos", "id"))
    return links.join(mem.select("id", "project", "type", "summary"), "id").select(
        "memory_id", "pos", F.col("id").alias("related_id"), "project", "type",
        F.substring("summary", 1, 100).alias("summary"))


# D5 / S10 ---------------------------------------------------------------------
def forget(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete by id (memories or vector index); dangling links stay."""
    return table.join(ids.select("id").distinct(), "id", "left_anti")


# D9 ---------------------------------------------------------------------------
def link_to_commit(mem: DataFrame, links: DataFrame) -> DataFrame:
    """links(memory_id, commit_sha, linked_at): the latest link per memory wins."""
    last = latest_per_key(links.withColumnRenamed("memory_id", "id"), ["id"], "linked_at")
    return (mem.join(last.select("id", F.col("commit_sha").alias("_sha")), "id", "left")
            .withColumn("commit_sha", F.coalesce("_sha", "commit_sha")).drop("_sha")
            .select(*mem.columns))


# D10 --------------------------------------------------------------------------
def link_memories(mem: DataFrame, pairs: DataFrame):
    """pairs(a, b): link both ways when both exist; idempotent.

    Returns (mem_after, outcome) where outcome has (a, b, linked boolean).
    """
    ids = mem.select("id")
    ok = (pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi")
          .join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
          .filter(F.col("a") != F.col("b")))
    outcome = pairs.join(ok.select("a", "b").distinct().withColumn("linked", F.lit(True)),
                         ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    both = ok.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        ok.select(F.col("b").alias("id"), F.col("a").alias("other")))
    add = both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("_add"))
    mem_after = (mem.join(add, "id", "left")
                 .withColumn("related_to",
                             F.when(F.col("_add").isNull(), F.col("related_to"))
                             .otherwise(F.concat("related_to",
                                                 F.array_except("_add", "related_to"))))
                 .drop("_add").select(*mem.columns))
    return mem_after, outcome


# D11 / S9 ---------------------------------------------------------------------
def approve(mem: DataFrame, approvals: DataFrame):
    """Set approved for the given ids; returns (mem_after, newly_approved)."""
    hit = approvals.select("id").distinct().withColumn("_ok", F.lit(True))
    joined = mem.join(hit, "id", "left")
    newly = joined.filter(F.col("_ok") & ~F.col("approved")).drop("_ok").select(*mem.columns)
    after = (joined.withColumn("approved", F.col("approved") | F.coalesce("_ok", F.lit(False)))
             .drop("_ok").select(*mem.columns))
    return after, newly


def latest_per_key(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Latest-wins resolution of change rows (ties: larger row content)."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    best = df.groupBy(*keys).agg(F.max(F.struct(order_col, *rest)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def upsert_vectors(index: DataFrame, updates: DataFrame, version_col: str = "version") -> DataFrame:
    """Updates replace index rows with the same id; of several updates of one id the one of
    highest ``version_col`` wins (without that column: the larger row content)."""
    versioned = updates if version_col in updates.columns else updates.withColumn(version_col, F.lit(0))
    last = latest_per_key(versioned, ["id"], version_col)
    kept = index.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.select(*index.columns))
