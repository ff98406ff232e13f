"""Counts and per-project reports.

Reports are computed for every project in one job.  Lists inside a report
are bounded (newest n per type, n <= 5) and are cut with ``row_number() <= n``,
which Spark plans as a partial per-partition limit before the shuffle, so a
project holding a third of the rows ships only n rows per map task.  Uncut
lists (all portfolio items) are emitted as document *lines*, one row each,
with a sort key, never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .conflicts import order_key


def counts(mem: DataFrame) -> DataFrame:
    """A1: rollup over project; the row with project NULL holds the global counts."""
    return (mem.rollup("project")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(~F.col("approved")).alias("pending"),
                 F.count_if(F.col("approved")).alias("approved")))


def count_by_type(mem: DataFrame, project: str | None = None) -> DataFrame:
    """A2: approved memories per type."""
    m = mem.filter(F.col("approved"))
    if project:
        m = m.filter(F.col("project") == project)
    return m.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def project_context(mem: DataFrame) -> DataFrame:
    """A3 as rows: every approved memory with its type count and project total."""
    m = mem.filter(F.col("approved"))
    per_type = m.groupBy("project", "type").agg(F.count(F.lit(1)).alias("type_count"))
    per_project = per_type.groupBy("project").agg(F.sum("type_count").alias("total"))
    return (m.select("project", "type", "id", "summary", "confidence", "source",
                     F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
            .join(per_type, ["project", "type"]).join(per_project, "project"))


def newest_per_type(mem: DataFrame, n: int, types=None, approved_only: bool = True) -> DataFrame:
    """Newest n per (project, type) with their rank (1 = newest)."""
    m = mem.filter(F.col("approved")) if approved_only else mem
    if types:
        m = m.filter(F.col("type").isin(*types))
    w = Window.partitionBy("project", "type").orderBy(order_key())
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _items(type_name: str, k: int, width: int):
    """Bullets for the k newest of one type, in rank order."""
    picked = F.filter(F.col("top"), lambda x: (x["type"] == type_name) & (x["rank"] <= k))
    return F.transform(picked, lambda x: F.concat(F.lit("- "), F.substring(x["summary"], 1, width)))


def _type_is(type_name: str):
    return lambda x: x["type"] == type_name


def _section(header: str, items):
    return F.when(F.size(items) > 0,
                  F.concat(F.lit(header + "\n"), F.array_join(items, "\n"), F.lit("\n\n"))
                  ).otherwise(F.lit(""))


def relevant_memories(mem: DataFrame, hits: DataFrame, n: int = rules.PR_ITEMS) -> DataFrame:
    """(project, rank, id, type, summary): the first n hits per project that still have a memory.

    hits: (project, rank, id), e.g. ``recall.top_k`` of the context's vector with ``group_col="project"``."""
    kept = hits.select("project", F.col("rank").alias("_r"), "id").join(mem.select("id", "type", "summary"), "id")
    w = Window.partitionBy("project").orderBy("_r", "id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "project", "rank", "id", "type", "summary")


def pr_drafts(mem: DataFrame, context: str = "", hits: DataFrame | None = None) -> DataFrame:
    """C4 for every project, those without approved memories too: markdown template, total and types referenced.

    ``context`` stands under the summary heading; with a context, ``hits`` (see
    ``relevant_memories``) give the block of relevant memories.
    """
    approved = mem.filter(F.col("approved"))
    totals = mem.groupBy("project").agg(F.count_if("approved").alias("total_memories"))
    sections = rules.PR_SECTIONS
    top = newest_per_type(mem, rules.PR_ITEMS, [t for t, _h, _k in sections])
    per_project = top.groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("type", "rank", "summary", "id"))).alias("top"))
    secs = [_section(h, _items(t, k, rules.PR_LINE_CHARS)) for t, h, k in sections]
    n_types = sum(F.when(F.exists(F.col("top"), _type_is(t)), 1).otherwise(0) for t, _h, _k in sections)
    ctx = context.strip()
    head = "## Summary\n\n" + (ctx + "\n\n" if ctx else "")
    df = totals.join(per_project, "project", "left").withColumn(
        "top", F.coalesce("top", F.array().cast(per_project.schema["top"].dataType)))
    block = F.lit("")
    if ctx and hits is not None:
        heading, n = rules.PR_RELEVANT
        lines = relevant_memories(approved, hits, n).groupBy("project").agg(F.sort_array(F.collect_list(F.struct(
            "rank", F.concat(F.lit("- ["), "type", F.lit("] "), F.substring("summary", 1, rules.PR_LINE_CHARS))
            .alias("line")))).alias("_rel"))
        df = df.join(lines, "project", "left")
        block = F.when(F.col("_rel").isNotNull(), F.concat(
            F.lit(heading + "\n"), F.array_join(F.transform("_rel", lambda x: x["line"]), "\n"), F.lit("\n\n"))).otherwise("")
    template = F.concat(F.lit(head), block, *secs, F.lit("## Test plan\n\n- [ ] ...\n\n_Generated from "),
                        F.col("project"), F.lit(" memory — "), n_types.cast("string"),
                        F.lit(" memory types referenced._"))
    return df.select("project", template.alias("template"), "total_memories",
                     n_types.alias("types_referenced"))


def pr_draft_items(mem: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """C4's lists as rows (project, section, rank, id, summary): the newest five of each type cut to
    120 characters, and of ``hits`` the first five, whole."""
    items = newest_per_type(mem, rules.PR_ITEMS, [t for t, _h, _k in rules.PR_SECTIONS]).select(
        "project", F.col("type").alias("section"), "rank", "id",
        F.substring("summary", 1, rules.PREVIEW_CHARS).alias("summary"))
    if hits is None:
        return items
    return items.unionByName(relevant_memories(mem.filter(F.col("approved")), hits).select(
        "project", F.lit("relevant").alias("section"), "rank", "id", "summary"))


def portfolio_lines(mem: DataFrame, all_projects: bool = False) -> DataFrame:
    """C5 markdown per project (or one for all projects, ``all``) as ordered lines (project, section, ord, line).

    Highlights and achievements are uncut; decisions and architecture keep the
    newest five, cut to 120 characters.  Projects with none of the four types
    get the empty-state text.
    """
    if all_projects:
        mem = mem.withColumn("project", F.lit("all"))
    m = mem.filter(F.col("approved"))
    date = F.date_format("created_at", "yyyy-MM-dd")
    full = (m.filter(F.col("type").isin("portfolio", "resume"))
            .select("project",
                    F.when(F.col("type") == "portfolio", 1).otherwise(2).alias("section"),
                    order_key().alias("ord"),
                    F.concat(F.lit("- "), F.col("summary"), F.lit("  _"), date, F.lit("_")).alias("line")))
    cut = (newest_per_type(mem, 5, ["decision", "architecture"])
           .select("project",
                   F.when(F.col("type") == "decision", 3).otherwise(4).alias("section"),
                   order_key().alias("ord"),
                   F.concat(F.lit("- "), F.substring("summary", 1, rules.PREVIEW_CHARS)).alias("line")))
    items = full.unionByName(cut)
    present = items.select("project", "section").distinct()
    hmap = F.create_map(*[x for k, v in enumerate(rules.PORTFOLIO_HEADINGS, start=1) for x in (F.lit(k), F.lit(v + "\n"))])
    first = F.struct(F.lit(-(2 ** 62)).cast("bigint").alias("k_time"), F.lit(None).cast("bigint").alias("k_id"))
    last = F.struct(F.lit(2 ** 62).cast("bigint").alias("k_time"), F.lit(None).cast("bigint").alias("k_id"))
    head_rows = present.select("project", "section", first.alias("ord"), hmap[F.col("section")].alias("line"))
    blank_rows = present.select("project", "section", last.alias("ord"), F.lit("").alias("line"))
    projects = mem.select("project").distinct()
    title = projects.select("project", F.lit(0).alias("section"), first.alias("ord"),
                            (F.lit("# Portfolio\n") if all_projects else
                             F.concat(F.lit("# Portfolio — "), F.col("project"), F.lit("\n"))).alias("line"))
    empty = projects.join(present.select("project").distinct(), "project", "left_anti")
    empty_rows = empty.select("project", F.lit(5).alias("section"),
                              F.posexplode(F.array(*[F.lit(x) for x in rules.PORTFOLIO_EMPTY])).alias("pos", "line")
                              ).select("project", "section",
                                       F.struct(F.col("pos").cast("bigint").alias("k_time"),
                                                F.lit(None).cast("bigint").alias("k_id")).alias("ord"),
                                       "line")
    return title.unionByName(head_rows).unionByName(items).unionByName(blank_rows).unionByName(empty_rows)


def portfolio_summary(mem: DataFrame) -> DataFrame:
    """C5 counts per project: total approved, highlights (portfolio + resume)."""
    m = mem.filter(F.col("approved"))
    return m.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_memories"),
        F.count_if(F.col("type").isin("portfolio", "resume")).alias("highlight_count"))


def status_report(mem: DataFrame, conflicts: DataFrame) -> DataFrame:
    """C6 per project: total, approved, pending, open conflicts on its memories."""
    c = counts(mem).filter(F.col("project").isNotNull())
    open_c = (conflicts.filter(~F.col("resolved"))
              .join(mem.select(F.col("id").alias("memory_id_a"), "project"), "memory_id_a")
              .groupBy("project").agg(F.count(F.lit(1)).alias("open_conflicts")))
    return (c.join(open_c, "project", "left")
            .withColumn("open_conflicts", F.coalesce("open_conflicts", F.lit(0).cast("bigint"))))


def health(mem: DataFrame, conflicts: DataFrame, index: DataFrame) -> DataFrame:
    """A5: one row of data-quality counts (each input aggregated once)."""
    m = mem.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("approved")).alias("pending"))
    c = conflicts.agg(F.count_if(~F.col("resolved")).alias("open_conflicts"))
    v = index.agg(F.count(F.lit(1)).alias("index_entries"))
    # three one-row aggregates joined on a constant key
    one = F.lit(1).alias("_k")
    return (m.select("*", one).join(c.select("*", one), "_k")
            .join(v.select("*", one), "_k").drop("_k"))
