"""Registry of runnable queries: name -> (spark_fn(spark, sf_dir), oracle_sql or None).

Every query reads the driver tables (or what Spark derives from them) whole.
Arrays and timestamps are emitted as strings so the DuckDB oracle can be
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import confidence_from_source, is_valid_type, iso_ts, redact, scan_findings
from ..operators import gate as gate_ops
from ..sources import tables
from ..sources.memories import incoming_from_memories
from . import sqlbits as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def mem(spark, sf):
    return tables.memories(spark, sf)


def joined(col: str, sep: str = "|"):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), sep)


def sql_joined(col: str, sep: str = "|") -> str:
    return f"array_to_string(list_transform({col}, lambda x: CAST(x AS VARCHAR)), '{sep}')"


# --- S1: the memory table ----------------------------------------------------
@register("mem_view", S.with_mem(f"""
SELECT id, project, type, summary, source, {S.ts('created_at')} AS created_at, confidence,
  {sql_joined('tags')} AS tags, {sql_joined('related_files')} AS related_files,
  approved, commit_sha, so_url, {sql_joined('related_to')} AS related_to
FROM memc"""))
def q_mem_view(spark, sf):
    m = mem(spark, sf)
    return m.select("id", "project", "type", "summary", "source",
                    iso_ts("created_at").alias("created_at"), "confidence",
                    joined("tags").alias("tags"), joined("related_files").alias("related_files"),
                    "approved", "commit_sha", "so_url", joined("related_to").alias("related_to"))


# --- F1 ----------------------------------------------------------------------
@register("confidence_by_source", S.with_mem("""
SELECT source, confidence, CAST(count(*) AS BIGINT) AS n FROM memc GROUP BY source, confidence"""))
def q_confidence(spark, sf):
    return (mem(spark, sf).groupBy("source", confidence_from_source("source").alias("confidence"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- F2 ----------------------------------------------------------------------
@register("type_validation", S.with_mem(f"""
SELECT type, {S.valid_type('type')} AS valid, CAST(count(*) AS BIGINT) AS n FROM inc GROUP BY ALL""",
                                        S.INCOMING))
def q_type_validation(spark, sf):
    inc = incoming_from_memories(mem(spark, sf))
    return inc.groupBy("type", is_valid_type("type").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# --- F3 / F4 -----------------------------------------------------------------
@register("redact_scan", S.with_mem(f"""
SELECT id, clean_text, array_to_string(f, ', ') AS findings, len(f) = 0 AS clean
FROM (SELECT id, clean_text, {S.findings('clean_text')} AS f
      FROM (SELECT id, {S.redact('text')} AS clean_text FROM inc))""", S.INCOMING))
def q_redact_scan(spark, sf):
    inc = incoming_from_memories(mem(spark, sf))
    out = inc.select("id", redact("text").alias("clean_text")).withColumn("f", scan_findings("clean_text"))
    return out.select("id", "clean_text", F.array_join("f", ", ").alias("findings"),
                      (F.size("f") == 0).alias("clean"))


@register("scan_raw_frequency", S.with_mem(f"""
SELECT finding, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({S.findings('text')}) AS finding FROM inc) GROUP BY ALL""",
                                           S.INCOMING))
def q_scan_raw(spark, sf):
    inc = incoming_from_memories(mem(spark, sf))
    return inc.select(F.explode(scan_findings("text")).alias("finding")).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


# --- C1 gate -----------------------------------------------------------------
GATE_SQL_CTES = (S.INCOMING, f"""g AS (
  SELECT id, project, type, source, {S.valid_type('type')} AS valid_type,
         {S.redact('text')} AS clean_text, {S.confidence('source')} AS confidence FROM inc
), g2 AS (
  SELECT *, {S.findings('clean_text')} AS findings FROM g
), nw AS (
  SELECT id, project, type, clean_text, {S.rule_flags('clean_text')}, {S.tech('clean_text')} AS tech
  FROM g2 WHERE valid_type AND len(findings) = 0
), ex AS (
  SELECT id, project, type, summary, created_at, {S.rule_flags('summary')}, {S.tech('summary')} AS tech
  FROM memc WHERE approved
), cand AS (
  SELECT n.id AS nid, e.id AS eid, e.created_at, e.summary AS esum, e.tech AS etech,
         n.tech AS ntech, n.clean_text AS ntext, n.type AS ntype, {S.first_rule('n', 'e')} AS rule
  FROM nw n JOIN ex e ON n.project = e.project AND n.type = e.type
), win AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY created_at DESC, eid) AS rn
                 FROM cand WHERE rule IS NOT NULL) WHERE rn = 1
), gated AS (
  SELECT g2.*, w.eid AS conflict_with, w.rule AS conflict_rule,
    CASE WHEN w.rule = {len(S.rules.OPPOSITE_RULES) + 1} THEN
      'Possible technology conflict in ''' || w.ntype || ''' memories.' || chr(10) || '  Existing [' || CAST(w.eid AS VARCHAR)
      || '] mentions: ' || array_to_string(w.etech, ', ') || chr(10) || '  New memory mentions: '
      || array_to_string(w.ntech, ', ') || chr(10) || '  Please confirm which is correct.'
    WHEN w.rule IS NOT NULL THEN
      'Possible ' || {S.rule_label('w.rule')} || ' conflict detected.' || chr(10) || '  Existing ['
      || CAST(w.eid AS VARCHAR) || ']: ' || substr(w.esum, 1, 100) || chr(10) || '  New memory: ' || substr(w.ntext, 1, 100)
    END AS conflict_description
  FROM g2 LEFT JOIN win w ON g2.id = w.nid
), final AS (
  SELECT *,
    CASE WHEN NOT valid_type THEN 'error' WHEN len(findings) > 0 THEN 'blocked'
         WHEN conflict_with IS NOT NULL THEN 'conflict_detected' ELSE 'pending' END AS status,
    CASE WHEN NOT valid_type THEN 'Invalid memory type ''' || coalesce(type, 'None') || '''. Valid types: {S.rules.invalid_type_reason_suffix()}'
         WHEN len(findings) > 0 THEN 'Secret scan failed: ' || array_to_string(findings, ', ') || '. Redact before storing.'
         WHEN conflict_with IS NOT NULL THEN conflict_description END AS reason
  FROM gated
)""")


def gated(spark, sf, mode="approval_required", check_conflicts=True):
    m = mem(spark, sf)
    return gate_ops.gate(incoming_from_memories(m), m, mode=mode, check_conflicts=check_conflicts)


@register("gate_detail", S.with_mem("""
SELECT id, project, type, status, reason, confidence, conflict_with, conflict_rule FROM final""",
                                    *GATE_SQL_CTES))
def q_gate_detail(spark, sf):
    return gated(spark, sf).select("id", "project", "type", "status", "reason", "confidence",
                                   "conflict_with", "conflict_rule")


@register("gate_status_counts", S.with_mem("""
SELECT project, type, status, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 4) AS avg_confidence
FROM final GROUP BY ALL""", *GATE_SQL_CTES))
def q_gate_counts(spark, sf):
    return gate_ops.status_counts(gated(spark, sf))


@register("findings_frequency", S.with_mem("""
SELECT finding, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(findings) AS finding FROM final) GROUP BY ALL""",
                                           *GATE_SQL_CTES))
def q_findings(spark, sf):
    return gate_ops.findings_frequency(gated(spark, sf, check_conflicts=False))


@register("ingest_tally", S.with_mem("""
SELECT project, CASE WHEN status IN ('stored', 'pending') THEN 'stored' ELSE 'skipped' END AS outcome,
  CAST(count(*) AS BIGINT) AS n FROM final GROUP BY ALL""", *GATE_SQL_CTES))
def q_tally(spark, sf):
    return gate_ops.ingest_tally(gated(spark, sf))


# =============================================================================
# Store listings and look-ups
# =============================================================================
from ..functions.text import preview  # noqa: E402
from ..operators import conflicts as conflict_ops  # noqa: E402
from ..operators import reports as report_ops  # noqa: E402
from ..operators import store as store_ops  # noqa: E402


@register("memory_listing", S.with_mem(f"""
SELECT id, {S.preview('summary')} AS summary, type, project, confidence, approved,
  {S.ts('created_at')} AS created_at, source, {sql_joined('tags')} AS tags
FROM memc WHERE approved"""))
def q_listing(spark, sf):
    out = store_ops.memory_listing(mem(spark, sf))
    return out.withColumn("tags", joined("tags"))


@register("pending_listing", S.with_mem(f"""
SELECT id, project, type, substr(summary, 1, 60) AS summary, {S.ts('created_at')} AS created_at
FROM memc WHERE NOT approved"""))
def q_pending(spark, sf):
    return store_ops.list_pending(mem(spark, sf)).select(
        "id", "project", "type", F.substring("summary", 1, 60).alias("summary"),
        iso_ts("created_at").alias("created_at"))


@register("audit_listing", S.with_mem(f"""
SELECT id, project, type, substr(summary, 1, 60) AS summary, confidence, approved,
  {S.date('created_at')} AS created_at FROM memc"""))
def q_audit(spark, sf):
    return store_ops.audit_listing(mem(spark, sf))


@register("get_by_ids", S.with_mem(f"""
SELECT id, project, type, {S.preview('summary')} AS summary FROM memc
WHERE id IN (SELECT doc_id FROM labels)"""))
def q_get_many(spark, sf):
    ids = tables.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return store_ops.get_many(mem(spark, sf), ids).select("id", "project", "type",
                                                          preview("summary").alias("summary"))


@register("by_so_url", S.with_mem("""
SELECT id, project, approved, so_url FROM memc
WHERE so_url IN (SELECT 'https://stackoverflow.com/a/' || CAST(doc_id AS VARCHAR) FROM labels)"""))
def q_by_so_url(spark, sf):
    urls = tables.read_table(spark, sf, "labels").select(
        F.concat(F.lit("https://stackoverflow.com/a/"), F.col("doc_id").cast("string")).alias("url"))
    return store_ops.by_so_url(mem(spark, sf), urls).select("id", "project", "approved", "so_url")


@register("commit_groups", S.with_mem("""
SELECT commit_sha, id, substr(summary, 1, 100) AS summary,
  CAST(count(*) OVER (PARTITION BY commit_sha) AS BIGINT) AS group_size
FROM memc WHERE commit_sha IS NOT NULL"""))
def q_commit_groups(spark, sf):
    return store_ops.commit_groups(mem(spark, sf))


@register("commits_for_labeled", S.with_mem("""
SELECT a.id AS memory_id, a.commit_sha, b.id, substr(b.summary, 1, 100) AS summary
FROM memc a JOIN memc b ON a.commit_sha = b.commit_sha AND a.id <> b.id
WHERE a.id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def q_commits_for(spark, sf):
    ids = (tables.read_table(spark, sf, "labels").filter(F.col("toxic") == 1)
           .select(F.col("doc_id").alias("id")))
    return store_ops.commits_for_memory(mem(spark, sf), ids)


@register("related_memories", S.with_mem("""
SELECT l.memory_id, CAST(l.pos - 1 AS INTEGER) AS pos, m.id AS related_id, m.project, m.type,
  substr(m.summary, 1, 100) AS summary
FROM (SELECT id AS memory_id, unnest(related_to) AS rid, generate_subscripts(related_to, 1) AS pos FROM memc) l
JOIN memc m ON m.id = l.rid"""))
def q_related(spark, sf):
    return store_ops.related_memories(mem(spark, sf))


@register("forget_toxic", S.with_mem("""
SELECT project, CAST(count(*) AS BIGINT) AS remaining FROM memc
WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY project"""))
def q_forget(spark, sf):
    ids = (tables.read_table(spark, sf, "labels").filter(F.col("toxic") == 1)
           .select(F.col("doc_id").alias("id")))
    return (store_ops.forget(mem(spark, sf), ids).groupBy("project")
            .agg(F.count(F.lit(1)).alias("remaining")))


@register("approve_quality", S.with_mem("""
SELECT project, CAST(count(*) FILTER (WHERE approved OR hit) AS BIGINT) AS approved,
  CAST(count(*) FILTER (WHERE hit AND NOT approved) AS BIGINT) AS newly_approved
FROM (SELECT m.*, l.doc_id IS NOT NULL AS hit FROM memc m
      LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l ON m.id = l.doc_id)
GROUP BY project"""))
def q_approve(spark, sf):
    ids = (tables.read_table(spark, sf, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
           .select(F.col("doc_id").alias("id")))
    after, newly = store_ops.approve(mem(spark, sf), ids)
    a = after.groupBy("project").agg(F.count_if("approved").alias("approved"))
    n = newly.groupBy("project").agg(F.count(F.lit(1)).alias("newly_approved"))
    return a.join(n, "project", "left").withColumn(
        "newly_approved", F.coalesce("newly_approved", F.lit(0).cast("bigint")))


@register("link_commits_from_events", S.with_mem("""
SELECT m.id, coalesce(l.commit_sha, m.commit_sha) AS commit_sha
FROM memc m LEFT JOIN (
  SELECT memory_id, arg_max(commit_sha, (day, commit_sha)) AS commit_sha
  FROM (SELECT user_id AS memory_id, 'e' || lpad(CAST(event_id AS VARCHAR), 11, '0') AS commit_sha,
          date_trunc('month', ts) AS day FROM events) GROUP BY memory_id) l ON m.id = l.memory_id"""))
def q_link_commits(spark, sf):
    """Links carry their month only, so that many of one memory tie and the larger sha wins."""
    ev = tables.read_table(spark, sf, "events")
    links = ev.select(F.col("user_id").alias("memory_id"),
                      F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 11, "0")).alias("commit_sha"),
                      F.date_trunc("month", "ts").alias("linked_at"))
    return store_ops.link_to_commit(mem(spark, sf), links).select("id", "commit_sha")


@register("link_memories_from_sessions", S.with_mem("""
, pairs AS (SELECT DISTINCT conv_id AS a, conv_id * 7 + 1 AS b FROM conversations),
ok AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM memc) AND b IN (SELECT id FROM memc) AND a <> b),
both_ AS (SELECT a AS id, b AS other FROM ok UNION SELECT b, a FROM ok),
adds AS (SELECT id, list_sort(list(DISTINCT other)) AS adds FROM both_ GROUP BY id)
SELECT m.id, array_to_string(list_transform(
    CASE WHEN adds.adds IS NULL THEN m.related_to
         ELSE m.related_to || list_filter(adds.adds, lambda x: NOT list_contains(m.related_to, x)) END,
    lambda x: CAST(x AS VARCHAR)), '|') AS related_to
FROM memc m LEFT JOIN adds ON m.id = adds.id"""))
def q_link_memories(spark, sf):
    conv = tables.texts(spark, sf, "conversations")
    pairs = conv.select(F.col("conv_id").alias("a"), (F.col("conv_id") * 7 + 1).alias("b")).distinct()
    after, _outcome = store_ops.link_memories(mem(spark, sf), pairs)
    return after.select("id", joined("related_to").alias("related_to"))


# --- reports -----------------------------------------------------------------
@register("memory_counts", S.with_mem("""
SELECT project, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT approved) AS BIGINT) AS pending,
  CAST(count(*) FILTER (WHERE approved) AS BIGINT) AS approved FROM memc GROUP BY ROLLUP (project)"""))
def q_counts(spark, sf):
    return report_ops.counts(mem(spark, sf))


@register("count_by_type", S.with_mem("""
SELECT type, CAST(count(*) AS BIGINT) AS n FROM memc WHERE approved GROUP BY type"""))
def q_count_by_type(spark, sf):
    return report_ops.count_by_type(mem(spark, sf))


@register("project_context", S.with_mem(f"""
SELECT project, type, id, summary, confidence, source, {S.date('created_at')} AS created_at,
  CAST(count(*) OVER (PARTITION BY project, type) AS BIGINT) AS type_count,
  CAST(count(*) OVER (PARTITION BY project) AS BIGINT) AS total
FROM memc WHERE approved"""))
def q_project_context(spark, sf):
    return report_ops.project_context(mem(spark, sf))


@register("newest_per_type", S.with_mem("""
SELECT project, type, id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC, id) AS rank
  FROM memc WHERE approved) WHERE rank <= 3"""))
def q_newest(spark, sf):
    return report_ops.newest_per_type(mem(spark, sf), 3).select("project", "type", "id", "rank")


PR_CTES = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC, id) AS rank
          FROM memc WHERE approved AND type IN ('decision', 'fix', 'bug', 'architecture')) WHERE rank <= 5),
p AS (SELECT project, CAST(count(*) FILTER (WHERE approved) AS BIGINT) AS total_memories FROM memc GROUP BY project)"""
REL_CTE = """rel AS (SELECT project, type, id, document, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY s DESC, id) AS r FROM scored WHERE query_id = 0) WHERE r <= 8)"""


def _pr_sql(head: str, relevant: str, *ctes: str) -> str:
    secs = []
    for t, h, k in S.rules.PR_SECTIONS:
        items = (f"(SELECT string_agg('- ' || substr(summary, 1, 100), chr(10) ORDER BY rank) FROM top t2 "
                 f"WHERE t2.project = p.project AND t2.type = '{t}' AND t2.rank <= {k})")
        secs.append(f"coalesce('{h}' || chr(10) || {items} || chr(10) || chr(10), '')")
    ntypes = " + ".join(f"(CASE WHEN EXISTS (SELECT 1 FROM top t3 WHERE t3.project = p.project AND t3.type = '{t}') "
                        f"THEN 1 ELSE 0 END)" for t, _h, _k in S.rules.PR_SECTIONS)
    return S.with_mem(f"""
SELECT project, '## Summary' || chr(10) || chr(10) || {head} || {relevant} || {' || '.join(secs)} || '## Test plan'
  || chr(10) || chr(10) || '- [ ] ...' || chr(10) || chr(10) || '_Generated from ' || project || ' memory — '
  || CAST({ntypes} AS VARCHAR) || ' memory types referenced._' AS template,
  total_memories, CAST({ntypes} AS INTEGER) AS types_referenced
FROM p""", *ctes, PR_CTES)


@register("pr_drafts", _pr_sql("''", "''"))
def q_pr(spark, sf):
    return report_ops.pr_drafts(mem(spark, sf))


@register("portfolio_lines", S.with_mem(f"""
, items AS (
  SELECT project, CASE WHEN type = 'portfolio' THEN 1 ELSE 2 END AS section,
    -epoch_us(created_at) AS k_time, id AS k_id,
    '- ' || summary || '  _' || {S.date('created_at')} || '_' AS line
  FROM memc WHERE approved AND type IN ('portfolio', 'resume')
  UNION ALL
  SELECT project, CASE WHEN type = 'decision' THEN 3 ELSE 4 END, -epoch_us(created_at), id,
    '- ' || substr(summary, 1, 120)
  FROM (SELECT *, row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC, id) AS rk
        FROM memc WHERE approved AND type IN ('decision', 'architecture')) WHERE rk <= 5
), present AS (SELECT DISTINCT project, section FROM items),
projects AS (SELECT DISTINCT project FROM memc)
SELECT project, 0 AS section, -{2 ** 62} AS k_time, CAST(NULL AS BIGINT) AS k_id,
  '# Portfolio — ' || project || chr(10) AS line FROM projects
UNION ALL
SELECT project, section, -{2 ** 62}, NULL,
  CASE section WHEN 1 THEN '## Highlights' WHEN 2 THEN '## Achievements'
    WHEN 3 THEN '## Key Technical Decisions' ELSE '## Architecture Notes' END || chr(10) FROM present
UNION ALL SELECT * FROM items
UNION ALL SELECT project, section, {2 ** 62}, NULL, '' FROM present
UNION ALL
SELECT project, 5, pos - 1, NULL, line FROM (
  SELECT project, unnest(['_No portfolio, resume, decision, or architecture memories found._' || chr(10),
     'Store some with:' || chr(10), '```', 'memweave remember "..." --type portfolio',
     'memweave remember "..." --type resume', '```']) AS line,
     generate_subscripts(['a','b','c','d','e','f'], 1) AS pos
  FROM projects WHERE project NOT IN (SELECT project FROM present))"""))
def q_portfolio_lines(spark, sf):
    out = report_ops.portfolio_lines(mem(spark, sf))
    return out.select("project", "section", F.col("ord.k_time").alias("k_time"),
                      F.col("ord.k_id").alias("k_id"), "line")


@register("portfolio_all", S.with_mem(f"""
, items AS (
  SELECT CASE WHEN type = 'portfolio' THEN 1 ELSE 2 END AS section, -epoch_us(created_at) AS k_time, id AS k_id,
    '- ' || summary || '  _' || {S.date('created_at')} || '_' AS line
  FROM memc WHERE approved AND type IN ('portfolio', 'resume')
  UNION ALL
  SELECT CASE WHEN type = 'decision' THEN 3 ELSE 4 END, -epoch_us(created_at), id, '- ' || substr(summary, 1, 120)
  FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id) AS rk
        FROM memc WHERE approved AND type IN ('decision', 'architecture')) WHERE rk <= 5
), present AS (SELECT DISTINCT section FROM items)
SELECT 0 AS section, -{2 ** 62} AS k_time, CAST(NULL AS BIGINT) AS k_id, '# Portfolio' || chr(10) AS line
UNION ALL
SELECT section, -{2 ** 62}, NULL, CASE section WHEN 1 THEN '## Highlights' WHEN 2 THEN '## Achievements'
    WHEN 3 THEN '## Key Technical Decisions' ELSE '## Architecture Notes' END || chr(10) FROM present
UNION ALL SELECT * FROM items
UNION ALL SELECT section, {2 ** 62}, NULL, '' FROM present"""))
def q_portfolio_all(spark, sf):
    return report_ops.portfolio_lines(mem(spark, sf), all_projects=True).select(
        "section", F.col("ord.k_time").alias("k_time"), F.col("ord.k_id").alias("k_id"), "line")


@register("portfolio_summary", S.with_mem("""
SELECT project, CAST(count(*) AS BIGINT) AS total_memories,
  CAST(count(*) FILTER (WHERE type IN ('portfolio', 'resume')) AS BIGINT) AS highlight_count
FROM memc WHERE approved GROUP BY project"""))
def q_portfolio_summary(spark, sf):
    return report_ops.portfolio_summary(mem(spark, sf))


# =============================================================================
# Summaries (T4, C3) and session archive (S3)
# =============================================================================
from ..operators import summarize as summ  # noqa: E402


@register("document_summaries", f"SELECT doc_id, {S.summary('text')} AS summary FROM documents")
def q_doc_summaries(spark, sf):
    docs = tables.texts(spark, sf)
    return summ.summarize_rows(docs, "doc_id")


SESSIONS_SQL = """sessions AS (
  SELECT conv_id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS project,
    string_agg(text, chr(10) ORDER BY turn) AS text, CAST(count(*) AS BIGINT) AS turns
  FROM conversations GROUP BY conv_id)"""


def sessions(spark, sf):
    conv = tables.texts(spark, sf, "conversations")
    return (summ.sessions_from_turns(conv)
            .withColumn("project", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))))


def summarized_sessions(spark, sf):
    return (summ.summarize_sessions(tables.read_table(spark, sf, "conversations"))
            .withColumn("project", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))))


@register("session_summaries", S.with_mem(
    f"SELECT conv_id, project, turns, {S.summary('text')} AS summary FROM sessions", SESSIONS_SQL))
def q_session_summaries(spark, sf):
    return summarized_sessions(spark, sf).select("conv_id", "project", "turns", "summary")


@register("session_auto_store", S.with_mem(f"""
, given AS (SELECT conv_id AS id, project, {S.redact(S.summary('text'))} AS summary FROM sessions)
SELECT id, project, 'general' AS type, 'session' AS source, summary, CAST(0.7 AS DOUBLE) AS confidence,
  CASE WHEN len({S.findings('summary')}) > 0 THEN 'blocked' ELSE 'pending' END AS status FROM given""", SESSIONS_SQL))
def q_session_auto_store(spark, sf):
    """Summaries through the gate, against all approved memories of their project and type."""
    offered = summ.session_memories(summarized_sessions(spark, sf))
    return gate_ops.gate(offered, mem(spark, sf)).select(
        "id", "project", "type", "source", F.col("clean_text").alias("summary"), "confidence", "status")


@register("session_archive_rows", S.with_mem("""
SELECT project, '2024-06-01' AS date, '2024-06-01T00:00:00.000000Z' AS captured_at, text FROM sessions""",
                                             SESSIONS_SQL))
def q_archive_rows(spark, sf):
    fixed = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return summ.archive_rows(sessions(spark, sf), captured_at=fixed)


# =============================================================================
# Recall (T1-T3, T5, A6, A7, D1, P8, S9)
# =============================================================================
from ..operators import recall as recall_ops  # noqa: E402

RECALL_CTES = ("""idx AS (
  SELECT m.id, m.summary AS document, m.project, m.type, m.source, m.created_at, m.confidence, m.so_url,
    m.related_files, m.tags, CAST(e.embedding AS DOUBLE[]) AS emb
  FROM memc m JOIN embeddings e ON e.vec_id = m.id WHERE m.approved)""", """cent AS (
  SELECT query_id, list(v ORDER BY pos) AS qv FROM (
    SELECT CAST(label AS BIGINT) AS query_id, pos, avg(CAST(x AS DOUBLE)) AS v FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY query_id)""", """scored AS (
  SELECT c.query_id, i.*, list_cosine_similarity(i.emb, c.qv) AS s FROM cent c, idx i)""")


def _recall_inputs(spark, sf):
    m = mem(spark, sf)
    emb = tables.read_table(spark, sf, "embeddings")
    return m, recall_ops.vector_index(m, emb), recall_ops.label_centroids(emb)


@register("recall_centroids", S.with_mem(f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, document AS summary, round(s, 4) AS score, source, project, type,
  {S.ts('created_at')} AS created_at, confidence, {sql_joined('related_files')} AS related_files,
  {sql_joined('tags')} AS tags
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored) WHERE rank <= 5""",
                                         *RECALL_CTES))
def q_recall(spark, sf):
    m, idx, queries = _recall_inputs(spark, sf)
    r = recall_ops.recall(m, idx, queries, 5)
    return r.select("query_id", "rank", "id", "summary", "score", "source", "project", "type",
                    iso_ts("created_at").alias("created_at"), "confidence",
                    joined("related_files").alias("related_files"), joined("tags").alias("tags"))


@register("recall_patterns", S.with_mem(f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, document AS summary, round(s, 4) AS score, so_url, confidence,
  project, {S.date('created_at')} AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored
      WHERE type = 'pattern') WHERE rank <= 5""", *RECALL_CTES))
def q_recall_patterns(spark, sf):
    m, idx, queries = _recall_inputs(spark, sf)
    return recall_ops.recall_patterns(m, idx, queries, 5)


@register("debug_suggest", S.with_mem(f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, type, document AS summary, round(s, 4) AS score, source, confidence,
  {S.date('created_at')} AS created_at, CASE WHEN type = 'pattern' THEN so_url END AS so_url
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 4) DESC,
          CASE type WHEN 'bug' THEN 1 WHEN 'fix' THEN 2 ELSE 3 END, trank) AS rank FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY s DESC, id) AS trank
                       FROM scored WHERE type IN ('bug', 'fix', 'pattern')) WHERE trank <= 5))
WHERE rank <= 5""", *RECALL_CTES))
def q_debug(spark, sf):
    m, idx, queries = _recall_inputs(spark, sf)
    return recall_ops.debug_suggest(m, idx, queries, 5)


def _context_hits(spark, sf):
    """The context of the drafts: label 0's mean vector, the best eight memories of each project."""
    m, idx, queries = _recall_inputs(spark, sf)
    return m, recall_ops.top_k(idx, queries.where("query_id = 0"), 8, group_col="project")


@register("pr_drafts_context", _pr_sql(
    "'Label 0' || chr(10) || chr(10)",
    """coalesce('**Relevant context from memory:**' || chr(10) || (
      SELECT string_agg('- [' || type || '] ' || substr(document, 1, 100), chr(10) ORDER BY rank) FROM rel
      WHERE rel.project = p.project AND rel.rank <= 3) || chr(10) || chr(10), '')""", *RECALL_CTES, REL_CTE))
def q_pr_context(spark, sf):
    m, hits = _context_hits(spark, sf)
    return report_ops.pr_drafts(m, context=" Label 0 ", hits=hits)


@register("pr_draft_items", S.with_mem("""
SELECT project, type AS section, CAST(rank AS INTEGER) AS rank, id, substr(summary, 1, 120) AS summary FROM top
UNION ALL SELECT project, 'relevant', rank, id, document FROM rel WHERE rank <= 5""", *RECALL_CTES, REL_CTE, PR_CTES))
def q_pr_items(spark, sf):
    m, hits = _context_hits(spark, sf)
    return report_ops.pr_draft_items(m, hits)


@register("recall_project", S.with_mem("""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, project, type, round(s, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored
      WHERE project = 'src3') WHERE rank <= 5""", *RECALL_CTES))
def q_recall_project(spark, sf):
    m, idx, queries = _recall_inputs(spark, sf)
    return recall_ops.recall(m, idx, queries, 5, project="src3").select("query_id", "rank", "id", "project", "type", "score")


@register("recall_patterns_project", S.with_mem(f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, document AS summary, round(s, 4) AS score, so_url, confidence,
  project, {S.date('created_at')} AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored
      WHERE type = 'pattern' AND project = 'src7') WHERE rank <= 5""", *RECALL_CTES))
def q_recall_patterns_project(spark, sf):
    m, idx, queries = _recall_inputs(spark, sf)
    return recall_ops.recall_patterns(m, idx, queries, 5, project="src7")


@register("debug_suggest_project", S.with_mem("""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, type, round(s, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 4) DESC,
          CASE type WHEN 'bug' THEN 1 WHEN 'fix' THEN 2 ELSE 3 END, trank) AS rank FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY s DESC, id) AS trank
                       FROM scored WHERE type IN ('bug', 'fix', 'pattern') AND project = 'src5') WHERE trank <= 3))
WHERE rank <= 3""", *RECALL_CTES))
def q_debug_project(spark, sf):
    m, idx, queries = _recall_inputs(spark, sf)
    return recall_ops.debug_suggest(m, idx, queries, 3, project="src5").select("query_id", "rank", "id", "type", "score")


TEXT_CTES = (r"""tok AS (
  SELECT id, token, count(*) AS tf FROM (
    SELECT id, unnest(regexp_extract_all(lower(summary), '[\p{L}\p{N}_]+')) AS token FROM memc WHERE approved) GROUP BY ALL)""",
             """idf AS (
  SELECT token, ln(((SELECT count(*) FROM memc WHERE approved) + 1) / (count(*) + 1)) + 1 AS idf FROM tok GROUP BY token)""",
             """dw AS (SELECT id, token, (1 + ln(tf)) * idf AS w FROM tok JOIN idf USING (token))""",
             r"""qw AS (
  SELECT item_id AS query_id, token, (1 + ln(tf)) * idf AS w FROM (
    SELECT item_id, token, count(*) AS tf FROM (
      SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) GROUP BY ALL)
  JOIN idf USING (token))""",
             """sim AS (
  SELECT query_id, id, round(sum(d.w * q.w) / (any_value(dl) * any_value(ql)), 9) AS s
  FROM dw d JOIN qw q USING (token)
  JOIN (SELECT id, sqrt(sum(w * w)) AS dl FROM dw GROUP BY id) USING (id)
  JOIN (SELECT query_id, sqrt(sum(w * w)) AS ql FROM qw GROUP BY query_id) USING (query_id) GROUP BY query_id, id)""")


@register("recall_text", S.with_mem(f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, r.id, m.summary, round(s, 4) AS score, m.source, m.project, m.type,
  {S.ts('m.created_at')} AS created_at, m.confidence
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sim) r JOIN memc m ON m.id = r.id
WHERE rank <= 5""", *TEXT_CTES))
def q_recall_text(spark, sf):
    queries = tables.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return recall_ops.recall_text(mem(spark, sf), queries, 5).select(
        "query_id", "rank", "id", "summary", "score", "source", "project", "type",
        iso_ts("created_at").alias("created_at"), "confidence")


@register("vector_index_counts", S.with_mem("""
SELECT project, type, CAST(count(*) AS BIGINT) AS entries FROM idx GROUP BY ALL""", RECALL_CTES[0]))
def q_index_counts(spark, sf):
    _m, idx, _q = _recall_inputs(spark, sf)
    return idx.groupBy("project", "type").agg(F.count(F.lit(1)).alias("entries"))


@register("vector_upsert_approved", S.with_mem("""
, appr AS (SELECT m.* REPLACE (m.approved OR l.doc_id IS NOT NULL AS approved) FROM memc m
           LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l ON m.id = l.doc_id),
ix AS (SELECT a.id, a.project, a.type FROM appr a JOIN embeddings e ON e.vec_id = a.id WHERE a.approved)
SELECT project, CAST(count(*) AS BIGINT) AS entries FROM ix GROUP BY project"""))
def q_upsert(spark, sf):
    m = mem(spark, sf)
    emb = tables.read_table(spark, sf, "embeddings")
    idx = recall_ops.vector_index(m, emb)
    ids = (tables.read_table(spark, sf, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
           .select(F.col("doc_id").alias("id")))
    _after, newly = store_ops.approve(m, ids)
    updates = recall_ops.vector_index(newly.withColumn("approved", F.lit(True)), emb)
    return (store_ops.upsert_vectors(idx, updates).groupBy("project")
            .agg(F.count(F.lit(1)).alias("entries")))


@register("vector_upsert_latest", S.with_mem("""
, up AS (SELECT e.vec_id AS id, v.version, m.project || '/' || CAST(v.version AS VARCHAR) AS project
  FROM embeddings e JOIN memc m ON m.id = e.vec_id CROSS JOIN (VALUES (1), (2), (3)) v(version) WHERE e.vec_id % 3 = 0 AND v.version <= 1 + e.vec_id % 3 + e.vec_id % 2 * 2),
ix AS (SELECT m.id, m.project FROM memc m JOIN embeddings e ON e.vec_id = m.id WHERE m.approved),
last AS (SELECT id, arg_max(project, version) AS project FROM up GROUP BY id)
SELECT id, project FROM last UNION ALL SELECT id, project FROM ix WHERE id NOT IN (SELECT id FROM last)""", ))
def q_upsert_latest(spark, sf):
    """Several updates of one id in one batch: the one of highest version stays."""
    m = mem(spark, sf)
    emb = tables.read_table(spark, sf, "embeddings")
    d = F.col("id")
    updates = (recall_ops.vector_index(m.withColumn("approved", F.lit(True)), emb).where(d % 3 == 0)
               .withColumn("version", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(3), 1 + d % 3 + d % 2 * 2))))
               .withColumn("project", F.concat_ws("/", "project", F.col("version").cast("string"))))
    return store_ops.upsert_vectors(recall_ops.vector_index(m, emb), updates).select("id", "project")


# =============================================================================
# Graph (G1-G5, T8) - the oracle enumerates pairs (fine at sf0.01), Spark never does
# =============================================================================
from ..operators import graph as graph_ops  # noqa: E402

GRAPH_CTES = ("""nd AS (SELECT project, id, type, summary, source, confidence, created_at, tags, related_to,
  row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS lrank FROM memc WHERE approved)""",
              """ex AS (SELECT DISTINCT l.project, least(l.a, l.b) AS u, greatest(l.a, l.b) AS v
  FROM (SELECT project, id AS a, unnest(related_to) AS b FROM nd) l
  JOIN nd m ON m.project = l.project AND m.id = l.b WHERE l.a <> l.b)""",
              """pr AS (SELECT a.project, a.id AS u, b.id AS v,
    CASE WHEN ex.u IS NOT NULL THEN 'explicit' WHEN list_has_any(a.tags, b.tags) THEN 'shared_tag'
         WHEN a.type = b.type THEN 'same_type' END AS reason
  FROM nd a JOIN nd b ON a.project = b.project AND a.id < b.id
  LEFT JOIN ex ON ex.project = a.project AND ex.u = a.id AND ex.v = b.id)""",
              """e AS (SELECT * FROM pr WHERE reason IS NOT NULL)""",
              """adjn AS (SELECT project, u AS a, v AS b, reason FROM e UNION ALL SELECT project, v, u, reason FROM e)""",
              """deg AS (SELECT n.project, n.id, n.summary, n.lrank, count(x.b) AS degree FROM nd n
  LEFT JOIN adjn x ON x.project = n.project AND x.a = n.id GROUP BY n.project, n.id, n.summary, n.lrank)""",
              """top AS (SELECT project, id, degree, substr(summary, 1, 120) AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY degree DESC, lrank) AS r FROM deg) WHERE r = 1)""")

GRAPH_SUMMARY_SQL = S.with_mem("""
, reach AS (SELECT project, id AS src, id AS dst FROM nd
  UNION SELECT r.project, r.src, j.b FROM reach r JOIN adjn j ON j.project = r.project AND j.a = r.dst),
lab AS (SELECT project, src, min(dst) AS label FROM reach GROUP BY ALL),
comp AS (SELECT project, CAST(count(*) AS BIGINT) AS components, CAST(max(c) AS BIGINT) AS largest_component
         FROM (SELECT project, label, count(*) AS c FROM lab GROUP BY ALL) GROUP BY project),
ec AS (SELECT project, CAST(count(*) FILTER (WHERE reason = 'explicit') AS BIGINT) AS explicit,
         CAST(count(*) FILTER (WHERE reason = 'shared_tag') AS BIGINT) AS shared_tag,
         CAST(count(*) FILTER (WHERE reason = 'same_type') AS BIGINT) AS same_type FROM e GROUP BY project),
nn AS (SELECT project, CAST(count(*) AS BIGINT) AS nodes FROM nd GROUP BY project)
SELECT nn.project, nodes, coalesce(explicit, 0) + coalesce(shared_tag, 0) + coalesce(same_type, 0) AS edges,
  components, largest_component, top.id AS most_connected_id, CAST(top.degree AS BIGINT) AS most_connected_degree,
  top.s AS most_connected_summary, coalesce(explicit, 0) AS explicit, coalesce(shared_tag, 0) AS shared_tag,
  coalesce(same_type, 0) AS same_type
FROM nn JOIN comp USING (project) JOIN top USING (project) LEFT JOIN ec USING (project)""",
                               *GRAPH_CTES).replace("WITH mem AS", "WITH RECURSIVE mem AS", 1)


@register("graph_summary", GRAPH_SUMMARY_SQL)
def q_graph_summary(spark, sf):
    return graph_ops.summary(mem(spark, sf))


@register("graph_neighbors_hub", S.with_mem("""
, h1 AS (SELECT t.project, t.id AS start, j.b AS id, 1 AS hop, j.reason FROM top t
         JOIN adjn j ON j.project = t.project AND j.a = t.id),
h2 AS (SELECT DISTINCT h.project, h.start, j.b AS id, 2 AS hop, CAST(NULL AS VARCHAR) AS reason FROM h1 h
       JOIN adjn j ON j.project = h.project AND j.a = h.id
       WHERE j.b <> h.start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.project = h.project AND x.start = h.start AND x.id = j.b)),
tp AS (SELECT n.project, n.id, t.tag, min(n.lrank * 1000 + t.pos) AS k FROM nd n,
       (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM nd) t WHERE t.id = n.id GROUP BY ALL),
trank AS (SELECT project, tag, min(k) AS k FROM tp GROUP BY ALL),
ft AS (SELECT h.project, h.start, h.id, arg_min(a.tag, r.k) AS first_tag FROM h1 h
       JOIN tp a ON a.project = h.project AND a.id = h.start
       JOIN tp b ON b.project = h.project AND b.id = h.id AND b.tag = a.tag
       JOIN trank r ON r.project = h.project AND r.tag = a.tag GROUP BY ALL),
allh AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
SELECT allh.start, allh.id, CAST(allh.hop AS INTEGER) AS hop,
  CASE WHEN allh.hop > 1 THEN 'indirect' WHEN allh.reason = 'shared_tag' THEN 'shared_tag:' || ft.first_tag
       ELSE allh.reason END AS connection,
  CAST(CASE WHEN allh.hop > 1 THEN 0.0 WHEN allh.reason = 'explicit' THEN 1.0 WHEN allh.reason = 'shared_tag' THEN 0.7
       ELSE 0.4 END AS DOUBLE) AS weight,
  n.type, n.project, substr(n.summary, 1, 120) AS summary, n.source, n.confidence, strftime(n.created_at, '%Y-%m-%d') AS created_at
FROM allh JOIN nd n ON n.project = allh.project AND n.id = allh.id
LEFT JOIN ft ON ft.project = allh.project AND ft.start = allh.start AND ft.id = allh.id""", *GRAPH_CTES))
def q_graph_neighbors(spark, sf):
    m = mem(spark, sf)
    return graph_ops.neighbors(m, graph_ops.most_connected(m), depth=2)


# =============================================================================
# Exports and ingest
# =============================================================================
from ..functions.text import parse_json_list, so_canonical_url, so_url_kind_id, strip_html  # noqa: E402
from ..sources import exports as ex  # noqa: E402


def _exports(spark, sf):
    orders = tables.read_table(spark, sf, "orders")
    commits = commit_raw = ex.parse_json_column(ex.commits_json_from_orders(orders), "json", ex.COMMIT_SCHEMA)
    prs = ex.parse_json_column(ex.prs_json_from_orders(orders), "json", ex.PR_SCHEMA)
    issues = ex.parse_issues(ex.issues_json_from_orders(orders), "json")
    return ex.commit_rows(commit_raw), prs, issues


SQL_PROJECT = "'src' || CAST(o_custkey % 20 AS VARCHAR)"
GH_CTES = (f"""gh AS (
  SELECT {SQL_PROJECT} AS project, 'fix' AS type, 'github_commit' AS source, sha AS commit_sha, sha AS key,
    '[' || sha || '] ' || msg || ' — by ' || author || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS text
  FROM (SELECT *, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS sha,
          CASE WHEN o_orderkey % 50 = 0 THEN '  ' WHEN o_orderkey % 50 = 25 THEN chr(9) ELSE 'Fix ' || lower(o_orderpriority) || ' order ' || CAST(o_orderkey AS VARCHAR) END AS msg,
          CASE WHEN o_custkey % 5 <> 0 THEN 'cust' || CAST(o_custkey AS VARCHAR) ELSE 'unknown' END AS author
        FROM orders) WHERE regexp_matches(msg, '[^ \t]')
  UNION ALL
  SELECT {SQL_PROJECT}, 'fix', 'github_pr', NULL, CAST(o_orderkey AS VARCHAR),
    'PR #' || CAST(o_orderkey AS VARCHAR) || ': Merge ' || lower(o_orderpriority)
      || CASE WHEN length(b) > 0 THEN chr(10) || b ELSE '' END
  FROM (SELECT *, substr(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN repeat('body ', CAST(o_orderkey % 150 AS INTEGER)) END, ''), 1, 500) AS b
        FROM orders WHERE o_orderstatus = 'F')
  UNION ALL
  SELECT {SQL_PROJECT}, 'bug', 'github_issue', NULL, CAST(o_orderkey AS VARCHAR),
    'Issue #' || CAST(o_orderkey AS VARCHAR) || ' (closed): Problem with ' || lower(o_orderpriority) || CASE WHEN length(b) > 0 THEN chr(10) || b ELSE '' END
  FROM (SELECT *, substr(coalesce(CASE WHEN o_orderkey % 4 <> 1 THEN 'token = ' || repeat('9', CAST(o_orderkey % 9 AS INTEGER)) END, ''), 1, 500) AS b
        FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 = 2)
)""", f"""ghs AS (
  SELECT *, CASE WHEN len({S.findings('clean_text')}) > 0 THEN 'skipped' ELSE 'stored' END AS status
  FROM (SELECT *, {S.redact('text')} AS clean_text FROM gh))""")


def _ingest(spark, sf, mem=None):
    commits, prs, issues = _exports(spark, sf)
    return ex.repo_ingest(commits, prs, issues, mem)


@register("github_ingest", S.with_mem("""
SELECT project, type, source, commit_sha, key, clean_text, status, CAST(0.8 AS DOUBLE) AS confidence FROM ghs""",
                                      *GH_CTES))
def q_github_ingest(spark, sf):
    return _ingest(spark, sf).select("project", "type", "source", "commit_sha", "key", "clean_text",
                                     "status", "confidence")


@register("github_ingest_tally", S.with_mem("""
SELECT project, source, status, CAST(count(*) AS BIGINT) AS n FROM ghs GROUP BY ALL""", *GH_CTES))
def q_github_tally(spark, sf):
    return _ingest(spark, sf).groupBy("project", "source", "status").agg(F.count(F.lit(1)).alias("n"))


@register("github_reingest", S.with_mem("""
SELECT project, source, CASE WHEN status = 'stored' THEN 'duplicate' ELSE status END AS status,
  CAST(count(*) AS BIGINT) AS n FROM ghs GROUP BY ALL""", *GH_CTES))
def q_github_reingest(spark, sf):
    """A second ingest of the same exports, with the memory table that the first one left."""
    stored = ex.ingested_memories(_ingest(spark, sf), now=F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return (_ingest(spark, sf, stored).groupBy("project", "source", "status").agg(F.count(F.lit(1)).alias("n")))


def _damaged(exports):
    """Every 97th order's line is cut off, every 97th after it is no object, and one after that has a text for a number."""
    k = F.col("k")
    return exports.select("project", F.when(k % 97 == 0, F.expr("substr(json, 1, length(json) - 3)"))
                          .when(k % 97 == 1, F.lit("[1, 2]"))
                          .when(k % 97 == 2, F.lit('{"number": "x", "commit": "y"}')).otherwise(F.col("json")).alias("json"))


@register("github_ingest_errors", S.with_mem(f"""
, lines AS (
  SELECT *, CASE WHEN o_orderkey % 97 = 1 THEN 'not a JSON object' WHEN o_orderkey % 97 IN (0, 2) THEN 'unreadable record' END AS error,
    {SQL_PROJECT} AS project, source FROM orders, (VALUES ('github_commit'), ('github_pr'), ('github_issue')) v(source)
  WHERE source = 'github_commit' OR (source = 'github_pr' AND o_orderstatus = 'F') OR (source = 'github_issue' AND o_orderstatus = 'O')),
ranked AS (
  SELECT project, source, o_orderkey, CASE source WHEN 'github_commit' THEN substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12)
           ELSE CAST(o_orderkey AS VARCHAR) END AS key,
    row_number() OVER (PARTITION BY project, source ORDER BY CASE WHEN source = 'github_commit' THEN o_orderdate END DESC,
      CASE WHEN source = 'github_commit' THEN substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) END, o_orderkey DESC) AS nth
  FROM lines WHERE error IS NULL AND (source <> 'github_issue' OR o_orderkey % 2 = 0))
SELECT ghs.project, ghs.source, status, NULL AS error, CAST(count(*) AS BIGINT) AS n FROM ghs JOIN ranked r
  ON r.project = ghs.project AND r.source = ghs.source AND r.key = ghs.key
WHERE nth <= CASE ghs.source WHEN 'github_commit' THEN 200 ELSE 100 END GROUP BY ALL
UNION ALL
SELECT project, source, 'error', error, CAST(count(*) AS BIGINT) FROM lines WHERE error IS NOT NULL GROUP BY ALL""", *GH_CTES))
def q_github_errors(spark, sf):
    """Ingest of exports with broken lines, the 200 newest commits, 100 newest PRs and issues of each project."""
    orders = tables.read_table(spark, sf, "orders")
    commits, prs, issues = (_damaged(export(orders, keep=("k",))) for export in (
        ex.commits_json_from_orders, ex.prs_json_from_orders, ex.issues_json_from_orders))
    rows = ex.repo_ingest(ex.commit_rows(ex.parse_json_column(commits, "json", ex.COMMIT_SCHEMA)),
                          ex.parse_json_column(prs, "json", ex.PR_SCHEMA), ex.parse_issues(issues, "json"),
                          commit_limit=200, pr_limit=100, issue_limit=100)
    return rows.groupBy("project", "source", "status", "error").agg(F.count(F.lit(1)).alias("n"))


ANSWER_KEY = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey * 1000 + l_partkey % 1000)"
QA_CTES = (f"""ans AS (
  SELECT {ANSWER_KEY} AS answer_id, l_partkey AS question_id,
    {S.strip_html("'<div><p>Ship with flag ' || l_returnflag || ' and status ' || l_linestatus || '.</p>' || chr(10) || '<p>Quantity ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' &amp; discount ' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%</p></div>'")} AS answer_body,
    CAST(l_quantity AS BIGINT) AS score, (l_returnflag = 'A' AND l_linestatus = 'F') AS is_accepted
  FROM lineitem)""", f"""qs AS (
  SELECT p_partkey AS question_id, {S.strip_html("'How to use ' || p_name || ' &amp; friends?'")} AS title,
    substr({S.strip_html("'<p>Type <b>' || p_type || '</b> from ' || p_brand || ' &quot;size&quot; ' || CAST(p_size AS VARCHAR) || '</p>'")}, 1, 500) AS qbody
  FROM part)""", """top5 AS (
  SELECT * REPLACE (substr(answer_body, 1, 1000) AS answer_body) FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, answer_id, answer_body) AS vote_rank FROM ans)
  WHERE vote_rank <= 5)""", """best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY (NOT is_accepted), vote_rank) AS br
                 FROM top5) WHERE br = 1)""")


def _qa(spark, sf):
    return (ex.questions_from_part(tables.read_table(spark, sf, "part")),
            ex.answers_from_lineitem(tables.read_table(spark, sf, "lineitem")))


@register("qa_best_answers", S.with_mem("""
SELECT question_id, answer_id, answer_body, score, is_accepted FROM best""", *QA_CTES))
def q_best_answers(spark, sf):
    _q, a = _qa(spark, sf)
    return ex.best_answers(a)


@register("pages_text", f"SELECT page_id, {S.strip_html('html')} AS text FROM pages")
def q_pages_text(spark, sf):
    return tables.texts(spark, sf, "pages").select("page_id", strip_html("html").alias("text"))


REQ_CTE = f"""req AS (
  SELECT 'https://stackoverflow.com/questions/' || CAST(p_partkey AS VARCHAR) || '/how-to' AS url,
    'src' || CAST(p_partkey % 20 AS VARCHAR) AS project FROM part
  UNION ALL
  SELECT 'https://stackoverflow.com/a/' || CAST({ANSWER_KEY} AS VARCHAR), 'src' || CAST(l_orderkey % 20 AS VARCHAR)
  FROM lineitem WHERE l_linenumber = 1
  UNION ALL
  SELECT 'https://stackoverflow.com/questions/' || CAST(l_partkey AS VARCHAR) || '/a b#' || CAST({ANSWER_KEY} AS VARCHAR),
    'src' || CAST(l_orderkey % 20 AS VARCHAR)
  FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0
  UNION ALL
  SELECT 'https://stackoverflow.com/a/' || CAST(page_id AS VARCHAR) || '?noredirect=1', 'src1' FROM pages
  UNION ALL
  SELECT url, 'src' || CAST(page_id % 20 AS VARCHAR) FROM pages)"""
URL_SQL = r"""canon AS (
  SELECT url, project, kind, num,
    CASE WHEN lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))
              IN ('stackoverflow.com', 'www.stackoverflow.com')
      THEN 'https://stackoverflow.com/' || CASE kind WHEN 'answer' THEN 'a/' WHEN 'question' THEN 'questions/' END || num
    END AS canonical
  FROM (
    SELECT url, project, CASE WHEN a <> '' OR anchor <> '' THEN 'answer' WHEN qn <> '' THEN 'question' END AS kind,
      regexp_replace(CASE WHEN a <> '' THEN a WHEN anchor <> '' THEN anchor WHEN qn <> '' THEN qn END, '^0+([0-9])', '\1') AS num
    FROM (SELECT url, project, regexp_extract(url, 'stackoverflow\.com/a/(\d+)', 1) AS a,
            regexp_extract(url, 'stackoverflow\.com/questions/\d+[^#]*#(\d+)', 1) AS anchor,
            regexp_extract(url, 'stackoverflow\.com/questions/(\d+)', 1) AS qn FROM req)))"""


def _requests(spark, sf):
    part = tables.read_table(spark, sf, "part")
    li = tables.read_table(spark, sf, "lineitem").filter(F.col("l_linenumber") == 1)
    pages = tables.texts(spark, sf, "pages")

    def project(c):
        return F.concat(F.lit("src"), (F.col(c) % 20).cast("string")).alias("project")

    so, key = F.lit("https://stackoverflow.com/"), ex.answer_key().cast("string")
    return (part.select(F.concat(so, F.lit("questions/"), F.col("p_partkey").cast("string"), F.lit("/how-to")).alias("url"),
                        project("p_partkey"))
            .unionByName(li.select(F.concat(so, F.lit("a/"), key).alias("url"), project("l_orderkey")))
            .unionByName(li.filter(F.col("l_orderkey") % 3 == 0).select(
                F.concat(so, F.lit("questions/"), F.col("l_partkey").cast("string"), F.lit("/a b#"), key).alias("url"),
                project("l_orderkey")))
            .unionByName(pages.select(F.concat(so, F.lit("a/"), F.col("page_id").cast("string"),
                                               F.lit("?noredirect=1")).alias("url"), F.lit("src1").alias("project")))
            .unionByName(pages.select("url", project("page_id"))))


@register("url_canonical", S.with_mem("SELECT url, project, kind, num, canonical FROM canon", REQ_CTE, URL_SQL))
def q_url_canonical(spark, sf):
    r = _requests(spark, sf)
    k = so_url_kind_id("url")
    return r.select("url", "project", k["kind"].alias("kind"), k["id"].alias("num"),
                    so_canonical_url("url").alias("canonical"))


PATTERN_SQL = f"""hit AS (
  SELECT 'answer' AS kind, CAST(a.answer_id AS VARCHAR) AS num,
    'Q: ' || coalesce(q.title, '') || chr(10) || 'A (score=' || CAST(a.score AS VARCHAR) || ', accepted='
      || CASE WHEN a.is_accepted THEN 'True' ELSE 'False' END || '):' || chr(10) || substr(a.answer_body, 1, 600) AS summary
  FROM ans a LEFT JOIN qs q ON q.question_id = a.question_id
  UNION ALL
  SELECT 'question', CAST(q.question_id AS VARCHAR),
    CASE WHEN b.answer_body IS NOT NULL THEN
      'Q: ' || q.title || chr(10) || 'A (score=' || CAST(b.score AS VARCHAR) || ', accepted='
      || CASE WHEN b.is_accepted THEN 'True' ELSE 'False' END || '):' || chr(10) || substr(b.answer_body, 1, 600)
    ELSE 'Q: ' || q.title || chr(10) || substr(q.qbody, 1, 600) END
  FROM qs q LEFT JOIN best b ON b.question_id = q.question_id),
asked AS (SELECT *, row_number() OVER (ORDER BY url, project) AS turn FROM canon),
outcome AS (
  SELECT a.*, {S.redact('h.summary')} AS clean_text, h.summary, h.num IS NOT NULL AS found,
    a.canonical IN (SELECT so_url FROM memc WHERE so_url IS NOT NULL) AS before,
    EXISTS (SELECT 1 FROM asked e WHERE e.canonical = a.canonical AND e.turn < a.turn) AS again
  FROM asked a LEFT JOIN hit h ON h.kind = a.kind AND h.num = a.num),
allr AS (
  SELECT url, project, canonical, CASE WHEN status IN ('stored', 'blocked') THEN summary END AS summary,
    CASE WHEN status IN ('stored', 'blocked') THEN clean_text END AS clean_text, status
  FROM (SELECT *, CASE WHEN canonical IS NULL THEN 'error' WHEN before THEN 'duplicate' WHEN NOT found THEN 'not_found'
      WHEN len({S.findings('clean_text')}) > 0 THEN 'blocked' WHEN again THEN 'duplicate' ELSE 'stored' END AS status FROM outcome))"""


@register("pattern_store", S.with_mem("""
SELECT url, project, canonical, summary, clean_text, status, 'pattern' AS type, 'stackoverflow' AS source,
  CAST(0.6 AS DOUBLE) AS confidence FROM allr""", *QA_CTES, REQ_CTE, URL_SQL, PATTERN_SQL))
def q_pattern_store(spark, sf):
    q, a = _qa(spark, sf)
    return ex.pattern_store(_requests(spark, sf), q, a, mem(spark, sf))


@register("pattern_store_tally", S.with_mem("""
SELECT project, status, CAST(count(*) AS BIGINT) AS n FROM allr GROUP BY ALL""",
                                            *QA_CTES, REQ_CTE, URL_SQL, PATTERN_SQL))
def q_pattern_tally(spark, sf):
    return q_pattern_store(spark, sf).groupBy("project", "status").agg(F.count(F.lit(1)).alias("n"))


@register("tags_json_parse", f"""
SELECT doc_id, array_to_string(CASE WHEN v IS NOT NULL AND json_valid(v) AND json_type(v) = 'ARRAY'
  THEN CAST(from_json(v, '["VARCHAR"]') AS VARCHAR[]) ELSE []::VARCHAR[] END, '|') AS tags
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{{"a": 1}}' WHEN 2 THEN NULL
  ELSE '["t' || CAST(doc_id % 37 AS VARCHAR) || '", "' || lang || '"]' END AS v FROM documents)""")
def q_tags_json(spark, sf):
    d = F.col("doc_id")
    v = (F.when(d % 6 == 0, F.lit("not json")).when(d % 6 == 1, F.lit('{"a": 1}'))
         .when(d % 6 == 2, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit('["t'), (d % 37).cast("string"), F.lit('", "'), F.col("lang"), F.lit('"]'))))
    docs = tables.texts(spark, sf)
    return docs.select("doc_id", F.array_join(parse_json_list(v), "|").alias("tags"))


# =============================================================================
# Conflict log (D13, P5), resolution (D12, D5), status (C6), health
# =============================================================================
def _conflicts(spark, sf):
    m = mem(spark, sf)
    g = gate_ops.gate(incoming_from_memories(m), m)
    conflicts, flagged = conflict_ops.flag_conflicts(m, g)
    return m, conflicts, flagged


CONFLICT_SQL = """conf AS (SELECT id AS new_id, conflict_with AS memory_id_a, conflict_description AS description,
  false AS resolved FROM final WHERE status = 'conflict_detected')"""


@register("conflict_log", S.with_mem("SELECT new_id, memory_id_a, description, resolved FROM conf",
                                     *GATE_SQL_CTES, CONFLICT_SQL))
def q_conflict_log(spark, sf):
    _m, c, _f = _conflicts(spark, sf)
    return store_ops.list_conflicts(c, resolved=False).select("new_id", "memory_id_a", "description", "resolved")


@register("conflict_flags", S.with_mem("""
SELECT project, CAST(count(*) FILTER (WHERE id IN (SELECT memory_id_a FROM conf)) AS BIGINT) AS flagged
FROM memc GROUP BY project""", *GATE_SQL_CTES, CONFLICT_SQL))
def q_conflict_flags(spark, sf):
    _m, _c, flagged = _conflicts(spark, sf)
    return flagged.groupBy("project").agg(F.count_if("conflict_flag").alias("flagged"))


@register("resolve_conflicts", S.with_mem("""
, dropped AS (SELECT DISTINCT memory_id_a AS id FROM conf WHERE memory_id_a % 2 = 1)
SELECT project, CAST(count(*) AS BIGINT) AS remaining,
  CAST(count(*) FILTER (WHERE id IN (SELECT memory_id_a FROM conf)) AS BIGINT) AS flagged
FROM memc WHERE id NOT IN (SELECT id FROM dropped) GROUP BY project""", *GATE_SQL_CTES, CONFLICT_SQL))
def q_resolve(spark, sf):
    _m, c, flagged = _conflicts(spark, sf)
    decisions = c.select(F.col("id").alias("conflict_id"),
                         F.when(F.col("memory_id_a") % 2 == 0, F.col("memory_id_a"))
                         .otherwise(F.col("new_id")).alias("keep"))
    after, _c2, _dropped = conflict_ops.resolve_conflicts(flagged, c, decisions)
    return after.groupBy("project").agg(F.count(F.lit(1)).alias("remaining"),
                                        F.count_if("conflict_flag").alias("flagged"))


@register("status_report", S.with_mem("""
SELECT m.project, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT approved) AS BIGINT) AS pending,
  CAST(count(*) FILTER (WHERE approved) AS BIGINT) AS approved,
  CAST(coalesce(any_value(oc.n), 0) AS BIGINT) AS open_conflicts
FROM memc m LEFT JOIN (SELECT mm.project, count(*) AS n FROM conf JOIN memc mm ON mm.id = conf.memory_id_a
                       GROUP BY mm.project) oc ON oc.project = m.project
GROUP BY m.project""", *GATE_SQL_CTES, CONFLICT_SQL))
def q_status(spark, sf):
    m, c, _f = _conflicts(spark, sf)
    return report_ops.status_report(m, c)


@register("health_counts", S.with_mem("""
SELECT CAST((SELECT count(*) FROM memc) AS BIGINT) AS total,
  CAST((SELECT count(*) FROM memc WHERE NOT approved) AS BIGINT) AS pending,
  CAST((SELECT count(*) FROM conf) AS BIGINT) AS open_conflicts,
  CAST((SELECT count(*) FROM idx) AS BIGINT) AS index_entries""", *GATE_SQL_CTES, CONFLICT_SQL, RECALL_CTES[0]))
def q_health(spark, sf):
    m, c, _f = _conflicts(spark, sf)
    idx = recall_ops.vector_index(m, tables.read_table(spark, sf, "embeddings"))
    return report_ops.health(m, c, idx)


# =============================================================================
# Streaming (R1, R2): run to completion (availableNow), read the sinks back
# =============================================================================
from ..streaming import ingest as stream_ops  # noqa: E402


@register("stream_gate_status_counts", S.with_mem("""
SELECT project, type, status, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 4) AS avg_confidence
FROM final GROUP BY ALL""", *GATE_SQL_CTES))
def q_stream_gate(spark, sf):
    return gate_ops.status_counts(stream_ops.streamed_gate(spark, sf))


@register("stream_archive_rows", S.with_mem("""
SELECT project, '2024-06-01' AS date, '2024-06-01T00:00:00.000000Z' AS captured_at, text FROM sessions""",
                                            SESSIONS_SQL))
def q_stream_archive(spark, sf):
    fixed = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return stream_ops.streamed_archive(spark, sf, captured_at=fixed).select("project", "date", "captured_at", "text")


# --- T1 approximate: an index of lists, measured against exact search ------------
def _lists(spark, sf, k):
    """(index, queries, found, share of rows read): rows of vec_id divisible by 20 against all others."""
    from ..operators import approx_recall as A
    from ..session import ensure_checkpoint_dir
    index = tables.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = index.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qvec"))
    path = f"{ensure_checkpoint_dir(spark)}/lists-{spark.range(1).select(F.uuid()).first()[0]}"
    centres = A.build(index, path)
    probes = A.calibrate(index, centres, k)
    found = A.search(spark, path, centres, asked, k + 1, probes).where("query_id <> id")      # itself is no answer
    return index, asked, found, A.share_read(spark, path, centres, asked, probes)


@register("recall_approximate")
def q_recall_approximate(spark, sf):
    from pyspark.sql import Window
    _, _, found, _ = _lists(spark, sf, 5)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.row_number().over(best)).where("rank <= 5")
            .select("query_id", "rank", "id", F.round("score", 4).alias("score")))


@register("recall_approximate_quality", """
SELECT CAST(count(*) AS BIGINT) AS queries, true AS recall_reached, true AS rows_pruned FROM embeddings WHERE vec_id % 20 = 0""")
def q_recall_quality(spark, sf):
    """The measured recall reaches 0.9, and fewer rows are read than there are."""
    from ..operators import approx_recall as A
    index, asked, found, share = _lists(spark, sf, 5)
    itself = asked.select("query_id", F.col("query_id").alias("id"), F.lit(2.0).alias("score"))
    got = A.quality(found.select("query_id", "id", "score").unionByName(itself), index, asked, 6)
    # of the six exact best one is the query's own row
    return got.select("queries", ((F.col("recall") * 6 - 1) / 5 >= 0.9).alias("recall_reached"), F.lit(share < 1).alias("rows_pruned"))


@register("gate_auto")
def q_gate_auto(spark, sf):
    """C1 in mode auto: every record is also checked against those of the batch stored before it."""
    g = gated(spark, sf, mode="auto")
    return g.select("id", "project", "type", "status", "conflict_with", "conflict_rule")


# =============================================================================
# The store: write, change, read back, export
# =============================================================================
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import memories as mem_src  # noqa: E402


def _fresh_path(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{spark.range(1).select(F.uuid()).first()[0]}"


def _lifecycle(spark, sf):
    """A store of two schema versions, after approvals and forgotten ids; returns its path."""
    m = mem(spark, sf)
    labels = tables.read_table(spark, sf, "labels")
    path = _fresh_path(spark, "store")
    mem_src.write_buckets(m.filter(F.col("id") % 5 == 0).drop("related_files", "confidence", "conflict_flag"), path)
    mem_src.write_buckets(m.filter(F.col("id") % 5 != 0), path)
    ids = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").alias("id"))
    _after, newly = store_ops.approve(mem_src.read_buckets(spark, path), ids)
    mem_src.change_buckets(spark, path, newly.withColumn("approved", F.lit(True)),
                           labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))
    return path


LIFECYCLE_CTE = f"""life AS (
  SELECT id, project, type, summary, approved OR id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS approved,
    CASE WHEN id % 5 = 0 THEN CAST({rules.DEFAULT_CONFIDENCE} AS DOUBLE) ELSE confidence END AS confidence,
    CASE WHEN id % 5 = 0 THEN '' ELSE {sql_joined('related_files')} END AS related_files, {sql_joined('tags')} AS tags
  FROM memc WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"""


@register("store_lifecycle", S.with_mem("SELECT id, project, type, approved, confidence, related_files, tags FROM life",
                                        LIFECYCLE_CTE))
def q_store_lifecycle(spark, sf):
    back = mem_src.read_buckets(spark, _lifecycle(spark, sf))
    return back.select("id", "project", "type", "approved", "confidence", joined("related_files").alias("related_files"),
                       joined("tags").alias("tags"))


@register("store_export", S.with_mem("SELECT id, project, type, summary, approved, confidence, tags FROM life", LIFECYCLE_CTE))
def q_store_export(spark, sf):
    """The whole store as JSON lines, pending rows included, and read from there again."""
    out = _fresh_path(spark, "export")
    mem_src.export_json(mem_src.read_buckets(spark, _lifecycle(spark, sf)), out)
    return spark.read.schema(mem_src.MEMORY_SCHEMA).json(out).select(
        "id", "project", "type", "summary", "approved", "confidence", joined("tags").alias("tags"))


@register("recall_by_project", S.with_mem("""
, asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
sc AS (SELECT query_id, i.project, i.id, list_cosine_similarity(i.emb, qv) AS s FROM asked, ix i)
SELECT query_id, project, CAST(rank AS INTEGER) AS rank, id, round(s, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY s DESC, id) AS rank FROM sc) WHERE rank <= 3""",
                                          RECALL_CTES[0].replace("idx AS", "ix AS", 1)))
def q_recall_by_project(spark, sf):
    """Vectors whose id is divisible by 20 against every project's memories, all projects in one job."""
    _m, idx, _q = _recall_inputs(spark, sf)
    asked = (tables.read_table(spark, sf, "embeddings").filter(F.col("vec_id") % 20 == 0)
             .select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qvec")))
    return recall_ops.top_k(idx, asked, 3, group_col="project").select(
        "query_id", "project", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 4).alias("score"))
