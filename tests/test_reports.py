"""PR drafts, portfolio, counts, listings and store updates."""
from pyspark.sql import functions as F

from conftest import mem_rows
from memweave.operators import reports, store


def test_pr_draft_sections(spark):
    rows = [dict(id=i, type="decision", summary=f"decision {i}", minute=i) for i in range(10)]
    rows.append(dict(id=50, type="bug", summary="b" * 150, minute=1))
    d = reports.pr_drafts(mem_rows(spark, rows)).first()
    t = d["template"]
    assert t.startswith("## Summary\n\n**Key decisions:**\n- decision 9\n- decision 8\n- decision 7\n\n")
    assert "**Bugs addressed:**\n- " + "b" * 100 + "\n\n" in t
    assert t.endswith("_Generated from p memory — 2 memory types referenced._")
    assert d["total_memories"] == 11


def test_portfolio_empty_state(spark):
    rows = [dict(id=1, type="bug", summary="x")]
    lines = [r["line"] for r in reports.portfolio_lines(mem_rows(spark, rows)).orderBy("section", "ord").collect()]
    assert lines[0] == "# Portfolio — p\n"
    assert lines[1].startswith("_No portfolio")


def test_counts_global_row(spark):
    rows = [dict(id=1, project="a"), dict(id=2, project="b", approved=False)]
    got = {r["project"]: (r["total"], r["pending"], r["approved"]) for r in reports.counts(mem_rows(spark, rows)).collect()}
    assert got[None] == (2, 1, 1) and got["a"] == (1, 0, 1)


def test_link_and_approve_and_forget(spark):
    m = mem_rows(spark, [dict(id=1), dict(id=2, approved=False), dict(id=3)])
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "a bigint, b bigint")
    after, outcome = store.link_memories(m, pairs)
    rel = {r["id"]: list(r["related_to"]) for r in after.collect()}
    assert rel[1] == [2] and rel[2] == [1] and rel[3] == []
    assert sorted((r["a"], r["b"], r["linked"]) for r in outcome.distinct().collect()) == [(1, 2, True), (1, 9, False)]
    after2, newly = store.approve(m, spark.createDataFrame([(2,), (7,)], "id bigint"))
    assert [r["id"] for r in newly.collect()] == [2]
    assert after2.filter("approved").count() == 3
    assert store.forget(m, spark.createDataFrame([(3,)], "id bigint")).count() == 2


def test_commits_for_memory_excludes_self(spark):
    m = mem_rows(spark, [dict(id=1, commit_sha="abc"), dict(id=2, commit_sha="abc"), dict(id=3)])
    got = store.commits_for_memory(m, spark.createDataFrame([(1,), (3,)], "id bigint")).collect()
    assert [(r["memory_id"], r["id"]) for r in got] == [(1, 2)]


def test_projects_without_approved_memories_get_a_draft(spark):
    m = mem_rows(spark, [dict(id=1, project="a", type="fix", summary="f"), dict(id=2, project="b", approved=False)])
    got = {r["project"]: r for r in reports.pr_drafts(m).collect()}
    assert (got["b"]["total_memories"], got["b"]["types_referenced"]) == (0, 0)
    assert got["b"]["template"].startswith("## Summary\n\n## Test plan")


def test_relevant_block_and_lists(spark):
    m = mem_rows(spark, [dict(id=i, type="bug", summary=f"s{i} " + "x" * 130, minute=i) for i in range(8)])
    hits = spark.createDataFrame([("p", r, i) for r, i in enumerate([99, 3, 1, 5, 2, 0, 4], start=1)], "project string, rank int, id bigint")
    d = reports.pr_drafts(m, context=" why ", hits=hits).first()["template"]
    assert d.startswith("## Summary\n\nwhy\n\n**Relevant context from memory:**\n- [bug] s3 ")
    assert d.count("- [bug] ") == 3
    items = reports.pr_draft_items(m, hits).orderBy("section", "rank").collect()
    assert [r["id"] for r in items if r["section"] == "relevant"] == [3, 1, 5, 2, 0]
    assert [r["id"] for r in items if r["section"] == "bug"] == [7, 6, 5, 4, 3]
    assert all(len(r["summary"]) == 120 for r in items if r["section"] == "bug")


def test_portfolio_of_all_projects(spark):
    m = mem_rows(spark, [dict(id=i, project=f"p{i % 2}", type="decision", summary=f"d{i}", minute=i) for i in range(7)])
    lines = [r["line"] for r in reports.portfolio_lines(m, all_projects=True).orderBy("section", "ord").collect()]
    assert lines[:3] == ["# Portfolio\n", "## Key Technical Decisions\n", "- d6"] and lines[-2] == "- d2"


def test_latest_update_and_latest_link_win(spark):
    index = spark.createDataFrame([(1, "old"), (2, "old")], "id bigint, document string")
    updates = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (3, "x", 1), (3, "y", 1)], "id bigint, document string, version int")
    assert sorted(map(tuple, store.upsert_vectors(index, updates).collect())) == [(1, "a"), (2, "old"), (3, "y")]
    assert store.upsert_vectors(index, updates.drop("version")).where("id = 1").count() == 1
    m = mem_rows(spark, [dict(id=1, commit_sha="x"), dict(id=2)])
    links = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "z", 1), (9, "q", 1)], "memory_id bigint, commit_sha string, linked_at int")
    assert {r["id"]: r["commit_sha"] for r in store.link_to_commit(m, links).collect()} == {1: "b", 2: None}


def test_store_round_trip(spark, tmp_path):
    from memweave.sources import memories as mm
    rows = spark.createDataFrame([("p", "bug", "same", "session")] * 2 + [("q", "fix", "other", None)],
                                 "project string, type string, summary string, source string")
    new = mm.new_memories(rows, next_id=100)
    ids = [r["id"] for r in new.collect()]
    assert len(set(ids)) == 3 and min(ids) >= 100 and [r["confidence"] for r in new.orderBy("summary").collect()] == [0.5, 0.7, 0.7]
    path = str(tmp_path / "store")
    mm.append(new, path)
    mm.append(new.limit(1).drop("so_url", "related_to").withColumn("project", F.lit("old")), path)      # an earlier schema
    back = mm.read_store(spark, path)
    assert back.columns == mm.MEMORY_SCHEMA.names and back.count() == 4
    assert [list(r["related_to"]) for r in back.where("project = 'old'").collect()] == [[]]
    mm.export_json(back, str(tmp_path / "out"), project="p")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
