"""Conflict detection: rule cases, isolation by project and type, first-match order."""
from conftest import mem_rows

from memweave.operators.conflicts import detect_conflicts


def check(spark, new_text, existing, project="p", type_="decision"):
    snap = mem_rows(spark, existing)
    new = spark.createDataFrame([(10_000, project, type_, new_text)], "id bigint, project string, type string, text string")
    got = detect_conflicts(new, snap).collect()
    return got[0] if got else None


def test_vector_db_conflict(spark):
    r = check(spark, "We use Qdrant for vectors", [{"id": 1, "summary": "We use Chroma for vectors", "type": "decision"}])
    assert r and r["conflict_with"] == 1 and "vector database" in r["conflict_description"]


def test_framework_conflict(spark):
    r = check(spark, "We use django now", [{"id": 1, "summary": "we use flask", "type": "decision"}])
    assert r and r["conflict_rule"] == 1


def test_package_manager(spark):
    r = check(spark, "use yarn for installs", [{"id": 1, "summary": "use npm everywhere", "type": "decision"}])
    assert r and "package manager" in r["conflict_description"]


def test_other_project_or_type_is_isolated(spark):
    ex = [{"id": 1, "summary": "We use Chroma", "type": "decision", "project": "other"},
          {"id": 2, "summary": "We use Chroma", "type": "bug", "project": "p"}]
    assert check(spark, "We use Qdrant", ex) is None


def test_empty_snapshot(spark):
    assert check(spark, "We use Qdrant", [{"id": 1, "summary": "x", "type": "decision", "approved": False}]) is None


def test_first_match_is_newest_candidate(spark):
    ex = [{"id": 1, "summary": "we use flask", "type": "decision", "minute": 1},
          {"id": 2, "summary": "we use flask too", "type": "decision", "minute": 5}]
    r = check(spark, "we use django", ex)
    assert r["conflict_with"] == 2


def test_tech_rule_only_for_decision_like_types(spark):
    ex = [{"id": 1, "summary": "redis is great", "type": "decision"}]
    assert check(spark, "docker is great", ex)["conflict_rule"] == 12
    ex2 = [{"id": 1, "summary": "redis is great", "type": "bug"}]
    assert check(spark, "docker is great", ex2, type_="bug") is None


def test_using_is_not_use_and_accents(spark):
    ex = [{"id": 1, "summary": "using flask", "type": "general"}]
    assert check(spark, "we use django", ex, type_="general") is None
    ex2 = [{"id": 1, "summary": "éuse flask", "type": "general"}]
    assert check(spark, "we use django", ex2, type_="general") is None


def test_repeated_ids_and_an_id_of_the_snapshot(spark):
    from memweave.operators.gate import gate
    snap = mem_rows(spark, [{"id": 1, "summary": "we use flask", "type": "decision"}])
    rows = [(1, "p", "decision", "user", "we use django")] * 2 + [(1, "p", "decision", "user", "plain"), (None, "p", "bad", "user", "x"),
                                                                  (2, "p", "bug", None, None)]
    recs = spark.createDataFrame(rows, "id bigint, project string, type string, source string, text string")
    got = sorted((str(r["id"]), r["status"]) for r in gate(recs, snap).collect())
    assert got == [("1", "conflict_detected"), ("1", "conflict_detected"), ("1", "pending"), ("2", "pending"), ("None", "error")]
    assert {r["status"] for r in gate(recs, snap, mode="auto", check_conflicts=False).collect()} == {"stored", "error"}


def test_flag_and_resolve(spark):
    from memweave.operators import conflicts as c
    from memweave.operators.gate import gate
    snap = mem_rows(spark, [{"id": 1, "summary": "we use flask", "type": "decision"}, {"id": 2, "summary": "x", "type": "bug"}])
    recs = spark.createDataFrame([(7, "p", "decision", "user", "we use django")],
                                 "id bigint, project string, type string, source string, text string")
    found, flagged = c.flag_conflicts(snap, gate(recs, snap))
    assert {r["id"]: r["conflict_flag"] for r in flagged.collect()} == {1: True, 2: False}
    row = found.first()
    after, log, gone = c.resolve_conflicts(flagged, found, spark.createDataFrame([(row["id"], 7)], "conflict_id string, keep bigint"))
    assert [r["id"] for r in after.collect()] == [2] and [r["id"] for r in gone.collect()] == [1] and log.first()["resolved"]
