"""Export loaders, URL functions, HTML strip, pattern text (cases of the original tests)."""
import json

from conftest import mem_rows
from pyspark.sql import functions as F

from memweave.functions.text import confidence_from_source, so_canonical_url, so_url_kind_id, strip_html
from memweave.sources import exports as ex


def test_confidence_by_source(spark):
    vals = ["github_commit", "github_pr", "github_issue", "session", "stackoverflow", "magic", "user_session",
            "chat", "so_answers", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(confidence_from_source("s")).collect()]
    assert got == [0.8, 0.8, 0.8, 0.7, 0.6, 0.5, 0.9, 0.7, 0.6, 0.5]


def test_commit_parse(spark):
    raw = spark.createDataFrame(
        [("p", '{"sha": "abcdef1234567", "commit": {"message": "Fix bug\\n\\nmore", "author": {"name": "Ann", "date": "2024-03-04T10:00:00Z"}}}'),
         ("p", '{"sha": "0123456789abcdef", "commit": {"message": "   ", "author": {"date": "2024-03-04T10:00:00Z"}}}'),
         ("p", '{"sha": "ffffffffffffff", "commit": {"message": "Add x", "author": {"date": "2024-01-02T00:00:00Z"}}}')],
        "project string, json string")
    rows = ex.commit_text(ex.commit_rows(ex.parse_json_column(raw, "json", ex.COMMIT_SCHEMA))).collect()
    texts = sorted(r["text"] for r in rows)
    assert texts == ["[abcdef123456] Fix bug — by Ann on 2024-03-04", "[ffffffffffff] Add x — by unknown on 2024-01-02"]


def test_pr_and_issue_text(spark):
    prs = spark.createDataFrame([("p", 7, "Title", None), ("p", 8, "T2", "b" * 600)],
                                "project string, number bigint, title string, body string").withColumn("state", F.lit("closed"))
    t = sorted(r["text"] for r in ex.pr_text(prs).collect())
    assert t[0] == "PR #7: Title" and t[1] == "PR #8: T2\n" + "b" * 500
    lines = [{"number": 3, "title": "Crash", "body": "trace", "state": "closed"},
             {"number": 4, "title": "Is a PR", "body": "", "state": "closed", "pull_request": {"url": "u"}},
             {"number": 5, "title": "Is one too", "state": "closed", "pull_request": None},
             {"number": 6, "title": "Still open", "state": "open"}]
    raw = spark.createDataFrame([("p", json.dumps(x)) for x in lines], "project string, json string")
    issues = ex.parse_issues(raw, "json")
    assert [r["text"] for r in ex.issue_text(issues).collect()] == ["Issue #3 (closed): Crash\ntrace"]
    assert [r["text"] for r in ex.issue_text(issues, "open").collect()] == ["Issue #6 (open): Still open"]
    assert ex.issue_text(issues, "all").count() == 2


def test_blank_commit_messages(spark):
    raw = spark.createDataFrame([("p", m, "a", "2024-01-01", m[:1]) for m in ("\t", " \u00a0 ", "", "x")],
                                "project string, message string, author string, date string, sha string")
    assert [r["text"] for r in ex.commit_text(raw).collect()] == ["[x] x — by a on 2024-01-01"]


def test_exports_read_from_files_and_a_second_ingest(spark, tmp_path):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)
    commits = ex.commit_rows(ex.read_export(spark, lines("c", [
        {"sha": "abcdef1234567", "commit": {"message": "Fix", "author": {"name": "Ann", "date": "2024-03-04T10:00:00Z"}}}]),
        ex.COMMIT_SCHEMA, "p"))
    prs = ex.read_export(spark, lines("p", [{"number": 7, "title": "T", "state": "closed"},
                                            {"number": 9, "title": "Authorization: Basic " + "Q" * 12, "state": "closed"}]),
                         ex.PR_SCHEMA, "p")
    issues = ex.read_issues(spark, lines("i", [{"number": 7, "title": "I", "body": "b", "state": "closed"}]), "p")
    first = ex.repo_ingest(commits, prs, issues)
    assert sorted((r["source"], r["status"]) for r in first.collect()) == [
        ("github_commit", "stored"), ("github_issue", "stored"), ("github_pr", "skipped"), ("github_pr", "stored")]
    mem = ex.ingested_memories(first)
    assert mem.where("approved").count() == 3
    again = ex.repo_ingest(commits, prs, issues, mem)
    assert sorted((r["source"], r["status"]) for r in again.collect()) == [
        ("github_commit", "duplicate"), ("github_issue", "duplicate"), ("github_pr", "duplicate"), ("github_pr", "skipped")]


def test_pattern_store_has_one_outcome_per_request(spark):
    urls = ["https://stackoverflow.com/a/42", "https://stackoverflow.com/questions/10/x y|z#42",
            "https://stackoverflow.com/questions/10/t", "https://www.stackoverflow.com/questions/10", "https://example.com/a/42",
            "https://stackoverflow.com/a/" + "9" * 30, "https://stackoverflow.com/a/7", "https://stackoverflow.com/a/7"]
    req = spark.createDataFrame([(u, "p") for u in urls], "url string, project string")
    questions = spark.createDataFrame([(10, "Q &eacute; &#8217;", "<b>body</b>", 1, 0)],
                                      "question_id bigint, title string, body string, score bigint, answer_count bigint")
    answers = spark.createDataFrame([(42, 10, "use &lt;x&gt;", 5, True), (43, 10, "other", 9, False)],
                                    "answer_id bigint, question_id bigint, body string, score bigint, is_accepted boolean")
    mem = mem_rows(spark, [dict(id=1, so_url="https://stackoverflow.com/a/7")])
    got = sorted(((r["url"], r["status"], r["summary"]) for r in ex.pattern_store(req, questions, answers, mem).collect()), key=str)
    by_answer = "Q: Q é ’\nA (score=5, accepted=True):\nuse <x>"
    assert [x[:2] for x in got] == sorted(
        [(urls[0], "stored"), (urls[1], "duplicate"), (urls[2], "stored"), (urls[3], "duplicate"), (urls[4], "error"),
         (urls[5], "not_found"), (urls[6], "duplicate"), (urls[7], "duplicate")])
    assert {x[2] for x in got if x[1] == "stored"} == {by_answer}


def test_so_urls(spark):
    urls = ["https://stackoverflow.com/questions/1234/title", "https://stackoverflow.com/questions/1234/title#5678",
            "https://stackoverflow.com/a/5678", "https://stackoverflow.com/a/5678?noredirect=1",
            "https://www.stackoverflow.com/questions/99", "https://example.com/questions/1",
            "https://stackoverflow.com/users/1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(so_url_kind_id("u").alias("k"), so_canonical_url("u").alias("c")).collect()
    assert [(r["k"]["kind"], r["k"]["id"]) if r["k"] else None for r in got][:5] == [
        ("question", "1234"), ("answer", "5678"), ("answer", "5678"), ("answer", "5678"), ("question", "99")]
    assert got[6]["k"] is None
    canon = [r["c"] for r in got]
    assert canon[1] == canon[2] == canon[3] == "https://stackoverflow.com/a/5678"
    assert canon[5] is None and canon[6] is None


def test_strip_html(spark):
    df = spark.createDataFrame([("<p>Hello <b>world</b></p>\n<p>a &amp; b</p>",), ("&euro;5 &#8217;t &amp;lt; &nbsp;x",), (None,)],
                               "h string")
    assert [r[0] for r in df.select(strip_html("h")).collect()] == ["Hello world a & b", "€5 ’t &lt; x", None]


def test_best_answer_and_pattern_text(spark):
    answers = spark.createDataFrame(
        [(1, 10, "<p>top</p>", 50, False), (2, 10, "<p>acc</p>", 42, True), (3, 11, "only", 1, False)],
        "answer_id bigint, question_id bigint, body string, score bigint, is_accepted boolean")
    best = {r["question_id"]: r for r in ex.best_answers(answers).collect()}
    assert best[10]["answer_id"] == 2 and best[11]["answer_id"] == 3
    df = spark.createDataFrame([("T", 42, True, "acc body", None)],
                               "t string, s bigint, a boolean, b string, q string")
    txt = df.select(ex.pattern_text(F.col("t"), F.col("s"), F.col("a"), F.col("b"), F.col("q"))).first()[0]
    assert txt == "Q: T\nA (score=42, accepted=True):\nacc body"
    df2 = spark.createDataFrame([("T", None, None, None, "question body")],
                                "t string, s bigint, a boolean, b string, q string")
    assert df2.select(ex.pattern_text(F.col("t"), F.col("s"), F.col("a"), F.col("b"), F.col("q"))).first()[0] == \
        "Q: T\nquestion body"


def test_broken_lines_missing_exports_and_limits(spark, tmp_path):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return str(tmp_path / name)
    commits = ex.commit_rows(ex.read_export(spark, lines("c", [
        {"sha": f"{k:014d}", "commit": {"message": f"m{k}", "author": {"name": "A", "date": f"2024-03-0{k}T10:00:00Z"}}}
        for k in (1, 3, 2)] + ["{broken", "", "  ", {"sha": "x", "commit": "text"}]), ex.COMMIT_SCHEMA, "p"))
    issues = ex.read_issues(spark, lines("i", [
        {"number": 9, "title": "pr", "state": "closed", "pull_request": {}}, {"number": 8, "title": "b", "state": "closed"},
        {"number": 7, "title": "c", "state": "closed"}, {"title": "no number", "state": "closed"}, "[1]", "12"]), "p")
    prs = ex.read_export(spark, str(tmp_path / "none"), ex.PR_SCHEMA, "p")
    for state in ("closed", "all"):
        got = ex.repo_ingest(commits, prs, issues, state=state)
        assert got.filter("status = 'stored' and (text is null or clean_text is null or error is not null)").isEmpty()
        assert sorted(r["text"] for r in got.filter("status = 'stored'").collect()) == [
            "Issue #0 (closed): no number", "Issue #7 (closed): c", "Issue #8 (closed): b",
            "[000000000000] m1 — by A on 2024-03-01", "[000000000000] m2 — by A on 2024-03-02",
            "[000000000000] m3 — by A on 2024-03-03"]
        assert sorted(tuple(r) for r in ex.ingest_errors(got).collect()) == [
            ("p", "github_commit", "unreadable record", 2), ("p", "github_issue", "not a JSON object", 2),
            ("p", "github_pr", "no export", 1)]
    mem = ex.ingested_memories(got)
    assert mem.count() == 6 and mem.filter("summary is null").isEmpty()
    cut = ex.repo_ingest(commits, prs, issues, commit_limit=2, pr_limit=0, issue_limit=2)
    assert sorted(r["text"] for r in cut.filter("status <> 'error'").collect()) == [   # the cut comes before the drop
        "Issue #8 (closed): b", "[000000000000] m2 — by A on 2024-03-02", "[000000000000] m3 — by A on 2024-03-03"]
    assert ex.ingest_errors(cut).count() == 3


def test_repeated_requests_each_get_an_outcome(spark):
    urls = ["https://stackoverflow.com/a/42"] * 5 + [None, "no url", "no url"]
    req = spark.createDataFrame([(u, "p") for u in urls], "url string, project string").repartition(3)
    questions = spark.createDataFrame([(10, "Q", "b", 1, 0)],
                                      "question_id bigint, title string, body string, score bigint, answer_count bigint")
    answers = spark.createDataFrame([(42, 10, "use it", 5, True)],
                                    "answer_id bigint, question_id bigint, body string, score bigint, is_accepted boolean")
    got = sorted(r["status"] for r in ex.pattern_store(req, questions, answers, mem_rows(spark, [dict(id=1)])).collect())
    assert got == ["duplicate"] * 4 + ["error"] * 3 + ["stored"]
