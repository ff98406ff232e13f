from collections import Counter

from memweave.llm import host_rules as hr

from .helpers import ODD, docs


def brute(text):
    import re
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [
        (100, "a b c x a b c\na b c\na b c"), (101, "# *$ %&|<> x\nx\n x"), (102, "a a a a a"), (103, "p q r " * 40),
        (104, " ".join(map(str, range(300))) + " 5 6 7 8"), (None, "q"), (105, "l\n\nl\n \nl")]
    got = {r[0]: tuple(r)[1:6] for r in hr.judge(docs(spark, rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {d: brute(t) for d, t in rows}


def test_bad_hosts_take_their_documents_along(spark):
    good, short = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = ([(i, good, "fine") for i in range(40)] + [(50 + i, short, "bad") for i in range(40)] + [(99, good, "bad")]
            + [(100, good, None), (101, short, "tiny"), (102, good, "tiny")])
    got = {r["doc_id"]: r for r in hr.judge(docs(spark, rows)).collect()}
    assert got[0]["kept"] and not got[99]["kept"] and not got[99]["base_failed"] and got[100]["kept"]
    assert abs(got[101]["host_rate"] - 0.5) < 0.1 and not got[101]["kept"]


def test_empty_table(spark):
    assert hr.judge(docs(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = hr.text_counts(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
