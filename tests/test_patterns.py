"""The gate's patterns as they are written against the ways in which texts are searched for them."""
import random

from pyspark.sql import functions as F

from memweave import rules
from memweave.functions.regex import to_java, to_java_replacement
from memweave.functions.text import SIGNS, WORDS, redact, redact_and_scan, rule_sides, scan_findings, tech_set

PIECES = ["use", "Use", "USE", "reuse", "use_", "usé", "éuse", "flask", "Django", "mysql", "sqlite3", "sqlite", "postgresql", "npm", "pnpm", "yarn",
          "node", "nodejs", "next.js", "nextjs", "nextXjs", "python", "do", "not", "do  not", "do not", "always", "always2", "avoid", "prefer",
          "\n", "\r", " ", " ", " ", " ", ", ", ".", "é", "𝒳", "İ", "K", "x" * 9, "y" * 23, "=", "token", "PASSWORD = ", "api_key=abcdef", "://",
          "http://a:", "bcdefghi", "@", "bearer ", "Bearer\t" + "t" * 22, "sk-" + "a" * 33, "sk-", "ant-", "xoxb-1", "gh", "ghs_" + "b" * 36,
          "AKIA" + "Q" * 16, "aws secret '" + "z" * 40 + "'", "authorization: basic " + "Q" * 11, "-----BEGIN PRIVATE " + "KEY-----", "hf_" + "e" * 33]


def texts(n=1500):
    rnd = random.Random(11)
    return [None, ""] + ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_searches_equal_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string")
    sides = F.filter(F.array(*(F.when(F.col("t").rlike(to_java("(?i)" + p)), F.concat(F.lit(f"{i}"), F.lit(s))) for i, (a, b, _) in
                               enumerate(rules.OPPOSITE_RULES, start=1) for p, s in ((a, "a"), (b, "b")))), lambda x: x.isNotNull())
    plain = F.col("t")
    for p, r in rules.REDACTIONS:
        plain = F.regexp_replace(plain, F.lit(to_java(p)), F.lit(to_java_replacement(r)))
    found = F.filter(F.array(*(F.when(F.col("t").rlike(to_java(p)), F.lit(label)) for label, p in rules.SECRET_PATTERNS)), lambda x: x.isNotNull())
    terms = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(
        "t", F.lit(to_java(r"(?i)\b(" + "|".join(rules.TECH_TERMS) + r")\b")), 1), lambda x: F.lower(x))))
    rows = df.select("t", F.transform(rule_sides("t"), lambda x: F.concat(x["rule"].cast("string"), x["side"])).alias("sides"), sides.alias("sides0"),
                     redact("t").alias("redacted"), plain.alias("redacted0"), scan_findings("t").alias("found"), found.alias("found0"),
                     tech_set("t").alias("tech"), terms.alias("tech0")).collect()
    for r in rows:
        for c in ("sides", "redacted", "found", "tech"):
            assert r[c] == r[c + "0"], (c, r["t"])
    assert {s for r in rows for s in r["sides"]} >= {"1b", "3b", "7a", "10a", "10b", "11a", "11b"} and sum(len(r["tech"] or []) for r in rows) > 100


def test_redaction_and_scan_in_one_go(spark):
    """Marks of the raw text hold for the redacted one: what redaction puts in (``aws``) counts as well."""
    more = ["AKIA" + "Q" * 16 + " secret '" + "z" * 40 + "'", "x sk_live_" + "f" * 24 + " Secret \"" + "Z" * 40 + "\""]
    rnd = random.Random(5)
    more += ["".join(rnd.choice(PIECES[34:] + more[:1] + ["secret", " '" + "z" * 40 + "'", "AIza" + "g" * 35, "xoxb-1"]) for _ in range(6)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts(300) + more], "t string")
    rows = df.select("t", redact_and_scan("t").alias("s"), redact("t").alias("clean")).withColumn("found", scan_findings("clean")).collect()
    for r in rows:
        assert (r["s"]["clean_text"], r["s"]["findings"]) == (r["clean"], r["found"]), r["t"]
    assert "AWS secret key" in next(r for r in rows if r["t"] == more[0])["found"]


def test_no_replacement_makes_a_mark():
    for _p, r in rules.REDACTIONS:
        put = r.replace("Bearer", "")                      # stands only where it stood
        assert not any(x in put.replace("\\1", "").replace("\\2", "") for x in SIGNS) and not any(w in put.lower() for w in WORDS)


def test_a_text_is_read_once_for_the_rules_sides(spark):
    """One pattern cuts the rules' words out of the text, which is neither lowered nor searched again; their places decide."""
    df = spark.createDataFrame([(t,) for t in texts(2)], "t string")
    plan = df.select(rule_sides("t").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(t#") == 1 and "lower(t#" not in plan and "Contains(t#" not in plan
    got = {t: [(x["rule"], x["side"]) for x in s or []] for t, s in spark.createDataFrame(
        [("dlways",), ("uvoid",), ("do\n\nnot",), ("prefer flask",), ("use\nflask",), ("use a, USE npm",), ("reuse npm",), ("use",)],
        "t string").select("t", rule_sides("t")).collect()}
    assert got == {"dlways": [], "uvoid": [], "do\n\nnot": [(10, "a")], "prefer flask": [(11, "b")], "use\nflask": [],
                   "use a, USE npm": [(8, "a"), (9, "a")], "reuse npm": [], "use": []}
