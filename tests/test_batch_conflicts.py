"""Mode auto: records of a batch also meet those stored before them; equal to a loop over the records."""
import random
import re

import pytest
from conftest import mem_rows
from pyspark.sql import functions as F

from memweave.operators.conflicts import TECH_RULE, with_batch_conflicts, with_signals
from memweave.operators.gate import gate, status_counts

SAY = ["we use flask", "we use django", "use npm", "use yarn", "use pnpm", "always test", "do not test", "always or do not",
       "redis and docker", "kubernetes", "redis", "avoid x, prefer y", "avoid x", "prefer y", "nothing", "", "use flask and use django"]


def conflict(a, b, type_):
    for rule, side in sorted(a["sides"]):
        if (rule, "b" if side == "a" else "a") in b["sides"]:
            return rule
    if type_ in ("decision", "architecture", "preference") and a["tech"] and b["tech"] and not a["tech"] & b["tech"]:
        return TECH_RULE
    return None


def loop(records, snapshot):
    stored, out = {}, {}
    for r in snapshot:                                           # newest first
        stored.setdefault((r["project"], r["type"]), []).append(r)
    for r in records:
        seen = stored.setdefault((r["project"], r["type"]), [])
        hit = next(((o["id"], c) for o in seen if (c := conflict(r, o, r["type"])) is not None), (None, None))
        out[r["id"]] = hit
        if hit[0] is None:
            seen.insert(0, r)
    return out


def signals(df, text):
    return [r.asDict() | {"sides": {(x["rule"], x["side"]) for x in r["sides"]}, "tech": set(r["tech"])}
            for r in with_signals(df, text).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(1000 + i, rng.choice("pq"), rng.choice(["decision", "bug"]), rng.choice(SAY)) for i in range(90)]
    new = spark.createDataFrame(rows, "id bigint, project string, type string, text string").repartition(3)
    snap = mem_rows(spark, [{"id": i, "project": rng.choice("pq"), "type": "decision", "summary": rng.choice(SAY), "minute": i}
                            for i in range(3)])
    got = {r["id"]: (r["conflict_with"], r["conflict_rule"]) for r in with_batch_conflicts(new, snap).collect()}
    records = sorted(signals(new, "text"), key=lambda r: r["id"])
    want = loop(records, sorted(signals(snap, "summary"), key=lambda r: -r["id"]))
    assert got == want and len(set(v for v in got.values() if v[0])) > 3


def test_a_chain_is_decided_in_order(spark):
    """flask - django - flask: the second is refused, so the third is stored, whatever came between."""
    rows = [(1, "p", "bug", "session", "we use flask"), (2, "p", "bug", "session", "we use django"),
            (3, "p", "bug", "session", "we use flask"), (4, "p", "nonsense", "session", "we use django")]
    new = spark.createDataFrame(rows, "id bigint, project string, type string, source string, text string")
    snap = mem_rows(spark, [{"id": 90, "summary": "nothing", "type": "bug"}])
    got = {r["id"]: (r["status"], r["conflict_with"]) for r in gate(new, snap, mode="auto").collect()}
    assert got == {1: ("stored", None), 2: ("conflict_detected", 1), 3: ("stored", None), 4: ("error", None)}
    back = {r["id"]: r["status"] for r in gate(new.withColumn("at", -F.col("id")), snap, mode="auto", order=["at"]).collect()}
    assert back == {3: "stored", 2: "conflict_detected", 1: "stored", 4: "error"}


def test_empty_batch(spark):
    new = spark.createDataFrame([], "id bigint, project string, type string, source string, text string")
    assert gate(new, mem_rows(spark, [{"id": 1, "summary": "use npm"}]), mode="auto").collect() == []


@pytest.mark.parametrize("mode", ["auto", "approval_required"])
def test_counts_do_not_read_the_texts_again(spark, mode):
    """The gated rows are kept in columns, so that a step that asks for no text reads none."""
    mem = mem_rows(spark, [{"id": i, "summary": t, "type": "decision", "project": "p"} for i, t in enumerate(SAY)])
    counts = status_counts(gate(mem.withColumn("text", F.col("summary")).withColumn("nothing", F.lit(None)), mem, mode=mode))
    assert sum(r["n"] for r in counts.collect()) == len(SAY)
    scans = re.findall(r"FileScan parquet \[(.*?)\]", counts._jdf.queryExecution().executedPlan().toString())
    assert scans and not any("clean_text" in x for x in scans)
