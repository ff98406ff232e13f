import hashlib
import itertools
import random
import re
import zlib

from memweave.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as seq", "'x' as edit", "true as blank", "2 as c", "3 as s", "'y' as said", "1 as first", "0 as copy")


def best(rows):
    """Cheapest script by trying all: rows are (role, fault)."""
    found = None
    n = len(rows)
    for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
        for ops in itertools.product("DKR", repeat=n):
            cost, audit, roles, lines = 0, "", "", []
            for i in range(n + 1):
                for x in gaps[i]:
                    cost, audit, roles = cost + 2, audit + "I", roles + x
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if i == n:
                    break
                (role, text, fault), op = rows[i], ops[i]
                audit += op
                if op == "D":
                    cost += 3
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += fault == "truncated"
                if op == "R":
                    cost += 2
                    role = "assistant" if roles.endswith("u") else "user"
                roles += role[:1] or "?"
                lines.append(f"{role}:{text}")
            else:
                continue
            if i == n and GRAMMAR.match(roles) and (found is None or (cost, audit) < found[:2]):
                found = (cost, audit, "\n".join(lines))
    return found


def test_equals_trying_all_scripts(spark):
    rng = random.Random(5)
    convs = {c: [(t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c!", "d?  \n"]))
                 for t in range(rng.randint(0, 3))] for c in range(70)}
    rows = [(c, t, r, x) for c, ts in convs.items() for t, r, x in ts]
    got = {r["conv_id"]: r for r in repair.summaries(repair.repair(turns(spark, rows), window=2)).collect()}
    for c, ts in convs.items():
        if not ts:
            assert c not in got
            continue
        seen, told = set(), []
        for _, r, x in ts:
            told.append((r, x, "blank" if not x.strip() else "duplicate" if (r, x) in seen else
                         None if x.strip()[-1] in ".!?" else "truncated"))
            seen.add((r, x))
        cost, audit, text = best(told)
        assert (got[c]["cost"], got[c]["audit"]) == (cost, audit), (ts, got[c])
        assert got[c]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        for f in ("blank", "duplicate", "truncated"):
            assert got[c][f] == sum(x[2] == f for x in told)


def sequential(rows, window):
    solver, out = repair._Solver(window), []
    for r in rows:
        out += solver.push(r)
    return "".join(e for e, _, _ in out + solver.finish())


def test_windows_do_not_change_the_result():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(t, rng.choice("uuaas"), "x", None, rng.choice([None, None, "truncated", "blank"])) for t in range(rng.randint(1, 60))]
        whole = sequential(rows, 1000)
        assert sequential(rows, 1) == whole and sequential(rows, 7) == whole


def test_long_conversation_holds_a_window_only():
    rows = [(t, "ua"[t % 2], "x", None, None) for t in range(20_000)]
    solver = repair._Solver(64)
    most = 0
    for r in rows:
        solver.push(r)
        most = max(most, len(solver.pending) + len(solver.fresh))
    assert most <= 200


def test_damage_nulls_and_order(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "user", "Hi there."), (1, "assistant", "Yes!"), (2, None, None), (None, "user", "q")]]
    rows += [(None, 1, "user", "a."), (None, 1, "user", "a."), (50, 5, "assistant", "x" * 10_000 + ".")]
    got = {r["conv_id"]: r for r in repair.digests(turns(spark, rows)).collect()}
    assert set(got) == {*range(40), 50, None}
    for c in (*range(40), 50):
        kinds = {t: zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20 for _, t, _, _ in [r for r in rows if r[0] == c]}
        if all(k == 0 for k in kinds.values()):
            assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
        left = sorted({t for t, k in kinds.items() if k and t is not None})
        assert got[c]["gaps"] == (left[-1] - left[0] + 1 - len(left) if left else 0)


def test_empty_table(spark):
    assert repair.digests(turns(spark, [])).collect() == []
    assert repair.repair(turns(spark, [])).collect() == []
