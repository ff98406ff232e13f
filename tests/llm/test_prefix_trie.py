import hashlib
import random
import zlib

import numpy as np
import pytest

from memweave.llm import prefix_trie


def turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as depth", "'x' as said", "2 as bytes", "3 as row_no", "4 as hi", "5 as lo", "6 as base", "7 as salt")


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, key, r, x))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(o) == len(q) + 1 and o[:len(q)] == q for o in below)]
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(n, seed):
    rng = random.Random(seed)
    say = ["", "é", "no", "x" * 50, None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(say)) for c in range(n) for t in range(rng.randint(1, 11))]
    return rows + [(None, 1, "user", "lost")] + [(n + 3, None, "user", "a"), (n + 3, None, "user", "b"), (n + 3, 2, "user", "b")] * 2


@pytest.mark.parametrize("limit", [2, 3, 4096])
def test_equals_brute_force(spark, limit):
    rows = rows_of(45, limit)
    got = prefix_trie.trie(*prefix_trie.rebuilt(turns(spark, rows)), limit=limit).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_copies_of_one_long_conversation(spark):
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(6) for t in range(60)]
    got = prefix_trie.trie(*prefix_trie.rebuilt(turns(spark, rows)), limit=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.trie(*prefix_trie.rebuilt(turns(spark, []))).collect() == []


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    table = prefix_trie.SlotTable(hi, lo)
    assert sorted(table.find(hi, lo)) == list(range(5000))
    assert (table.find(lo, hi) == -1).all() and (table.find(hi, hi) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(hi[[0, 0]], lo[[0, 0]])


def test_colliding_digests_fail(spark):
    df = spark.createDataFrame([(1, 1, 9, 9, 0, 0, "a", 1, True), (2, 1, 9, 9, 0, 0, "b", 1, True)],
                               "conv_id long, depth long, hi long, lo long, phi long, plo long, said string, bytes long, is_end boolean")
    with pytest.raises(Exception, match="one digest"):
        prefix_trie._nodes(df).collect()
