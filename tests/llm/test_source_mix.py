from collections import defaultdict

import pytest

from memweave.llm import source_mix as sm

from .helpers import docs, words


def by_rounds(sizes):
    """Targets by filling up, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free} | {s: 2.0 * sizes[s] for s in full}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return got
        full |= over


def many(n=900):
    return [(i, " ".join(["w"] * (1 + i * 7 % 60)), [None, "a", "b", "é", "Z", "big"][min(i % 9, 5)]) for i in range(n)]


def test_targets_and_words_taken(spark):
    rows = many() + [(5000, None, "a"), (5001, "", "nothing"), (5002, " \n", "nothing")]
    got = sm.copies(docs(spark, rows)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += len(words(t))
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    want = by_rounds(sizes)
    assert set(target) == set(want)
    for s in want:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= 31          # half of the largest document
    assert len(got) == len(rows)


def test_reruns_agree_on_any_partitioning(spark):
    df = docs(spark, many(300))
    key = lambda x: sorted((r["doc_id"], r["copies"]) for r in sm.copies(x).collect())
    assert key(df) == key(df.repartition(7)) == key(df.orderBy("text"))


def test_rates_hold_over_many_documents(spark):
    got = sm.copies(docs(spark, [(i, "w x y", "a") for i in range(3000)] + [(9999, "w " * 27000, "b")])).collect()
    a = [r["copies"] for r in got if r["source"] == "a"]
    first, second = sum(a[:1500]), sum(a[1500:])
    assert abs(first - second) < 200                  # no stretch of the input is preferred


def test_the_mix_repeats_rows(spark):
    rows = many(120) + [(7, "same text", "a")] * 9 + [(None, None, None)]
    df = docs(spark, rows)
    total = sum(r["copies"] for r in sm.copies(df).collect())
    mixed = sm.mix(df)
    assert mixed.columns == df.columns and mixed.count() == total


def test_empty_table_and_empty_texts(spark):
    assert sm.copies(docs(spark, [])).collect() == []
    assert [r["copies"] * r["size"] for r in sm.copies(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_no_python_in_the_plan(spark):
    plan = sm.mix(docs(spark, many(50)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
