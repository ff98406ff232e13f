import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memweave.llm import near_dedup as nd

from .helpers import ODD, docs, words


def brute(rows, k):
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    group = {d: {d} for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {d: (len(sets[d]), min(group[d]), min(group[d]) == d) for d in ids}


def variants(seed, n_bases, per_base, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for _ in range(per_base):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_same_groups_as_brute_force(spark, k):
    rows = variants(k, 12, 12, 5) + [(10_000 + i, t) for i, t in enumerate(ODD)]
    got = {r[0]: tuple(r[1:]) for r in nd.near_duplicates(docs(spark, rows), k=k).collect()}
    assert got == brute(rows, k)


def test_null_and_repeated_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "A  b c\nd e f g"), (None, "a b c d e f g"), (9, None), (9, "")]
    got = sorted(map(tuple, nd.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, 2, False), (5, 3, 2, False), (2, 3, 2, True), (None, 3, None, True), (9, 0, 9, True),
                          (9, 0, 9, True)], key=str)


def test_empty_table(spark):
    assert nd.near_duplicates(docs(spark, [])).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    m = nd.BANDS * nd.ROWS
    errors = []
    for _ in range(20):
        x = rng.integers(1, 1 << 62, 150, dtype=np.uint64)
        y = np.concatenate([x[:100], rng.integers(1, 1 << 62, 50, dtype=np.uint64)])
        sig = nd.super_minhash(np.concatenate([x, y]), np.repeat([0, 1], 150), 2, m)
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < (0.25 / m) ** 0.5 * 1.4


def test_every_position_is_filled_even_for_one_element():
    sig = nd.super_minhash(np.array([7], np.uint64), np.array([0]), 1, 240)
    assert sorted((sig[0] >> np.uint64(32)).tolist()) == list(range(240))


@pytest.mark.parametrize("one_task", [0, 10, 250_000])
def test_chains_are_one_component(spark, monkeypatch, one_task):
    monkeypatch.setattr(nd, "ONE_TASK_LINKS", one_task)
    n = 60
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(101, 100), (102, 101)], "a long, b long")).repartition(8)
    got = {r["id"]: r["comp"] for r in nd.connected(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 102: 100}


def test_bucket_left_overs_are_compared_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 4)
    monkeypatch.setattr(nd, "STAR_ROUNDS", 0)
    rows = variants(11, 3, 25, 14)
    got = {r[0]: tuple(r[1:]) for r in nd.near_duplicates(docs(spark, rows), k=2).collect()}
    assert got == brute(rows, 2)


REPEATED = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "own words of another text"), (7, "Own words of another text"),
            (4, "p q r s t u v"), (4, "p q r s t u v"), (None, "P q r s t u v"), (None, "only here and not elsewhere"),
            (None, "only here and not elsewhere"), (2, "A b c d e f g"), (5, "unique to this one row"), (8, None), (8, None)]


def test_each_text_of_a_repeated_id_is_judged_by_itself(spark):
    got = sorted(map(tuple, nd.near_duplicates(docs(spark, REPEATED)).collect()), key=str)
    assert got == sorted([(5, 3, 2, False), (5, 3, 2, False), (5, 1, 5, True), (7, 1, 5, False), (4, 3, 4, True),
                          (4, 3, 4, False), (None, 3, None, True), (None, 1, None, True), (None, 1, None, True),
                          (2, 3, 2, True), (5, 1, 5, True), (8, 0, 8, True), (8, 0, 8, True)], key=str)


def test_the_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline
    df = docs(spark, REPEATED)
    out = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(2, "A b c d e f g"), (5, "own words of another text"), (4, "p q r s t u v"),
         (None, "only here and not elsewhere"), (5, "unique to this one row"), (8, None), (8, None)], key=str)


def near_copies(n, seed=4, size=60, changes=3):
    """n copies of one base text, each with some words replaced: most reach 0.8 to the base and not to each other."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for at in rng.sample(range(size), rng.choice([changes, changes, changes + 2])):
            own[at] = rng.choice([f"x{rng.random()}", f"y{rng.randint(0, 3)}"])
        out.append((i, " ".join(own)))
    return out


def by_definition(rows, k, percent=80):
    sets = {i: {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    holders = {}
    for i, s in sets.items():
        for e in s:
            holders.setdefault(e, []).append(i)
    parent = {i: i for i in sets}
    for i, s in sets.items():
        common = {}
        for e in s:
            for j in holders[e]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = nd._find(parent, i), nd._find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: nd._find(parent, i) for i in sets}


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """With and without its base: equal to a brute force, and the rows of the last step grow with the group and not its square."""
    sent = []
    real = nd._family_links

    def counted(families, sets, percent, partitions):
        sent.append(families.count())
        return real(families, sets, percent, partitions)
    monkeypatch.setattr(nd, "_family_links", counted)
    for n in (300, 600):
        for drop in (0, 1):
            rows = near_copies(n)[drop:]
            got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs(spark, rows), k=2).collect()}
            assert got == by_definition(rows, 2)
    assert all(s <= 600 for s in sent)


def test_common_sizes_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 400))).astype(np.uint64) for _ in range(40)]
    got = nd._common(sets[:15], sets[15:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]).all()
