import math
import random

import pytest
from pyspark.sql import functions as F

from memweave.llm import norm_buckets as nb


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k=5):
    import numpy as np
    floor = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    good = [(i, floor(v)) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in good if i in queries}.items()):
        found = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def run(spark, rows, queries, k=5):
    t = table(spark, rows)
    got = nb.top_k(t, t.where(F.col("vec_id").isin(list(queries)))).collect()
    return sorted(map(tuple, got))


def vectors(seed, n, dim, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c, size = rng.choice(centres), math.exp(rng.gauss(0, spread))
        rows.append((i, [size * (x + rng.gauss(0, .3)) for x in c]))
    return rows


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(nb, "TILE", 64)
    monkeypatch.setattr(nb, "STEP", 16)
    monkeypatch.setattr(nb, "SEEDS", 20)
    monkeypatch.setattr(nb, "QUERY_BLOCK", 8)
    rows = vectors(1, 400, 12, spread)
    queries = set(range(0, 400, 20))
    assert run(spark, rows, queries) == brute(rows, queries)


def test_ties_repeats_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(12)] + [(3, [1.0, 0.0]), (20, None), (21, [nan, 1.0]), (22, [inf, 1.0]),
                                                   (23, [None, 1.0]), (None, [9.0, 9.0]), (24, [0.0, 0.0]),
                                                   (25, [-1.0, -1.0]), (26, [1.0, 2.0, 3.0]), (27, []), (28, [])]
    queries = {0, 3, 24, 25, 26, 27, 20, 21}
    assert run(spark, rows, queries) == brute(rows, queries)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.25, 3.0])]
    assert run(spark, rows, {1}) == brute(rows, {1})
    assert run(spark, [], {1}) == []


def test_large_components_are_exact(spark):
    rows = [(1, [1.0, 2.0]), (2, [900000.0, 0.0]), (3, [600000.0, 1.0]), (4, [-7e6, 3.0]), (5, [0.25, 7e6]), (6, [5e6, -2e6])]
    assert run(spark, rows, {1, 2, 5, 6}) == brute(rows, {1, 2, 5, 6})


def test_scores_beyond_64_bits_are_held(spark):
    got = run(spark, [(1, [3e38, 1.0]), (2, [3e38, 1.0]), (3, [-3e38, 1.0])], {1})
    assert [r[2:] for r in got] == [(2, (1 << 63) - 1), (3, -1 << 63)]


def test_all_vectors_of_an_asked_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 5.0]), (3, [1.0, 1.0])]
    assert run(spark, rows, {0}) == [(0, n + 1, i, s * 65536) for n, (i, s) in enumerate([(2, 5), (1, 3), (1, 1), (2, 1), (3, 1)])]
