import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from memweave.llm import xent_difference as xd

from .helpers import ODD, docs, words


def brute(rows, target):
    texts = [words(t) + ["</s>"] for _, t in rows]
    vocabulary = len({w for t in texts for w in t}) + 1

    def model(chosen):
        uni, bi, hist = Counter(), Counter(), Counter()
        for t in chosen:
            for v, w in zip(["<s>"] + t, t):
                uni[w] += 1
                bi[v, w] += 1
                hist[v] += 1
        n = sum(uni.values())

        def p(v, w):
            if hist[v]:
                return .6 * bi[v, w] / hist[v] + .3 * uni[w] / max(1, n) + .1 / vocabulary
            return .9 * uni[w] / max(1, n) + .1 / vocabulary
        return p
    pt, pb = model([t for (d, _), t in zip(rows, texts) if d in target]), model(texts)
    out = []
    for (d, _), t in zip(rows, texts):
        pairs = list(zip(["<s>"] + t, t))
        out.append((d, len(t), *(-sum(math.log(p(*x)) for x in pairs) / len(pairs) for p in (pt, pb))))
    return out


ROWS = ([(i, t) for i, t in enumerate(ODD)] + [(100 + i, "the cat sat on the mat the cat ran") for i in range(3)]
        + [(200 + i, f"dog {i} barks at the {i % 3} moon") for i in range(20)] + [(None, "the cat"), (201, "dog 1")])


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_losses_equal_direct_counts(spark, block_bytes):
    target = {100, 101, 205, 3}
    labels = spark.createDataFrame([(i,) for i in [*target, 100, None, 9999]], "doc_id long")
    got = xd.score(docs(spark, ROWS), labels, block_bytes).collect()
    order = lambda r: (str(r[0]), r[1], r[2])
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(brute(ROWS, target), key=order), strict=True):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:], rel=1e-9) and g[4] == pytest.approx(w[2] - w[3], abs=1e-9)


def test_target_like_texts_score_lower(spark):
    labels = spark.createDataFrame([(100,), (101,)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in xd.score(docs(spark, ROWS), labels).collect()}
    assert got[102] < 0 < got[210]


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = [(1, "a b"), (2, None)]
    got = {r["doc_id"]: r for r in xd.score(docs(spark, rows), none).collect()}
    want = {w[0]: w for w in brute(rows, set())}
    assert all(got[d]["target_loss"] == pytest.approx(want[d][2]) for d in want)
    assert xd.score(docs(spark, []), none).collect() == []


def test_a_block_is_counted_in_little_memory():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 200_000) for _ in range(4000)]
    table = pa.table({"doc_id": range(len(texts)), "text": texts})
    n = sum(len(t.split()) + 1 for t in texts)
    tracemalloc.start()
    _, sizes, keys, u, b, hit, every = xd._counted(table, {1, 2})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.sum() == len(u) == len(b) == n and peak < 70 * n      # bytes a token
    odd = keys & np.uint64(1) == 1
    assert every[odd].sum() == every[~odd].sum() == n and hit[odd].sum() == hit[~odd].sum() == sizes[1:3].sum()
