"""Quality classifier: random Fourier features over document statistics.

Method: statistics of each whole text are standardised and mapped by random
Fourier features, whose products approximate a Gaussian kernel.  Ridge
regression is fitted from its normal equations, which partitions sum up; the
rows are dealt to folds, so that subtracting a fold's sums gives the model
that has not seen it.  Isotonic regression on those out-of-fold scores
calibrates the final model's scores to rates of label 1.

The fit uses at most about ``fit_rows`` labelled rows (a documented bound, taken by a
hash of the doc_id); statistics, scores and verdicts cover every row.

Defined results: a null or empty text has statistics 0 and gets a score like any
other.  A null doc_id has no label; it is never held out.  Several labels of one doc_id
count as their mean; null labels are ignored.  Without any label every score is 0.5.
Only ``text`` is an input of a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FIT_ROWS, FOLDS, FEATURES, WIDTH, RIDGE, BINS, SEED = 200_000, 5, 256, 3.0, 1.0, 4096, 20_240
FIT_PARTITIONS = 16
CUT = 0.7
STATISTICS = ("log words", "bytes a word", "distinct words", "log distinct", "symbols a word", "marks a word",
              "digits", "capitals", "lines a word", "repeated lines", "repeated pairs", "most frequent word",
              "beyond ASCII", "log longest word", "lines that end a sentence")


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, len(words))
    size = max(1, len(raw))
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    pairs = len(words) - 1
    return [np.log1p(len(words)), sum(map(len, words)) / n, len(kinds) / n, np.log1p(len(kinds)),
            left(b"#*$%&|<>") / n, left(b"!?=_~^@+{}[]\\/;:\"") / n, left(b"0123456789") / size,
            left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
            1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0, max(kinds.values(), default=0) / n,
            (len(raw) - len((text or ""))) / size, np.log1p(max(map(len, kinds), default=0)),
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double>: one row per input row."""
    def run(batches):
        for b in batches:
            xs = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(xs, pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Standardising, random features, ridge weights and the calibration curve."""

    def __init__(self, mean, std, d: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (d, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(1 + d + FEATURES)
        self.weights[0] = 0.5
        self.xs, self.ys = np.array([0.0]), np.array([0.5])
        self.learnt = True

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.interp(self.features(x) @ self.weights, self.xs, self.ys)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    penalty = np.full(len(b), RIDGE)
    penalty[0] = 1e-6
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the pooled blocks (x ascending)."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    s = np.array(blocks)
    return s[:, 0] / s[:, 2], np.clip(s[:, 1] / s[:, 2], 0, 1)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    d = len(STATISTICS)
    marks = (labels.where("doc_id is not null and quality is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
             .where(~held_out(F.col("doc_id"))))
    rate = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(rate * 1_000_000))
    rows = cut(stats.join(marks, "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold"), "x", "y")
        .repartition(FIT_PARTITIONS))
    got = rows.agg(F.count("*"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not got[0]:
        unlearnt = Model(np.zeros(d), np.ones(d), d)
        unlearnt.learnt = False
        return unlearnt
    model = Model(np.array(got[1::2], float), np.array(got[2::2], float), d)
    p = len(model.weights)

    def sums(batches):
        total = np.zeros((FOLDS, p, p + 1))
        for b in batches:
            z, y, fold = model.features(_matrix(b, d)), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for k in range(FOLDS):
                zk = z[fold == k]
                total[k] += zk.T @ np.hstack([zk, y[fold == k, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    total = np.zeros((FOLDS, p, p + 1))
    for row in rows.mapInArrow(sums, "s binary").toLocalIterator():     # FIT_PARTITIONS matrices of fixed size
        total += np.frombuffer(row["s"]).reshape(total.shape)
    whole = total.sum(axis=0)
    model.weights = _solve(whole[:, :p], whole[:, p])
    unseen = [_solve((whole - t)[:, :p], (whole - t)[:, p]) for t in total]

    def out_of_fold(batches):
        for b in batches:
            z, fold = model.features(_matrix(b, d)), b.column("fold").to_numpy()
            s = np.einsum("ij,ij->i", z, np.stack(unseen)[fold])
            at = np.clip(((s + 1) / 3 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s), b.column("y")], names=["bin", "s", "y"])

    curve = (rows.mapInArrow(out_of_fold, "bin long, s double, y double").groupBy("bin")
             .agg(F.count("*").alias("n"), F.avg("s").alias("s"), F.sum("y").alias("y")).orderBy("bin").collect())
    x, y, n = (np.array([r[c] for r in curve], float) for c in ("s", "y", "n"))
    model.xs, model.ys = isotonic(x, y, n)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    d = len(STATISTICS)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b, d)))],
                                             names=["doc_id", "score"])
    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = cut(document_statistics(docs))
    return scored(stats, fit(stats, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose predicted label is 1; all rows, if there was no label to learn from."""
    model = fit(cut(document_statistics(docs)), labels)
    if not model.learnt:
        return docs

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], float).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= CUT, pa.bool_()))
    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
