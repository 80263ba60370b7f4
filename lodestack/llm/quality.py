"""Operator 6: quality classifier from document statistics.

Every text is described by a few statistics (lengths, character classes, repetition, lines). Random Fourier features
approximate a Gaussian kernel over them; partitions sum the normal equations of a ridge fit to the 0/1 labels, the driver
solves one small system, and isotonic regression turns the fitted values into probabilities. The curve is fitted to values out of
fold: rows are dealt into FOLDS by their id, and each gets its value from the sums of the other folds.

Learned only from labelled rows that are not held out (crc32 of the id as text mod 5 is 0), and of these from at most about
``FIT_ROWS``, taken by a hash of the id. Label, language, source and id never enter a score.

Defined results: null and empty texts are scored like any text (all statistics 0); rows without id are never held out nor
learned from; of several labels of one id the mean counts, null labels are ignored; without usable labels every score is 1; an
empty table gives an empty result; other columns are ignored; the statistics of a very long text are taken over the whole of it, in
memory in proportion to it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_arrow, slices, texts

#: Bound of the labelled rows that the fit uses.
FIT_ROWS = 100_000
FEATURES = 256
RIDGE = 1e-3
#: Folds, and partitions whose sums of normal equations the driver adds up, each FEATURES squared numbers for each fold.
FOLDS, PARTIAL_SUMS = 4, 8
GRID = 2000
#: Rows whose features are made at a time.
ROWS = 1024
N_STATS = 19
UPPER, LOWER, DIGIT = (np.isin(np.arange(256), list(s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
SYMBOL, STOP = np.isin(np.arange(256), list(b"!#$%&*+/<=>@[\\]^_`{|}~")), np.isin(np.arange(256), list(b".,;:?'\"()-"))


def statistics(text: str) -> list[float]:
    raw = text.encode()
    if not raw:
        return [0.0] * N_STATS
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    upper, letters = int(hist[UPPER].sum()), max(1, int(hist[UPPER].sum() + hist[LOWER].sum() + hist[128:].sum() // 2))
    seen, at = Counter(words), list(map(len, words))
    again = sum(map(str.__eq__, words, words[1:]))
    long_lines = list(map(len, lines)) or [0]
    ends = Counter(w[-1] for w in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        sum(at) / n, max(at, default=0) ** 0.5, sum(x <= 3 for x in at) / n,
        upper / letters, int(hist[DIGIT].sum()) / len(raw), int(hist[SYMBOL].sum()) / len(raw), int(hist[STOP].sum()) / len(raw),
        sum(map(str.isupper, words)) / n, sum(c for e, c in ends.items() if not e.isalnum() and e not in ".,;:?") / n, seen["|"] / n,
        len(seen) / n ** 0.9, seen.most_common(1)[0][1] / n if seen else 0.0, again / n,
        1 - len(set(lines)) / m, max(long_lines) / len(text), np.log1p(sum(long_lines) / m),
    ]


STATS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType()))])


def held_out_column(every: int = 5, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == 0, F.lit(False))


@dataclass
class Model:
    """Scale of the statistics, random frequencies, ridge weights, and the calibrated curve."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        parts = [self.features(x[i : i + ROWS]) @ self.weights for i in range(0, len(x), ROWS)]
        return np.clip(np.concatenate([*parts, np.zeros(0)]), -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators; centre and level of each pool, in order."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part, values in slices(batches):
            x = np.array([statistics(t) for t in values], np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS), pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return map_arrow(texts(docs), run, STATS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)  # flatten respects slices


def _short(batches):
    """The batches in slices of ROWS."""
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of labelled ids that are not held out; the mean of several labels of one id."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    return marks.where(~held_out_column())


def bounded(known: DataFrame, total: int, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` of ``total`` rows, taken by a hash of the id."""
    return known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / 2.0**63 < fit_rows / total) if total > fit_rows else known


def fold():
    return (F.floor(F.crc32(F.col("doc_id").cast("string")) / 5) % FOLDS).cast("int")


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7, width: float = 0.35) -> Model:
    """``stats``: of document_statistics; ``labels``: doc_id, quality."""
    known = checkpointed(stats.join(usable(labels), "doc_id").select("doc_id", "x", "y", fold().alias("fold")))
    total = known.count()
    if total > fit_rows:
        known = bounded(known, total, fit_rows)
        total = known.count()  # the ridge counts the rows of the normal equations
    rng = np.random.default_rng(seed)
    frequency, phase = rng.normal(0, width, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), frequency, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([1.0]))
    if not total:
        return model
    row = known.agg(*(F.avg(F.col("x")[i]) for i in range(N_STATS)), *(F.stddev_pop(F.col("x")[i]) for i in range(N_STATS))).first()
    model.mean, spread = np.array(row[:N_STATS], float), np.array(row[N_STATS:], float)
    model.scale = np.where(spread > 1e-9, spread, 1.0)

    def sums(batches):
        a, b, k = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS, np.int64)
        for batch in _short(batches):
            z, y, of = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(of).tolist():
                some = of == f
                a[f] += z[some].T @ z[some]
                b[f] += z[some].T @ y[some]
                k[f] += some.sum()
        some = np.flatnonzero(k)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([a[f].tobytes() for f in some]), pa.array([b[f].tobytes() for f in some]), pa.array(k[some])], ["fold", "a", "b", "k"])

    a, b, k = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS)
    for r in known.coalesce(PARTIAL_SUMS).mapInArrow(sums, "fold int, a binary, b binary, k long").collect():  # at most PARTIAL_SUMS * FOLDS
        a[r["fold"]] += np.frombuffer(r["a"]).reshape(FEATURES + 1, -1)
        b[r["fold"]] += np.frombuffer(r["b"])
        k[r["fold"]] += r["k"]
    ridge = lambda a, b, n: np.linalg.solve(a + RIDGE * max(n, 1) / FEATURES * np.eye(FEATURES + 1), b)
    model.weights = ridge(a.sum(axis=0), b.sum(axis=0), k.sum())
    others = [ridge(a.sum(axis=0) - a[f], b.sum(axis=0) - b[f], k.sum() - k[f]) if k.sum() > k[f] else model.weights for f in range(FOLDS)]

    def out_of_fold(batches):
        for batch in _short(batches):
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.clip((model.features(_matrix(batch)) * np.array(others)[of]).sum(axis=1), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * GRID).astype(np.int64)), batch.column("y")], ["g", "y"])

    curve = known.select("x", "y", "fold").mapInArrow(out_of_fold, "g long, y double").groupBy("g").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("g").collect()  # at most 2 * GRID + 1 rows
    model.knots, model.values = pool_adjacent(np.array([r["g"] / GRID for r in curve]), np.array([r["y"] for r in curve]), np.array([float(r["n"]) for r in curve]))
    return model


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = checkpointed(document_statistics(docs))
    model = fit(stats, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    out = stats.mapInArrow(run, SCORES)
    return out.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns.

    Before the pass over all rows, only the texts are read that the fit uses: ids of labelled rows are bounded by ``fit_rows`` first.
    """
    known = checkpointed(usable(labels).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").select("doc_id"))
    some = bounded(known, known.count(), fit_rows)
    mine = docs.join(F.broadcast(some.withColumnRenamed("doc_id", "__id")), docs["doc_id"].cast("long") == F.col("__id"), "left_semi")  # about fit_rows ids
    model = fit(document_statistics(mine), labels, fit_rows)

    def run(batches):
        for part, values in slices(batches):
            ok = model.score(np.array([statistics(t) for t in values], np.float32).astype(np.float64)) >= threshold
            yield part.filter(pa.array(ok))

    return map_arrow(docs, run, docs.schema)
