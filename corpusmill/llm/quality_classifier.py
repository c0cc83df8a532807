"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over document statistics, so ridge
regression on them is kernel ridge regression of a fixed size.  Its normal equations
are sums over rows: each partition adds up its own, and the sums of ``FOLDS`` folds
meet on the driver, whose work does not follow the rows.  The model of all folds but
one scores that one, which gives out-of-fold scores for isotonic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, cut, drop_cut, held_out, importable, row_pass, text_pass, training_rows
from corpusmill.llm.document_statistics import NAMES, statistics

#: Labelled documents that the classifier is fitted on at most; the bound is on rows, whichever they are.
MOST_TRAINING_ROWS = 20_000
FEATURES = 256
GAMMA = 0.02
RIDGE = 1e-4
FOLDS = 4
BINS = 400


@dataclass(frozen=True)
class Model:
    """All that scoring needs: a few hundred kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    #: Isotonic calibration: raw scores and the calibrated scores there.
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return np.interp(self.features(stats) @ self.weights, self.raw, self.calibrated)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins at x with label sums and counts: block centres and their means, rising."""
    blocks: list[list[float]] = []
    for at, s, n in zip(x, total, count, strict=True):
        blocks.append([at * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _solve(cells: np.ndarray, size: int) -> np.ndarray:
    """Ridge weights from the summed upper triangle and right side."""
    upper = np.triu_indices(size)
    gram = np.zeros((size, size))
    gram[upper] = cells[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    rows = gram[-1, -1]  # the last feature is the constant one
    return np.linalg.solve(gram + np.eye(size) * max(rows, 1) * RIDGE, cells[len(upper[0]) :])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAINING_ROWS, seed: int = 7) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out third, one row each.

    Texts are measured where they lie.  With no such rows, or one class only, every score
    is the mean label, or 1/2.
    """
    spark = docs.sparkSession
    importable(spark)
    chosen = training_rows(docs, labels, label, most, "array<double>", lambda texts: [statistics(t) for t in texts])
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = cut(chosen.select(F.col("measured").alias("stats"), "label", fold), "quality")
    stat = [F.get("stats", i) for i in range(len(NAMES))]
    first = train.agg(F.count("*"), F.avg("label"), *[F.avg(s) for s in stat], *[F.stddev_pop(s) for s in stat]).first()
    n, share, k = first[0], first[1], len(NAMES)
    random = np.random.default_rng(seed)
    mean = np.array([x or 0.0 for x in first[2 : 2 + k]])
    scale = np.array([x if x and x > 1e-6 else 1.0 for x in first[2 + k :]])
    blank = Model(mean, scale, random.normal(size=(k, FEATURES)) * np.sqrt(2 * GAMMA), random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.array([0.5 if share is None else float(share)]))
    if not n or share in (0, 1):
        drop_cut(train)
        return blank

    size = FEATURES + 1
    upper = np.triu_indices(size)
    shared = spark.sparkContext.broadcast(blank)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = shared.value.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, k))
            y, fold = batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                own = x[fold == f]
                cells = np.concatenate(((own.T @ own)[upper], own.T @ y[fold == f]))
                sums[f] = sums[f] + cells if f in sums else cells
        for f, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), f, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["fold", "cell", "value"])

    summed = train.mapInArrow(equations, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toArrow()
    folds = np.zeros((FOLDS, len(upper[0]) + size))
    folds[summed["fold"].to_numpy(), summed["cell"].to_numpy()] = summed["value"].to_numpy()
    weights = _solve(folds.sum(axis=0), size)
    without = spark.sparkContext.broadcast(np.array([_solve(folds.sum(axis=0) - own, size) for own in folds]))

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, k))
            raw = (x * without.value[batch.column(2).to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(raw * BINS), -BINS, 2 * BINS).astype(np.int32)), batch.column(1)], names=["bin", "label"])

    bins = train.mapInArrow(unseen, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("total"), F.count("*").alias("n")).toArrow().sort_by("bin")
    drop_cut(train)
    raw, calibrated = isotonic(bins["bin"].to_numpy() / BINS, bins["total"].to_numpy().astype(float), bins["n"].to_numpy().astype(float))
    return Model(mean, scale, blank.frequencies, blank.phases, weights, raw, np.clip(calibrated, 0, 1))


def _stats(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Whole texts are measured, in one narrow pass.  A null or empty text has a score like
    any other text of its statistics, which are zeros.  A null doc_id is not held out.
    Repeated rows give repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            score = shared.value.scores(_stats(as_bytes(batch.column(1))))
            yield {"doc_id": batch.column(0), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return text_pass(docs, "score double, predicted int", work).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns as they are.

    A null or empty text is judged by its statistics, zeros, and stays or goes as a whole;
    repeated rows stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(_stats(as_bytes(batch.column(names.index("text"))))) >= threshold))

    return row_pass(docs, work)
