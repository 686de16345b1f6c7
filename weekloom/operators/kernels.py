"""Support vector machine with an RBF kernel, for any number of rows.

The kernel is approximated from landmark rows (Nystroem): phi(x) = K^(-1/2) k(x), with K the
kernel among the landmarks. One machine per pair of classes is fitted on those features with a
squared hinge loss, all pairs in the same scans: each scan adds up loss, gradient and Hessian
of every pair, and each pair takes its own Newton step on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.ranking import key_digest
from weekloom.operators.solvers import matrix, plain_array, summed
from weekloom.session import stored


@dataclass
class KernelMachine:
    """Fitted pairs; ``residual`` is each pair's largest gradient entry over its rows' total weight."""

    labels: list
    mean: np.ndarray
    deviation: np.ndarray
    landmarks: np.ndarray
    gamma: float
    whiten: np.ndarray
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (pair, feature), the last one the intercept
    residual: np.ndarray
    pair_rows: list[int]

    def optimality(self, spark: SparkSession) -> DataFrame:
        """(first, second, rows, residual) for every pair; a solved pair's residual is about 0."""
        found = [
            (self.labels[a], self.labels[b], n, float(x))
            for (a, b), n, x in zip(self.pairs, self.pair_rows, self.residual)
        ]
        return spark.createDataFrame(found, "first int, second int, rows long, residual double")

    def features(self, x: np.ndarray) -> np.ndarray:
        return landmark_features((x - self.mean) / self.deviation, self.landmarks, self.gamma, self.whiten)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Number of pairs that each class wins; (row, class)."""
        first = self.features(x) @ self.weights.T > 0
        out = np.zeros((len(x), len(self.labels)), np.int64)
        for p, (a, b) in enumerate(self.pairs):
            out[:, a] += first[:, p]
            out[:, b] += ~first[:, p]
        return out

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        """Add ``prediction``, the label with most votes, the lower one of equals."""
        model = self

        @F.pandas_udf("int")
        def number(features: pd.Series) -> pd.Series:
            return pd.Series(model.votes(np.stack(features.to_numpy())).argmax(axis=1) + 1)

        labels = F.array(*[F.lit(v) for v in self.labels])
        return df.withColumn("prediction", F.element_at(labels, number(plain_array(df, features_col))))


def landmark_features(x: np.ndarray, landmarks: np.ndarray, gamma: float, whiten: np.ndarray) -> np.ndarray:
    """Kernel features of standardised rows, and a last column of ones."""
    far = (x**2).sum(axis=1)[:, None] + (landmarks**2).sum(axis=1) - 2 * x @ landmarks.T
    return np.column_stack([np.exp(-gamma * np.maximum(far, 0)) @ whiten, np.ones(len(x))])


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """Inverse square root of a Gram matrix; directions that hold nothing are left out."""
    values, vectors = np.linalg.eigh(gram)
    used = values > values.max() * 1e-10
    return vectors[:, used] / np.sqrt(values[used])


def squared_hinge(
    phi: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, int]], w: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of every pair over some rows, without the penalty."""
    losses, gradients = np.zeros(len(pairs)), np.zeros_like(w)
    hessians = np.zeros((*w.shape, w.shape[1]))
    for p, (a, b) in enumerate(pairs):
        at = np.flatnonzero((y == a) | (y == b))
        side = np.where(y[at] == a, 1.0, -1.0)
        gap = 1 - side * (phi[at] @ w[p])
        live = gap > 0
        at, side, gap = at[live], side[live], gap[live]
        s, f = weight[y[at]], phi[at]
        losses[p] = (s * gap**2).sum()
        gradients[p] = -2 * (s * gap * side) @ f
        hessians[p] = 2 * (f * s[:, None]).T @ f
    return losses, gradients, hessians


def fit_kernel_machine(
    df: DataFrame,
    *,
    features_col: str = "features",
    label_col: str = "label",
    id_col: str = "article_id",
    c: float = 1.0,
    gamma: float | None = None,
    landmarks: int = 128,
    steps: int = 100,
    tolerance: float = 1e-8,
    seed: int = 42,
) -> KernelMachine:
    """Balanced machine over all labelled rows, on features standardised by them.

    ``landmarks`` rows, the first by md5 of their id, span the kernel features; more of them
    come nearer to the exact kernel. ``gamma`` is 1 / number of features unless given. Pair
    (a, b) minimises |w|^2 / 2 + c * sum(weight * max(0, 1 - side * (w phi + intercept))^2).
    The driver holds the landmarks and, per pair, a matrix of their number squared.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(features_col).isNotNull())
    rows = rows.select(id_col, F.col(label_col).alias("label"), plain_array(df, features_col).alias("features"))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        raise ValueError("two classes are needed")
    labels = sorted(sizes)
    counts = np.array([sizes[v] for v in labels], float)
    n, k = counts.sum(), len(labels)
    weight = c * n / (k * counts)
    number = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")) - 1).cast("int")
    table = stored(rows.select(id_col, number.alias("label"), "features"), "kernel-rows")

    mean = summed(table, lambda b: matrix(b, "features").sum(axis=0)) / n
    deviation = np.sqrt(summed(table, lambda b: ((matrix(b, "features") - mean) ** 2).sum(axis=0)) / n)
    deviation = np.where(deviation == 0, 1.0, deviation)
    gamma = 1.0 / len(mean) if gamma is None else gamma
    picked = table.orderBy(key_digest([id_col], str(seed)), id_col).limit(landmarks).select("features").collect()
    marks = (np.array([r[0] for r in picked]) - mean) / deviation
    whiten = inverse_root(landmark_features(marks, marks, gamma, np.eye(len(marks)))[:, :-1])
    pairs = list(combinations(range(k), 2))
    size = whiten.shape[1] + 1

    def at_points(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x = (matrix(batch, "features") - mean) / deviation
            phi = landmark_features(x, marks, gamma, whiten)
            return np.concatenate([v.ravel() for v in squared_hinge(phi, batch.column("label").to_numpy(), weight, pairs, w)])

        sums, m = summed(table, partial), len(pairs)
        losses, gradients = sums[:m], sums[m : m + m * size].reshape(m, size)
        hessians = sums[m + m * size :].reshape(m, size, size).copy()
        plain = np.arange(size - 1)  # the intercept is not penalised
        losses = losses + (w[:, :-1] ** 2).sum(axis=1) / 2
        gradients = gradients + np.column_stack([w[:, :-1], np.zeros(m)])
        hessians[:, plain, plain] += 1.0
        hessians[:, -1, -1] += 1e-12
        return losses, gradients, hessians

    total = np.array([(weight[a] * counts[a] + weight[b] * counts[b]) for a, b in pairs])
    w = np.zeros((len(pairs), size))
    loss, gradient, hessian = at_points(w)
    step, trial = np.ones(len(pairs)), np.zeros_like(w)
    for _ in range(steps):
        residual = np.abs(gradient).max(axis=1) / total
        running = (residual > tolerance) & (step > 1e-6)
        if not running.any():
            break
        move = np.linalg.solve(hessian, -gradient[:, :, None])[:, :, 0]
        trial = np.where(running[:, None], w + step[:, None] * move, w)
        new_loss, new_gradient, new_hessian = at_points(trial)
        slope = (gradient * move).sum(axis=1) * step
        better = running & (new_loss <= loss + 1e-4 * slope + 1e-12 * np.abs(loss))
        step = np.where(better, 1.0, step / 2)
        w = np.where(better[:, None], trial, w)
        loss = np.where(better, new_loss, loss)
        gradient = np.where(better[:, None], new_gradient, gradient)
        hessian = np.where(better[:, None, None], new_hessian, hessian)
    residual = np.abs(gradient).max(axis=1) / total
    return KernelMachine(labels, mean, deviation, marks, gamma, whiten, pairs, w, residual, [int(counts[a] + counts[b]) for a, b in pairs])
