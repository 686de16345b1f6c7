"""Many models at once over shared scans.

A scan adds up what all models need (losses, gradients, histograms) in every task; the tasks'
arrays are added in Spark, chunk by chunk, so the driver receives one array whatever the
number of tasks. Models advance side by side: each scan serves one step of every model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15  # numbers of a partial sum in one row
ROWS = 512  # rows that a task multiplies out at a time


def plain_array(df: DataFrame, column: str) -> Column:
    """A vector or array column as an array of doubles."""
    is_vector = isinstance(df.schema[column].dataType, VectorUDT)
    return vector_to_array(F.col(column)) if is_vector else F.col(column).cast("array<double>")


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column whose rows have one length."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``partial`` over all rows, ``ROWS`` at a time; zeros stand for an empty table."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                value = partial(batch.slice(at, ROWS))
                total = value if total is None else total + value
        if total is not None:
            parts = [total[i : i + CHUNK] for i in range(0, len(total), CHUNK)]
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.record_batch(columns, names=["chunk", "part"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in parts["part"].to_pylist())
        return pa.table({"chunk": parts["chunk"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part binary"
    found = rows.mapInArrow(add_up, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    parts = {r["chunk"]: np.frombuffer(r["part"]) for r in found}
    return np.concatenate([np.zeros(0), *(parts[i] for i in sorted(parts))])


class Descent:
    """Limited-memory BFGS for many independent convex problems.

    Every call of ``tell`` brings losses and gradients at the points that ``ask`` gave for the
    problems still running. Each takes its own step or shortens it; none waits for another.
    """

    MEMORY, SUFFICIENT, SHORTEST = 10, 1e-4, 1e-10

    def __init__(self, start: np.ndarray, tolerance: float, steps: int):
        self.at, self.tolerance, self.steps = start.copy(), tolerance, steps
        n = len(start)
        self.loss, self.gradient = np.full(n, np.inf), np.zeros_like(start)
        self.direction, self.size = np.zeros_like(start), np.zeros(n)
        self.taken, self.running = np.zeros(n, int), np.ones(n, bool)
        self.history: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]

    def ask(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the running problems, and their points to evaluate."""
        live = np.flatnonzero(self.running)
        return live, self.at[live] + self.size[live, None] * self.direction[live]

    def tell(self, live: np.ndarray, points: np.ndarray, losses: np.ndarray, gradients: np.ndarray) -> None:
        for i, point, loss, gradient in zip(live, points, losses, gradients):
            slope = self.size[i] * (self.gradient[i] @ self.direction[i])
            if np.isfinite(self.loss[i]) and not loss <= self.loss[i] + self.SUFFICIENT * slope:
                self.size[i] /= 2
                if self.size[i] < self.SHORTEST:
                    self.running[i] = False
                continue
            if np.isfinite(self.loss[i]):
                moved, turned = point - self.at[i], gradient - self.gradient[i]
                if moved @ turned > 1e-12 * (turned @ turned):
                    self.history[i] = [*self.history[i], (moved, turned)][-self.MEMORY :]
                self.taken[i] += 1
            self.at[i], self.loss[i], self.gradient[i] = point, loss, gradient
            if np.abs(gradient).max(initial=0.0) <= self.tolerance or self.taken[i] >= self.steps:
                self.running[i] = False
                continue
            self.direction[i] = -self._scaled(i, gradient)
            self.size[i] = 1.0 if self.history[i] else min(1.0, 1.0 / np.linalg.norm(gradient))

    def _scaled(self, i: int, gradient: np.ndarray) -> np.ndarray:
        """The inverse Hessian, as known from the last steps, times the gradient."""
        out, weights = gradient.copy(), []
        for moved, turned in reversed(self.history[i]):
            weights.append((moved @ out) / (moved @ turned))
            out -= weights[-1] * turned
        if self.history[i]:
            moved, turned = self.history[i][-1]
            out *= (moved @ turned) / (turned @ turned)
        for (moved, turned), weight in zip(self.history[i], reversed(weights)):
            out += (weight - (turned @ out) / (moved @ turned)) * moved
        return out


class LogisticGrid:
    """Balanced multinomial logistic regressions for all penalties and training sets at once.

    ``rows`` holds ``label`` (from 0), ``features`` (array of doubles) and ``folds`` (one fold
    per repeat). Model (penalty c, repeat r, fold f) is fitted on the rows whose fold in repeat
    r is not f: features standardised by those rows, classes weighted inversely to their size,
    loss sum(weight * log loss) + |w|^2 / (2 c); c = 0 means no penalty, f = -1 all rows.
    """

    def __init__(self, rows: DataFrame, n_classes: int, n_features: int, models: list[tuple[float, int, int]]):
        self.rows, self.k, self.d, self.models = rows, n_classes, n_features, models
        self.sets = sorted({(r, f) for _, r, f in models})
        self.set_of = np.array([self.sets.index((r, f)) for _, r, f in models])
        self.repeat, self.fold = np.array([r for _, r, _ in models]), np.array([f for *_, f in models])
        self._scale()

    def _scale(self) -> None:
        """Mean, deviation and class weights of every training set, in two scans."""
        sets, k, d = self.sets, self.k, self.d

        def inside(batch: pa.RecordBatch) -> np.ndarray:
            folds = matrix(batch, "folds")
            return np.stack([(folds[:, r] != f) for r, f in sets]).astype(np.float64)

        def first(batch: pa.RecordBatch) -> np.ndarray:
            hot = np.eye(k)[batch.column("label").to_numpy()]
            mask = inside(batch)
            return np.concatenate([(mask @ matrix(batch, "features")).ravel(), (mask @ hot).ravel()])

        sums = summed(self.rows, first)
        counts = sums[len(sets) * d :].reshape(len(sets), k)
        n = counts.sum(axis=1)
        self.mean = sums[: len(sets) * d].reshape(len(sets), d) / n[:, None]
        mean = self.mean

        def second(batch: pa.RecordBatch) -> np.ndarray:
            x, mask = matrix(batch, "features"), inside(batch)
            return np.stack([m @ (x - center) ** 2 for m, center in zip(mask, mean)]).ravel()

        deviation = np.sqrt(summed(self.rows, second).reshape(len(sets), d) / n[:, None])
        self.deviation = np.where(deviation == 0, 1.0, deviation)
        present = (counts > 0).sum(axis=1)
        with np.errstate(divide="ignore"):
            self.class_weight = np.where(counts > 0, n[:, None] / (present[:, None] * counts), 0.0)
        self.total = n
        c = np.array([c for c, *_ in self.models])
        self.penalty = np.where(c > 0, 1.0 / np.where(c > 0, c, 1.0) / n[self.set_of], 0.0)

    def _flat(self, live: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts for features as they are, one row per model and class."""
        w = points.reshape(len(live), self.k, self.d + 1)
        s = self.set_of[live]
        plain = w[:, :, :-1] / self.deviation[s][:, None, :]
        return plain.reshape(-1, self.d), w[:, :, -1] - (plain * self.mean[s][:, None, :]).sum(axis=2)

    def evaluate(self, live: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean loss with penalty and its gradient, for some of the models, in one scan."""
        w, b = self._flat(live, points)
        k, d, m = self.k, self.d, len(live)
        class_weight, repeat, fold = self.class_weight[self.set_of[live]], self.repeat[live], self.fold[live]

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x, y, folds = matrix(batch, "features"), batch.column("label").to_numpy(), matrix(batch, "folds")
            weight = class_weight[:, y].T * (folds[:, repeat] != fold)
            z = (x @ w.T).reshape(len(x), m, k) + b
            z -= z.max(axis=2, keepdims=True)
            own = np.take_along_axis(z, y[:, None, None], axis=2)[:, :, 0].copy()
            np.exp(z, out=z)
            norm = z.sum(axis=2, keepdims=True)
            loss = (weight * (np.log(norm[:, :, 0]) - own)).sum(axis=0)
            z /= norm
            z[np.arange(len(x)), :, y] -= 1.0
            z *= weight[:, :, None]
            return np.concatenate([loss, (z.reshape(len(x), -1).T @ x).ravel(), z.sum(axis=0).ravel()])

        sums, s = summed(self.rows, partial), self.set_of[live]
        by_feature, by_class = sums[m : m + m * k * d].reshape(m, k, d), sums[m + m * k * d :].reshape(m, k)
        inner = points.reshape(m, k, d + 1)[:, :, :-1]
        scaled = (by_feature - by_class[:, :, None] * self.mean[s][:, None, :]) / self.deviation[s][:, None, :]
        total, penalty = self.total[s], self.penalty[live]
        gradient = np.concatenate([scaled, by_class[:, :, None]], axis=2) / total[:, None, None]
        gradient[:, :, :-1] += penalty[:, None, None] * inner
        return sums[:m] / total + penalty / 2 * (inner**2).sum(axis=(1, 2)), gradient.reshape(m, -1)

    def fit(self, tolerance: float = 1e-4, steps: int = 100) -> LogisticGrid:
        """All models, each until its gradient's largest entry is at most ``tolerance``."""
        found = Descent(np.zeros((len(self.models), self.k * (self.d + 1))), tolerance, steps)
        while found.running.any():
            live, points = found.ask()
            found.tell(live, points, *self.evaluate(live, points))
        self.points, self.residual, self.taken = found.at, np.abs(found.gradient).max(axis=1), found.taken
        return self

    def confusion(self) -> np.ndarray:
        """Counts (model, label, prediction) over the rows that each model did not see, in one scan."""
        every = np.arange(len(self.models))
        w, b = self._flat(every, self.points)
        k, m, repeat, fold = self.k, len(every), self.repeat, self.fold

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x, y, folds = matrix(batch, "features"), batch.column("label").to_numpy(), matrix(batch, "folds")
            found = ((x @ w.T).reshape(len(x), m, k) + b).argmax(axis=2)
            row, model = np.nonzero(folds[:, repeat] == fold)
            return np.bincount((model * k + y[row]) * k + found[row, model], minlength=m * k * k).astype(np.float64)

        return summed(self.rows, partial).reshape(m, k, k).astype(np.int64)
