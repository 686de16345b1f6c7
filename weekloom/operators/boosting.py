"""Gradient-boosted trees for all classes at once, on features cut into quantile bins.

Every round grows one tree per class on the gradients of the softmax loss. A level of all
trees is one scan: tasks add up histograms by class, node, feature and bin, and the best
splits are read off the sums. Gradients are rounded to multiples of 2^-20 first, so sums do
not depend on the order of rows and the same rows always give the same trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.solvers import matrix, plain_array, summed
from weekloom.session import stored

GRID = float(1 << 20)
REFRESH = 10  # rounds after which scores are written, so that a scan replays few trees


@dataclass
class Round:
    """One tree per class as arrays (class, node); nodes of a level stand side by side, and a
    node that is not split (feature -1) passes all rows to its left child."""

    feature: np.ndarray
    threshold: np.ndarray  # a row goes left if its bin is at most this
    value: np.ndarray  # by leaf

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Leaf, or node ``depth`` levels down, of each row in each tree: (row, class)."""
        node = np.zeros((len(bins), len(self.feature)), np.int64)
        trees = np.arange(len(self.feature))
        for level in range(depth):
            at = (1 << level) - 1 + node
            feature = self.feature[trees, at]
            row_bins = np.take_along_axis(bins, np.maximum(feature, 0), axis=1)
            node = 2 * node + ((feature >= 0) & (row_bins > self.threshold[trees, at]))
        return node

    def scores(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.take_along_axis(self.value.T, self.leaves(bins, depth), axis=0)


@dataclass
class BoostedTrees:
    """Fitted rounds; ``losses`` holds the mean log loss before each round and after the last."""

    labels: list
    edges: list[np.ndarray]  # ascending bin edges of each feature
    prior: np.ndarray
    rounds: list[Round]
    losses: list[float]
    depth: int
    n_rows: int

    def summary(self, spark: SparkSession) -> DataFrame:
        """(rounds, classes, trees, rows, falls): ``falls`` tells whether every round lowered the loss."""
        k, n = len(self.labels), len(self.rounds)
        falls = all(b < a for a, b in zip(self.losses, self.losses[1:]))
        return spark.createDataFrame([(n, k, n * k, self.n_rows, falls)], "rounds long, classes long, trees long, rows long, falls boolean")

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """Scores before the softmax; (row, class)."""
        bins = cut(x, self.edges)
        out = np.tile(self.prior, (len(x), 1))
        for r in self.rounds:
            out += r.scores(bins, self.depth)
        return out

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        """Add ``prediction`` and ``probability`` (one number per label)."""
        model = self

        @F.pandas_udf("array<double>")
        def probability(features: pd.Series) -> pd.Series:
            return pd.Series(list(softmax(model.raw_scores(np.stack(features.to_numpy())))))

        labels = F.array(*[F.lit(v) for v in self.labels])
        out = df.withColumn("probability", probability(plain_array(df, features_col)))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("prediction", F.element_at(labels, best))


def cut(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def softmax(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every feature over all rows, at most ``bins`` - 1 each."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    values = rows.select(F.posexplode("features").alias("feature", "value"))
    found = values.groupBy("feature").agg(F.percentile_approx("value", shares, 10_000).alias("edges"))
    by_feature = {r["feature"]: np.unique(np.array(r["edges"])) for r in found.collect()}
    return [by_feature[j] for j in range(len(by_feature))]


def histogram(bins: np.ndarray, node: np.ndarray, gradient: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """Sums (class, node, feature, bin, what) of rows, gradients and |g| (1 - |g|)."""
    k, d = gradient.shape[1], bins.shape[1]
    curve = np.round(np.abs(gradient) * (1 - np.abs(gradient)) * GRID)
    whole = np.round(gradient * GRID)
    cells = (np.arange(d) * size + bins)[:, None, :] + (node * (d * size))[:, :, None]
    out = np.empty((k, 3, nodes * d * size))
    for c in range(k):
        at = cells[:, c].ravel()
        out[c, 0] = np.bincount(at, minlength=nodes * d * size)
        out[c, 1] = np.bincount(at, np.repeat(whole[:, c], d), nodes * d * size)
        out[c, 2] = np.bincount(at, np.repeat(curve[:, c], d), nodes * d * size)
    return out.reshape(k, 3, nodes, d, size).transpose(0, 2, 3, 4, 1)


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of the best split per class and node, -1 where there is none; the lower
    feature and bin of equals. A split is better the further its sides' means are apart, by
    n_left * n_right / n * (mean_left - mean_right)^2."""
    left = sums.cumsum(axis=3)[:, :, :, :-1]
    right = sums.sum(axis=3, keepdims=True) - left
    n_left, n_right, g_left, g_right = left[..., 0], right[..., 0], left[..., 1], right[..., 1]
    n = n_left * n_right
    gain = np.where(n > 0, (n_right * g_left - n_left * g_right) ** 2 / np.where(n > 0, n * (n_left + n_right), 1), -1.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)
    valid = np.take_along_axis(flat, best[:, :, None], axis=2)[:, :, 0] > 0
    return np.where(valid, best // gain.shape[3], -1), np.where(valid, best % gain.shape[3], 0)


def leaf_values(sums: np.ndarray, feature: np.ndarray, threshold: np.ndarray, step: float) -> np.ndarray:
    """Values of both children of every node of the last level: one Newton step, shortened."""
    k, nodes, _, size, _ = sums.shape
    own = np.take_along_axis(sums, np.maximum(feature, 0)[:, :, None, None, None], axis=2)[:, :, 0]
    goes_left = (np.arange(size) <= threshold[:, :, None]) | (feature < 0)[:, :, None]
    left = (own * goes_left[..., None]).sum(axis=2)
    both = np.stack([left, own.sum(axis=2) - left], axis=2).reshape(k, 2 * nodes, 3)
    g, curve = both[..., 1] / GRID, both[..., 2] / GRID
    return step * (k - 1) / k * np.where(curve > 0, g / np.where(curve > 0, curve, 1), 0.0)


def _added(rounds: list[Round], depth: int):
    """Scores with those of some rounds added."""

    @F.pandas_udf("array<double>")
    def added(row_bins: pd.Series, scores: pd.Series) -> pd.Series:
        b, out = np.stack(row_bins.to_numpy()).astype(np.int64), np.stack(scores.to_numpy()).copy()
        for r in rounds:
            out += r.scores(b, depth)
        return pd.Series(list(out))

    return added


def fit_boosting(
    df: DataFrame,
    *,
    features_col: str = "features",
    label_col: str = "label",
    trees: int = 100,
    depth: int = 3,
    step: float = 0.1,
    bins: int = 64,
) -> BoostedTrees:
    """Boosted trees over all labelled rows; the softmax loss of two classes also gets two trees.

    Rows without label or features take no part. The driver gets class counts, bin edges and
    histograms: classes * nodes * features * bins numbers, whatever the number of rows.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(features_col).isNotNull())
    rows = rows.select(F.col(label_col).alias("label"), plain_array(df, features_col).alias("features"))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        raise ValueError("no labelled rows")
    labels = sorted(sizes)
    n, k = sum(sizes.values()), len(labels)
    prior = np.log(np.array([sizes[v] for v in labels]) / n)
    edges = bin_edges(rows, bins)
    size = max(len(e) for e in edges) + 1

    @F.pandas_udf("array<int>")
    def binned(features: pd.Series) -> pd.Series:
        return pd.Series(list(cut(np.stack(features.to_numpy()), edges).astype(np.int32)))

    number = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")) - 1).cast("int")
    start = F.array(*[F.lit(float(p)) for p in prior])
    state = stored(rows.select(number.alias("label"), binned("features").alias("bins"), start.alias("scores")), "boosting-rows")
    done: list[Round] = []
    recent: list[Round] = []
    losses: list[float] = []

    def scored(batch: pa.RecordBatch, recent: list[Round]) -> tuple[np.ndarray, np.ndarray]:
        row_bins, scores = matrix(batch, "bins").astype(np.int64), matrix(batch, "scores").copy()
        for r in recent:
            scores += r.scores(row_bins, depth)
        return row_bins, scores

    def loss_of(scores: np.ndarray, y: np.ndarray) -> float:
        p = softmax(scores)[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-300)).sum()

    for _ in range(trees):
        grown = Round(np.full((k, (1 << depth) - 1), -1), np.zeros((k, (1 << depth) - 1), np.int64), np.zeros((k, 1 << depth)))
        for level in range(depth):

            def partial(batch: pa.RecordBatch, level=level, grown=grown, recent=tuple(recent)) -> np.ndarray:
                row_bins, scores = scored(batch, recent)
                y = batch.column("label").to_numpy()
                gradient = np.eye(k)[y] - softmax(scores)
                node = grown.leaves(row_bins, level)
                sums = histogram(row_bins, node, gradient, 1 << level, size)
                return np.append(sums.ravel(), loss_of(scores, y))

            found = summed(state, partial)
            sums = found[:-1].reshape(k, 1 << level, len(edges), size, 3)
            if level == 0:
                losses.append(float(found[-1]) / n)
            feature, threshold = best_splits(sums)
            here = slice((1 << level) - 1, (2 << level) - 1)
            grown.feature[:, here], grown.threshold[:, here] = feature, threshold
        grown.value[:] = leaf_values(sums, feature, threshold, step)
        done.append(grown)
        recent.append(grown)
        if len(recent) == REFRESH:
            state = stored(state.withColumn("scores", _added(recent, depth)("bins", "scores")), "boosting-rows")
            recent = []

    def last(batch: pa.RecordBatch, recent=tuple(recent)) -> np.ndarray:
        return np.array([loss_of(scored(batch, recent)[1], batch.column("label").to_numpy())])

    losses.append(float(summed(state, last)[0]) / n)
    return BoostedTrees(labels, edges, prior, done, losses, depth, n)
