"""Shared-scan models against plain NumPy and Spark ML twins."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from weekloom.operators import boosting, kernels
from weekloom.operators import topics as M


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 240)
    x = rng.normal(0, 1, (240, 4)) + np.array([[0, 0, 0, 0], [1.2, 0, 0.5, 0], [0, 1.2, 0, 0]])[y]
    x[:, 3] = 7.0  # a constant feature
    return x, y


@pytest.fixture(scope="module")
def examples(spark, points):
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(*points))]
    rows += [(900, None, [0.0] * 4), (901, 1, None)]
    return spark.createDataFrame(rows, "article_id long, label int, features array<double>").repartition(3).cache()


def test_grid_equals_spark_ml(examples):
    grid, labels = M.solve_grid(examples, penalties=[0.0, 0.01, 1.0], folds=3, repeats=2, tolerance=1e-7, max_iter=500)
    assert labels == [0, 1, 2] and len(grid.models) == 18 and grid.residual.max() <= 1e-7
    assert grid.confusion().sum() == 3 * 2 * 240
    rows = examples.where("label is not null and features is not null")
    placed = M.stratified_folds(rows, folds=3, repeat=1).withColumn("features", array_to_vector("features"))
    train = placed.where("fold <> 2")
    model = M.fit(M.logistic(train.count(), c=0.01, max_iter=500), train)
    own = grid.points[grid.models.index((0.01, 1, 2))].reshape(3, 5)
    twin = model.stages[-1].coefficientMatrix.toArray()
    # Spark ML divides by the sample deviation, this by the population's; the constant feature has no weight.
    n = train.count()
    assert np.abs(own[:, :3] - twin[:, :3]).max() < 0.02 * np.abs(twin).max() + 2 / n
    assert np.abs(own[:, 3]).max() < 1e-9
    want = model.transform(placed.where("fold = 2")).groupBy("label", "prediction").count().collect()
    counts = grid.confusion()[grid.models.index((0.01, 1, 2))]
    wrong = sum(abs(counts[r[0], int(r[1])] - r[2]) for r in want)
    assert wrong <= 4


def test_grid_gradient_is_the_slope_of_the_loss(examples):
    grid, _ = M.solve_grid(examples, penalties=[0.1], folds=2, repeats=1, max_iter=1)
    rng = np.random.default_rng(0)
    at, step = rng.normal(0, 0.3, grid.points.shape), 1e-5
    every = np.arange(2)
    loss, gradient = grid.evaluate(every, at)
    for _ in range(3):
        way = rng.normal(0, 1, at.shape)
        up, _ = grid.evaluate(every, at + step * way)
        down, _ = grid.evaluate(every, at - step * way)
        assert np.allclose((up - down) / (2 * step), (gradient * way).sum(axis=1), atol=1e-6)


def test_optimality_rows(spark, examples):
    grid, _ = M.solve_grid(examples, penalties=[0.0, 1.0], folds=2, repeats=2)
    rows = {r["penalty"]: r for r in M.grid_optimality(grid, spark).collect()}
    assert set(rows) == {0.0, 1.0} and all((r["fits"], r["solved"], r["rows_scored"]) == (4, 4, 480) for r in rows.values())


def plain_boosting(x, y, edges, rounds, depth, step):
    """The same trees grown row by row: no histograms, no batches."""
    k, n = 3, len(y)
    bins = boosting.cut(x, edges)
    scores = np.tile(np.log(np.bincount(y, minlength=k) / n), (n, 1))
    for _ in range(rounds):
        g = np.eye(k)[y] - boosting.softmax(scores)
        whole, curve = np.round(g * 2**20), np.round(np.abs(g) * (1 - np.abs(g)) * 2**20)
        new = scores.copy()
        for c in range(k):
            groups = [np.arange(n)]
            for _ in range(depth):
                split = []
                for rows in groups:
                    best, sides = 0.0, (rows, rows[:0])
                    for j in range(x.shape[1]):
                        for b in range(max(len(e) for e in edges)):
                            left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                            if len(left) and len(right):
                                a = len(right) * whole[left, c].sum() - len(left) * whole[right, c].sum()
                                gain = a**2 / (float(len(left)) * len(right) * len(rows))
                                if gain > best:
                                    best, sides = gain, (left, right)
                    split += sides
                groups = split
            for rows in groups:
                if len(rows) and curve[rows, c].sum() > 0:
                    new[rows, c] += step * (k - 1) / k * whole[rows, c].sum() / curve[rows, c].sum()
        scores = new
    return scores


def test_boosting_equals_plain_twin(examples, points):
    x, y = points
    model = boosting.fit_boosting(examples, trees=3, depth=2, bins=8)
    assert np.allclose(model.raw_scores(x), plain_boosting(x, y, model.edges, 3, 2, 0.1), atol=1e-9)
    assert (model.n_rows, model.depth, len(model.losses)) == (240, 2, 4) and model.losses == sorted(model.losses, reverse=True)
    probability = boosting.softmax(model.raw_scores(x))
    assert np.isclose(model.losses[-1], -np.log(probability[np.arange(240), y]).mean())
    other = boosting.fit_boosting(examples.repartition(5), trees=3, depth=2, bins=8)
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(model.rounds, other.rounds))


def test_boosting_past_a_refresh(examples, points, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    model = boosting.fit_boosting(examples, trees=3, depth=1, bins=4)
    x, y = points
    assert np.allclose(model.raw_scores(x), plain_boosting(x, y, model.edges, 3, 1, 0.1), atol=1e-9)
    scored = model.transform(examples.where("features is not null and label is not null")).collect()
    assert all(r["prediction"] == int(np.argmax(r["probability"])) for r in scored)
    with pytest.raises(ValueError):
        boosting.fit_boosting(examples.where("label is null"))


def test_kernel_machine_equals_exact_kernel(examples, points):
    x, y = points
    model = kernels.fit_kernel_machine(examples, landmarks=240)
    assert model.residual.max() < 1e-8 and model.pairs == [(0, 1), (0, 2), (1, 2)]
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    gram = np.exp(-0.25 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    weight = 240 / (3 * np.bincount(y))
    for p, (a, b) in enumerate(model.pairs):
        at = np.flatnonzero((y == a) | (y == b))
        side, s, inner = np.where(y[at] == a, 1.0, -1.0), weight[y[at]], gram[np.ix_(at, at)]
        live, dual, shift = np.ones(len(at), bool), np.zeros(len(at)), 0.0
        for _ in range(50):  # the dual's conditions on the rows inside the margin
            m = live.sum()
            left = np.block([[inner[np.ix_(live, live)] + np.diag(1 / (2 * s[live])), np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
            found = np.linalg.solve(left, np.append(side[live], 0.0))
            dual = np.zeros(len(at))
            dual[live], shift = found[:-1], found[-1]
            again = side * (inner @ dual + shift) < 1
            if (again == live).all():
                break
            live = again
        own = model.features(x[at]) @ model.weights[p]
        assert np.abs(own - (inner @ dual + shift)).max() < 1e-3
    rows = examples.where("label is not null and features is not null")
    assert M.accuracy(M.confusion_counts(model.transform(rows))).first()["accuracy"] > 0.6


def test_kernel_machine_odd_tables(spark, examples):
    with pytest.raises(ValueError):
        kernels.fit_kernel_machine(examples.where("label = 1"))
    few = kernels.fit_kernel_machine(examples, landmarks=10)
    assert few.weights.shape[1] <= 11 and few.optimality(spark).agg(F.sum("rows")).first()[0] == 480
