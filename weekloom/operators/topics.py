"""Topic classification with Spark ML: features, weights, splits, models, evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.words import NOT_WORD
from weekloom.operators.ranking import digest_order
from weekloom.operators.solvers import LogisticGrid, plain_array
from weekloom.session import stored
from weekloom.vocab import PENALTIES


# ---- features ------------------------------------------------------------------------


def text_encoder(
    text_col: str = "full_text", out_col: str = "features", buckets: int = 1 << 12
) -> Pipeline:
    """Distributed bag-of-words encoder: hashed counts, IDF, unit length."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=NOT_WORD),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets),
            IDF(inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol=out_col),
        ]
    )


def embed(
    df: DataFrame,
    *,
    text_col: str = "full_text",
    encoder: str | Pipeline | Callable = "embedding",
    out_col: str = "features",
    batch_size: int = 256,
) -> DataFrame:
    """Add a feature vector.

    ``encoder`` is the name of an array column that holds embeddings already, a Spark ML
    pipeline to fit on the texts, or a function that loads a user's model and returns a
    function from a batch of texts to a matrix (then run in batches of ``batch_size``).
    """
    if isinstance(encoder, str):
        return df.withColumn(out_col, array_to_vector(F.col(encoder).cast("array<double>")))
    if isinstance(encoder, Pipeline):
        model = encoder.fit(df)
        scratch = [s.getOutputCol() for s in encoder.getStages()[:-1]]
        return model.transform(df).drop(*scratch)
    from pyspark.sql.types import ArrayType, FloatType

    run = predict_batch_udf(encoder, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out_col, array_to_vector(run(F.col(text_col)).cast("array<double>")))


def fourier_features(
    df: DataFrame, in_col: str, out_col: str, *, n_out: int = 256, gamma: float, seed: int = 42
) -> DataFrame:
    """Random Fourier map of an RBF kernel, so that a linear model approximates it."""

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy())
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, np.sqrt(2.0 * gamma), (x.shape[1], n_out))
        shift = rng.uniform(0.0, 2.0 * np.pi, n_out)
        return pd.Series(list(np.sqrt(2.0 / n_out) * np.cos(x @ w + shift)))

    return df.withColumn(out_col, array_to_vector(project(vector_to_array(F.col(in_col)))))


# ---- weights, splits, folds ----------------------------------------------------------


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    weight = totals.select((F.col("rows") / F.col("classes")).alias("w")).scalar()
    return counts.select(label_col, "n", (weight / F.col("n")).alias("weight"))


def with_class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.join(class_weights(df, label_col).drop("n"), label_col)


def stratified_split(
    df: DataFrame,
    *,
    label_col: str = "label",
    id_col: str = "article_id",
    test_share: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Add ``part``: "test" for a share of every class, to the nearest row, else "train"."""
    placed = digest_order(
        df, [id_col], group_cols=[label_col], salt=str(seed), pos_col="_pos", total_col="_of"
    )
    take = F.floor(F.col("_of") * F.lit(test_share) + F.lit(0.5))
    part = F.when(F.col("_pos") <= take, F.lit("test")).otherwise(F.lit("train"))
    return placed.withColumn("part", part).drop("_pos", "_of")


def stratified_folds(
    df: DataFrame,
    *,
    label_col: str = "label",
    id_col: str = "article_id",
    folds: int = 5,
    repeat: int = 0,
    seed: int = 1,
) -> DataFrame:
    """Add ``fold`` (from 0); every class is spread evenly, differently on each repeat."""
    placed = digest_order(
        df, [id_col], group_cols=[label_col], salt=f"{seed}-{repeat}", pos_col="_pos"
    )
    return placed.withColumn("fold", ((F.col("_pos") - 1) % folds).cast("int")).drop("_pos")


# ---- models --------------------------------------------------------------------------


def reg_param(c: float, n: int) -> float:
    """Spark's penalty for an inverse penalty ``c`` over ``n`` rows of mean weight 1.

    Spark averages the loss over the rows where the usual C form sums it.
    """
    return 0.0 if c == 0 else 1.0 / (c * n)


def _scaler(features_col: str) -> StandardScaler:
    return StandardScaler(inputCol=features_col, outputCol="scaled", withMean=True, withStd=True)


def logistic(
    n: int, *, c: float = 1e-4, features_col: str = "features", label_col: str = "label",
    max_iter: int = 100,
) -> Pipeline:
    """Standardised features into a balanced multinomial logistic regression."""
    model = LogisticRegression(
        featuresCol="scaled",
        labelCol=label_col,
        weightCol="weight",
        family="multinomial",
        standardization=False,
        regParam=reg_param(c, n),
        elasticNetParam=0.0,
        maxIter=max_iter,
    )
    return Pipeline(stages=[_scaler(features_col), model])


def support_vectors(
    *, features_col: str = "features", label_col: str = "label", reg: float = 0.01,
    max_iter: int = 50, parallelism: int = 4,
) -> Pipeline:
    """Balanced one-against-rest linear SVM on standardised features."""
    svm = LinearSVC(regParam=reg, maxIter=max_iter, standardization=False)
    rest = OneVsRest(
        classifier=svm,
        featuresCol="scaled",
        labelCol=label_col,
        weightCol="weight",
        parallelism=parallelism,
    )
    return Pipeline(stages=[_scaler(features_col), rest])


def boosting(
    *, features_col: str = "features", label_col: str = "label", trees: int = 100, depth: int = 3,
    step: float = 0.1, seed: int = 42, parallelism: int = 4,
) -> Pipeline:
    """One-against-rest gradient-boosted trees."""
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    rest = OneVsRest(
        classifier=gbt, featuresCol=features_col, labelCol=label_col, parallelism=parallelism
    )
    return Pipeline(stages=[rest])


def fit(pipeline: Pipeline, train: DataFrame, label_col: str = "label") -> PipelineModel:
    """Fit on all given rows; rows get their class weights here."""
    rows = with_class_weights(train.withColumn(label_col, F.col(label_col).cast("double")), label_col)
    return pipeline.fit(rows)


def predict_topics(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """(kept columns, topic_id, topic_probability); every row is scored once."""
    return model.transform(rows).select(
        *keep,
        F.col("prediction").cast("int").alias("topic_id"),
        F.array_max(vector_to_array("probability")).alias("topic_probability"),
    )


# ---- evaluation ----------------------------------------------------------------------


def confusion_counts(
    preds: DataFrame, by: list[str] = (), label_col: str = "label", pred_col: str = "prediction"
) -> DataFrame:
    return preds.groupBy(
        *by, F.col(label_col).cast("int").alias("label"), F.col(pred_col).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def accuracy(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """(rows, accuracy, balanced_accuracy) out of confusion counts; the latter is the mean
    recall of the classes that occur as labels."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    recall = counts.groupBy(*by, "label").agg(
        F.sum("n").alias("of"), right.cast("double").alias("right")
    )
    return recall.groupBy(*by).agg(
        F.sum("of").alias("rows"),
        (F.sum("right") / F.sum("of")).alias("accuracy"),
        F.avg(F.col("right") / F.col("of")).alias("balanced_accuracy"),
    )


def confusion_matrix(counts: DataFrame, classes: list[int]) -> DataFrame:
    """Share of every prediction within its true class, for all pairs of classes."""
    every = F.array(*[F.lit(c) for c in classes])
    spark = counts.sparkSession
    grid = spark.range(1).select(F.explode(every).alias("label")).select(
        "label", F.explode(every).alias("prediction")
    )
    totals = counts.groupBy("label").agg(F.sum("n").alias("of"))
    return (
        grid.join(counts, ["label", "prediction"], "left")
        .join(totals, "label", "left")
        .select(
            "label",
            "prediction",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce(F.col("n") / F.col("of"), F.lit(0.0)).alias("share"),
        )
    )


def cross_val_predict(
    df: DataFrame, build: Callable[[int], Pipeline], *, folds: int = 5, repeat: int = 0, seed: int = 1,
    label_col: str = "label", id_col: str = "article_id",
) -> DataFrame:
    """Every row with the prediction of the model that did not see it."""
    rows = stratified_folds(
        df, label_col=label_col, id_col=id_col, folds=folds, repeat=repeat, seed=seed
    ).withColumn(label_col, F.col(label_col).cast("double"))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    parts = None
    for f in sorted(sizes):
        model = fit(build(total - sizes[f]), rows.where(F.col("fold") != f), label_col)
        part = model.transform(rows.where(F.col("fold") == f)).select(
            id_col, "fold", label_col, "prediction"
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def solve_grid(
    df: DataFrame,
    *,
    penalties: list[float] = PENALTIES,
    folds: int = 10,
    repeats: int = 3,
    seed: int = 1,
    label_col: str = "label",
    id_col: str = "article_id",
    features_col: str = "features",
    max_iter: int = 100,
    tolerance: float = 1e-4,
) -> tuple[LogisticGrid, list]:
    """A fitted model for every penalty, repeat and fold, and the sorted labels.

    All models read the same scans, so the number of jobs is that of the slowest fit, not the
    sum over all fits. Rows without label or features take no part.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(features_col).isNotNull())
    rows = rows.select(id_col, label_col, plain_array(df, features_col).alias("features"))
    labels = sorted(r[0] for r in rows.select(label_col).distinct().collect())
    if not labels:
        raise ValueError("no labelled rows")
    for repeat in range(repeats):
        rows = stratified_folds(
            rows, label_col=label_col, id_col=id_col, folds=folds, repeat=repeat, seed=seed
        ).withColumnRenamed("fold", f"_fold{repeat}")
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label_col)) - 1
    placed = F.array(*[F.col(f"_fold{r}") for r in range(repeats)]).alias("folds")
    table = stored(rows.select(number.cast("int").alias("label"), "features", placed), "grid-rows")
    models = [(c, r, f) for c in penalties for r in range(repeats) for f in range(folds)]
    size = table.select(F.max(F.size("features"))).first()[0]
    return LogisticGrid(table, len(labels), size, models).fit(tolerance, max_iter), labels


def evaluate_grid(
    df: DataFrame,
    *,
    penalties: list[float] = PENALTIES,
    folds: int = 10,
    repeats: int = 3,
    seed: int = 1,
    label_col: str = "label",
    id_col: str = "article_id",
    parallelism: int | None = None,
    max_iter: int = 100,
) -> DataFrame:
    """(penalty, repeat, fold, rows, accuracy, balanced_accuracy) for every fit.

    Only confusion counts come to the driver: as many rows as there are fits and pairs of
    classes. ``parallelism`` has no effect: all fits share their scans.
    """
    grid, labels = solve_grid(
        df, penalties=penalties, folds=folds, repeats=repeats, seed=seed, label_col=label_col,
        id_col=id_col, max_iter=max_iter,
    )
    counts = grid.confusion()
    found = [
        (float(grid.models[m][0]), *grid.models[m][1:], int(labels[a]), int(labels[b]), int(counts[m, a, b]))
        for m, a, b in zip(*(x.tolist() for x in np.nonzero(counts)))
    ]
    spark = df.sparkSession
    frame = spark.createDataFrame(
        found, "penalty double, repeat int, fold int, label int, prediction int, n long"
    )
    return accuracy(frame, ["penalty", "repeat", "fold"])


def grid_optimality(grid: LogisticGrid, spark: SparkSession, tolerance: float = 1e-4) -> DataFrame:
    """(penalty, fits, solved, rows_scored): how many fits end with every entry of the gradient
    within ``tolerance``, and how many rows they were scored on."""
    scored = grid.confusion().sum(axis=(1, 2))
    rows = [(float(c), int(x <= tolerance), int(n)) for (c, *_), x, n in zip(grid.models, grid.residual, scored)]
    frame = spark.createDataFrame(rows, "penalty double, solved long, n long")
    return frame.groupBy("penalty").agg(
        F.count(F.lit(1)).alias("fits"), F.sum("solved").alias("solved"), F.sum("n").alias("rows_scored")
    )


def summarize_grid(grid: DataFrame) -> DataFrame:
    """Mean and population deviation of the balanced accuracy per penalty."""
    return grid.groupBy("penalty").agg(
        F.avg("balanced_accuracy").alias("mean_score"),
        F.stddev_pop("balanced_accuracy").alias("std_score"),
        F.count(F.lit(1)).alias("fits"),
    )


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, share) over the labelled rows."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.select(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)
