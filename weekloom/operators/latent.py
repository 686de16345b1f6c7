"""Dense text vectors by a randomised singular value decomposition of the TF-IDF matrix.

The matrix is never built: each scan adds up X'(X W) for a thin block W over all rows, so a
task holds a block of rows and one thin sum, and the driver one thin sum, whatever the number
of texts. Every text gets a vector of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.words import tokens
from weekloom.operators.solvers import summed
from weekloom.session import stored


def hashed_words(text: Column, buckets: int) -> Column:
    """Each word's bucket, in order; a null text has none."""
    hashed = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return F.coalesce(hashed, F.array().cast("array<int>"))


def _rows(lists: pa.Array, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length; a text without weighted words is a row of zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    counts = np.bincount(owner * len(idf) + flat, minlength=len(lists) * len(idf))
    x = counts.reshape(len(lists), len(idf)) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


@dataclass(frozen=True)
class LatentEncoder:
    """``idf`` weighs the buckets; ``components`` are orthonormal columns, strongest first, with
    their singular ``values``."""

    idf: np.ndarray
    components: np.ndarray
    values: np.ndarray

    def embed(self, df: DataFrame, *, text_col: str = "full_text", out_col: str = "embedding") -> DataFrame:
        """Add the text's vector, of unit length; zeros for a text without known words."""
        idf, components = self.idf, self.components

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for lists in batches:
                out: list[np.ndarray] = []
                for at in range(0, len(lists), 512):
                    part = pa.array([np.asarray(x, np.int32) for x in lists.iloc[at : at + 512]], pa.list_(pa.int32()))
                    y = _rows(part, idf) @ components
                    length = np.sqrt((y * y).sum(1, keepdims=True))
                    out.extend(np.divide(y, length, out=np.zeros_like(y), where=length > 1e-12))
                yield pd.Series(out, dtype=object)

        return df.withColumn(out_col, project(hashed_words(F.col(text_col), len(idf))))


def fit_encoder(
    df: DataFrame,
    *,
    text_col: str = "full_text",
    dim: int = 64,
    buckets: int = 1 << 12,
    oversample: int = 16,
    rounds: int = 3,
    seed: int = 42,
) -> LatentEncoder:
    """The ``dim`` strongest directions of the TF-IDF matrix of all texts.

    Words are hashed into ``buckets``. ``rounds`` + 2 scans over the hashed words, which are
    written once; more rounds bring directions of close strength apart. An empty table gives
    an encoder whose vectors are zeros.
    """
    rows = stored(df.select(hashed_words(F.col(text_col), buckets).alias("words")), "hashed-words")
    seen = rows.select(F.explode(F.array_distinct("words")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    df_of = np.zeros(buckets)
    for r in seen.collect():  # a row per bucket at most
        df_of[r["bucket"]] = r["n"]
    idf = np.where(df_of > 0, np.log((1 + rows.count()) / (1 + df_of)) + 1, 0.0)
    width = min(dim + oversample, buckets)
    block = np.random.default_rng(seed).normal(size=(buckets, width))
    for _ in range(rounds + 1):
        start = block

        def stretched(batch: pa.RecordBatch) -> np.ndarray:
            x = _rows(batch.column("words"), idf)
            return (x.T @ (x @ start)).ravel()

        total = summed(rows, stretched)
        if not total.any():
            return LatentEncoder(idf, np.zeros((buckets, dim)), np.zeros(dim))
        block = np.linalg.qr(total.reshape(buckets, width))[0]

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        y = _rows(batch.column("words"), idf) @ block
        return (y.T @ y).ravel()

    squares, turn = np.linalg.eigh(summed(rows, gram).reshape(width, width))
    squares, turn = squares[::-1][:dim], turn[:, ::-1][:, :dim]
    components = block @ turn
    strongest = np.abs(components).argmax(0)
    components = components * np.sign(components[strongest, np.arange(components.shape[1])])
    return LatentEncoder(idf, components, np.sqrt(np.maximum(squares, 0)))
