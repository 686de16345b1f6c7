"""Exact top-k search by distributed histogram selection.

Vectors and queries meet in cells of a grid (a block of vectors, a block of queries), each
bounded in size. A pass scores every cell and counts scores in bins of each query's current
interval; the bin with the k-th highest score becomes the next interval, until it is one
integer wide. A last pass keeps what lies above the k-th score, and of the ties at it the
smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import table, written

BINS = 256
VECTORS_IN_CELL = 8192
QUERIES_IN_CELL = 1024
CHUNK = 128


def integer_vectors(df: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id`` and ``vec`` = floor(scale * x) for each component; unusable vectors go.

    Unusable are null and empty vectors, and those with a null or non-finite component; so
    are rows without a vec_id.
    """
    values = F.col("embedding")
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & (F.size(values) > 0) & finite
    floors = F.transform(values, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("vec"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, queries in rows; in floating point only while that is exact."""
    bound = int(np.abs(vectors).max()) * int(np.abs(queries).max()) * vectors.shape[1]
    if bound < 1 << 23:
        return (queries.astype(np.float32) @ vectors.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 52:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _chunks(left: pa.Table, right: pa.Table):
    """Scores of one cell, some queries at a time; a query's own row is masked out."""
    if not left.num_rows or not right.num_rows:
        return
    ids, vectors = left["vec_id"].to_numpy(), _matrix(left["vec"])
    numbers, own, queries = right["query"].to_numpy(), right["query_id"].to_numpy(), _matrix(right["vec"])
    state = [right[c].to_numpy() for c in ("low", "high", "need")]
    for at in range(0, len(numbers), CHUNK):
        part = slice(at, at + CHUNK)
        yield ids, numbers[part], own[part], _scores(vectors, queries[part]), ids[None, :] != own[part, None], [s[part] for s in state]


def _bin_width(low, high):
    return np.maximum(1, -(-(high - low) // BINS))


def _count(left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts by bin from the top, down to the bin with this cell's own ``need``-th score:
    the k-th score over all cells cannot lie below that."""
    out = []
    for _, numbers, _, scores, other, (low, high, need) in _chunks(left, right):
        width = _bin_width(low, high)
        inside = other & (scores >= low[:, None]) & (scores < high[:, None])
        row, col = np.nonzero(inside)
        bins = (scores[row, col] - low[row]) // width[row]
        counts = np.bincount(row * BINS + bins, minlength=len(numbers) * BINS).reshape(-1, BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, col = np.nonzero((counts > 0) & (above < need[:, None]))
        out.append(np.stack([numbers[row], col, counts[row, col]]))
    columns = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "bin", "n"), columns)})


def _take(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows above the k-th score (``low``), and of those at it the ``need`` smallest ids."""
    out = []
    for ids, numbers, own, scores, other, (low, _, need) in _chunks(left, right):
        row, col = np.nonzero(other & (scores > low[:, None]))
        tied, tie_col = np.nonzero(other & (scores == low[:, None]))
        order = np.lexsort((ids[tie_col], tied))
        tied, tie_col = tied[order], tie_col[order]
        nth = np.arange(len(tied)) - np.searchsorted(tied, tied)
        keep = nth < need[tied]
        row, col = np.append(row, tied[keep]), np.append(col, tie_col[keep])
        out.append(np.stack([numbers[row], own[row], ids[col], scores[row, col]]))
    columns = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "query_id", "vec_id", "score"), columns)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best of ``vectors(vec_id, vec)`` for each row of ``queries(vec_id, vec)``.

    Scores are integer inner products, which must fit in 64 bits. Returns query_id, rank
    (from 1), vec_id, score; equal scores go to the smaller vec_id. A query never meets
    vectors with its own id, nor such of another dimension. Repeated query rows count once,
    repeated vectors as often as they come. Empty tables give no rows.
    """
    kept = lambda df: df.select(F.col("vec_id"), F.col("vec"), F.size("vec").alias("dim"))
    vectors = written(kept(vectors), "vectors")
    queries = kept(queries).dropDuplicates(["vec_id", "vec"])
    queries = written(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v, q = (df.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first() for df in (vectors, queries))
    schema = "query_id long, rank int, vec_id long, score long"
    if not v["n"] or not q["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    bound = math.isqrt(math.ceil(v["norm"] * q["norm"])) + 2  # no inner product is larger
    rows, columns = -(-v["n"] // VECTORS_IN_CELL), -(-q["n"] // QUERIES_IN_CELL)

    def each(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    # Any even deal will do: cells are of bounded size whatever the ids or copies are.
    dealt = vectors.withColumn("down", (F.monotonically_increasing_id() % rows).cast("int"))
    left = written(dealt, "dealt-vectors").select("*", each(columns, "across")).groupBy("dim", "down", "across")
    across = (F.col("query") % columns).cast("int")

    def cells(state: DataFrame):
        right = queries.withColumnRenamed("vec_id", "query_id").join(state, "query").withColumn("across", across)
        return left.cogroup(right.select("*", each(rows, "down")).groupBy("dim", "down", "across"))

    state = queries.select("query", F.lit(-bound).cast("long").alias("low"), F.lit(bound + 1).cast("long").alias("high"), F.lit(k).cast("long").alias("need"))
    open_bins = 2 * bound + 1
    while open_bins > 1:
        counts = cells(state).applyInArrow(lambda a, b: _count(a, b), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / BINS)).cast("long")
        found = counts.withColumn("above", above).join(state, "query").filter("above < need and above + n >= need")
        found = found.select("query", (F.col("low") + F.col("bin") * width).alias("next"), width.alias("width"), (F.col("need") - F.col("above")).alias("rest"))
        # A query with fewer than k candidates keeps no bin: it takes all it has.
        nothing = F.lit(-bound - 1).cast("long")
        state = written(
            state.join(found, "query", "left").select(
                "query",
                F.coalesce("next", nothing).alias("low"),
                F.coalesce(F.col("next") + F.col("width"), nothing).alias("high"),
                F.coalesce("rest", F.lit(0)).alias("need"),
            ),
            "state",
        )
        open_bins = -(-open_bins // BINS)
    best = cells(state).applyInArrow(lambda a, b: _take(a, b), "query long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    """Every twentieth embedding against all others."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as vec from embeddings
  where vec_id is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::double), false)))
), s as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.vec::double[], v.vec::double[])::bigint as score
  from v q join v on v.vec_id <> q.vec_id and len(v.vec) = len(q.vec) where q.vec_id % 20 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
"""
