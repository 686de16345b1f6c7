"""Positions in a fixed pseudo-random order, without sorting a hot group in one task.

A window over one large group runs in one task. Here every group is first split by the
leading hex digits of an md5 over the row's key; rows are numbered inside these slices,
and the number of rows in earlier slices is added. The digits spread evenly whatever the
group sizes are, so slices of a group holding a third of all rows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_digest(key_cols: list[str], salt: str = "") -> Column:
    """md5 over salt and key; the text form is ``salt|k1|k2``."""
    parts = [F.lit(salt), *[F.col(c).cast("string") for c in key_cols]]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def digest_order(
    df: DataFrame,
    key_cols: list[str],
    *,
    group_cols: list[str] = (),
    salt: str = "",
    digits: int = 3,
    pos_col: str = "pos",
    total_col: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in digest order, within its group.

    ``key_cols`` must identify a row inside its group. ``digits`` sets the number of
    slices per group, 16**digits. ``total_col`` also adds the size of the group.
    """
    group = list(group_cols)
    marked = df.withColumn("_digest", key_digest(key_cols, salt)).withColumn(
        "_slice", F.substring("_digest", 1, digits)
    )
    # At most 16**digits rows per group from here, whatever the size of the group.
    sizes = marked.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*(group or [F.lit(0)]))
    before = over.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(over).alias("_total"),
    )
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_slice").orderBy("_digest", *key_cols)
    numbered = marked.withColumn("_rn", F.row_number().over(inside)).join(offsets, same)
    extra = [F.col("_total").alias(total_col)] if total_col else []
    return numbered.select(
        *df.columns, (F.col("_before") + F.col("_rn")).cast("long").alias(pos_col), *extra
    )
