"""Keyed merges into stored tables, with a policy per column.

One job fills topic columns and another fills cluster columns of the same table, so a
merge names the columns it may overwrite and leaves all others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.operators.ranking import digest_order


def fold_updates(
    updates: DataFrame, keys: list[str], update_cols: list[str], order_col: str | None
) -> DataFrame:
    """One row per key: ``update_cols`` of the last row, all other columns of the first.

    Plain aggregates, so the copies of a hot key are reduced before the shuffle. Without
    ``order_col`` the keys must be unique already.
    """
    if order_col is None:
        return updates
    rest = [c for c in updates.columns if c not in (*keys, *update_cols, order_col)]
    aggs: list[Column] = []
    if rest:
        aggs.append(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
    if update_cols:
        aggs.append(F.max_by(F.struct(*update_cols), F.col(order_col)).alias("_last"))
    if not aggs:
        return updates.select(*keys).distinct()
    folded = updates.groupBy(*keys).agg(*aggs)
    return folded.select(
        *keys,
        *[F.col(f"_first.{c}").alias(c) for c in rest],
        *[F.col(f"_last.{c}").alias(c) for c in update_cols],
    )


def merge_preview(
    target: DataFrame,
    updates: DataFrame,
    keys: list[str],
    update_cols: list[str] = (),
    *,
    order_col: str | None = None,
    key_collation: str | None = None,
) -> DataFrame:
    """The merged table with ``_action``: insert, update (a value changes) or same.

    Rows of ``target`` keep every column outside ``update_cols``. New keys are inserted
    with all columns of ``updates``; columns it lacks become NULL. ``key_collation``
    compares text keys under a collation such as ``UNICODE_CI_AI``.

    The target is the streamed side of a left join, so a small batch of updates is
    broadcast (if its size allows) and the target's wide rows are not shuffled; only its
    keys are read again to find the new rows.
    """
    update_cols = list(update_cols)

    def probe(col: str, schema) -> Column:
        text = schema[col].dataType.typeName().startswith("string")
        return F.collate(F.col(col), key_collation) if key_collation and text else F.col(col)

    new = fold_updates(
        updates.withColumns({f"_k{i}": probe(k, updates.schema) for i, k in enumerate(keys)}),
        [f"_k{i}" for i in range(len(keys))],
        update_cols,
        order_col,
    )
    old = target.withColumns({f"_k{i}": probe(k, target.schema) for i, k in enumerate(keys)})
    on = [f"_k{i}" for i in range(len(keys))]

    incoming = new.select(
        *on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in update_cols]
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    changed = F.lit(False)
    for c in update_cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    kept = old.join(incoming, on, "left").select(
        *[
            (F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in update_cols else F.col(c))
            .cast(target.schema[c].dataType)
            .alias(c)
            for c in target.columns
        ],
        F.when(hit & changed, "update").otherwise("same").alias("_action"),
    )
    added = new.join(old.select(*on), on, "left_anti").select(
        *[
            (F.col(c) if c in new.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c)
            for c in target.columns
        ],
        F.lit("insert").alias("_action"),
    )
    return kept.unionByName(added)


def merge(
    target: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str] = (), **options
) -> DataFrame:
    """The table after the merge; see ``merge_preview``."""
    return merge_preview(target, updates, keys, update_cols, **options).drop("_action")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows with new keys only; the first copy of a repeated key is not defined,
    so the rows should be equal apart from their keys, as bridge and dimension rows are."""
    new = rows.select(*target.columns).dropDuplicates(keys)
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))


def assign_ids(
    new: DataFrame, natural_key: str, last_id: Column | int, id_col: str = "id", digits: int = 3
) -> DataFrame:
    """Give rows with distinct new natural keys the ids after ``last_id``.

    The order is that of the key's md5, so that numbering works in slices (see
    ``ranking``) and the same keys always get the same ids.
    """
    start = F.lit(last_id) if isinstance(last_id, int) else last_id
    numbered = digest_order(new, [natural_key], digits=digits, pos_col="_pos")
    return numbered.withColumn(id_col, (start + F.col("_pos")).cast("long")).drop("_pos")


def last_id(table: DataFrame, id_col: str = "id") -> Column:
    """Highest id in use, 0 for an empty table, as a scalar subquery."""
    return table.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("last")).scalar()


def lookup_or_create(
    table: DataFrame, names: DataFrame, name_col: str = "name", key_collation: str | None = None
) -> DataFrame:
    """The (id, name) table extended by the names it lacks, each with a new id."""
    wanted = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull())
    if key_collation:
        wanted = wanted.withColumn("_key", F.collate("name", key_collation))
        known = table.select(F.collate("name", key_collation).alias("_key"))
        fresh = wanted.groupBy("_key").agg(F.min("name").alias("name"))
        fresh = fresh.join(known, "_key", "left_anti").select("name")
    else:
        fresh = wanted.distinct().join(table.select("name"), "name", "left_anti")
    return table.select("id", "name").unionByName(
        assign_ids(fresh, "name", last_id(table)).select("id", "name")
    )


def delete_cascade(child: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows left after their parents were deleted."""
    return child.join(deleted.select(*keys).distinct(), keys, "left_anti")


def delete_set_null(child: DataFrame, deleted: DataFrame, col: str, parent_key: str) -> DataFrame:
    """Child rows with ``col`` emptied where it names a deleted parent."""
    gone = deleted.select(F.col(parent_key).alias("_gone")).distinct()
    return (
        child.join(gone, child[col] == gone["_gone"], "left")
        .withColumn(col, F.when(F.col("_gone").isNull(), F.col(col)))
        .drop("_gone")
    )
