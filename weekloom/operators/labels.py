"""Manual topic labels: matching them to stored rows and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.backlog import ROW_KEY, article_weeks
from weekloom.operators.merge import merge_preview

LABEL_KEY = ["article_id", "entity_id"]


def label_updates(
    articles: DataFrame, article_entities: DataFrame, labels: DataFrame
) -> DataFrame:
    """Labels whose (article, entity) pair exists, as weekly topic rows of probability 1."""
    extra = [c for c in ("row_no",) if c in labels.columns]
    matched = article_weeks(articles, article_entities).join(
        labels.select(*LABEL_KEY, F.col("topic").alias("topic_id"), *extra), LABEL_KEY
    )
    return matched.where(F.col("week_start").isNotNull()).select(
        *ROW_KEY, "topic_id", F.lit(1.0).alias("topic_probability"), *extra
    )


def label_orphans(article_entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct labelled pairs that do not exist in the bridge table."""
    return (
        labels.select(*LABEL_KEY)
        .distinct()
        .join(article_entities.select(*LABEL_KEY), LABEL_KEY, "left_anti")
    )


def merge_labels(
    weekly_topic: DataFrame, updates: DataFrame, *, dry_run: bool = True
) -> DataFrame:
    """The merged table, or on a dry run its rows with the ``_action`` each would get.

    Cluster columns are left alone. If labels repeat a pair, the last one counts.
    """
    order = "row_no" if "row_no" in updates.columns else None
    preview = merge_preview(
        weekly_topic, updates, ROW_KEY, ["topic_id", "topic_probability"], order_col=order
    )
    return preview if dry_run else preview.drop("_action")


def preview_rows(preview: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows per action, first ``n`` rows that would be written)."""
    counts = preview.groupBy("_action").agg(F.count(F.lit(1)).alias("n"))
    return counts, preview.where(F.col("_action") != "same").orderBy(*ROW_KEY).limit(n)
