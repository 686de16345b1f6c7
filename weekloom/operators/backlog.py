"""Rows of the article-entity bridge that still lack a topic or a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.weeks import with_week

ROW_KEY = ["entity_id", "week_start", "week_end", "article_id"]


def article_weeks(
    articles: DataFrame, article_entities: DataFrame, columns: list[str] = ()
) -> DataFrame:
    """Bridge rows with their week and the named article columns."""
    dated = with_week(articles.select("article_id", "publication_date", *columns))
    return article_entities.select("article_id", "entity_id").join(dated, "article_id").select(
        *ROW_KEY, *columns
    )


def topic_backlog(
    articles: DataFrame,
    article_entities: DataFrame,
    weekly_topic: DataFrame,
    columns: list[str] = ("full_text",),
) -> DataFrame:
    """Rows without a topic. Rows of undated articles stay in, with a NULL week."""
    done = weekly_topic.where(F.col("topic_id").isNotNull()).select(*ROW_KEY)
    return article_weeks(articles, article_entities, list(columns)).join(done, ROW_KEY, "left_anti")


def cluster_backlog(
    articles: DataFrame,
    article_entities: DataFrame,
    weekly_topic: DataFrame,
    *,
    as_of: Column | None = None,
    columns: list[str] = ("full_text",),
    mode: str = "rebuild_week",
) -> DataFrame:
    """Rows to cluster, with their topic: those of weeks that ended before ``as_of``.

    "incremental" returns the rows without a cluster. "rebuild_week" returns every row of
    each (entity, week) that has such a row, so that a late article does not reuse the
    number of an unrelated older cluster.
    """
    as_of = F.current_date() if as_of is None else as_of
    stored = weekly_topic.select(*ROW_KEY, "topic_id", "cluster_id")
    rows = (
        article_weeks(articles, article_entities, list(columns))
        .where(F.col("week_end") < as_of)
        .join(stored, ROW_KEY, "left")
    )
    if mode == "incremental":
        return rows.where(F.col("cluster_id").isNull()).drop("cluster_id")
    if mode != "rebuild_week":
        raise ValueError(f"mode: {mode}")
    week = ["entity_id", "week_start", "week_end"]
    # The distinct touched weeks carry no article columns: Catalyst prunes them.
    touched = rows.where(F.col("cluster_id").isNull()).select(*week).distinct()
    return rows.drop("cluster_id").join(touched, week, "left_semi")


def split_dated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a week, rows to report because their article has no date)."""
    return rows.where(F.col("week_start").isNotNull()), rows.where(F.col("week_start").isNull())
