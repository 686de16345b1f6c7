"""The weekly jobs: topics for new rows, then storylines and keywords of closed weeks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.operators.backlog import ROW_KEY, cluster_backlog, split_dated, topic_backlog
from weekloom.operators.clusters import cluster_sizes, topic_features, weekly_clusters
from weekloom.operators.keywords import (
    clean_keywords,
    people_counts,
    phrase_counts,
    top_ctfidf,
)
from weekloom.operators.merge import merge
from weekloom.operators.topics import predict_topics
from weekloom.session import cut_lineage

WEEK = ["entity_id", "week_start", "week_end"]
CLUSTER = [*WEEK, "cluster_id"]


def working_tables(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored tables under the operators' column names: team_id is entity_id, and an
    article's id is article_id."""
    renames = {
        "articles": {"id": "article_id"},
        "article_teams": {"team_id": "entity_id"},
        "weekly_topic": {"team_id": "entity_id"},
        "weekly_clusters": {"team_id": "entity_id"},
        "weekly_keywords": {"team_id": "entity_id"},
    }
    out = {name: df.withColumnsRenamed(renames.get(name, {})) for name, df in stored.items()}
    if "teams" in out:
        out["entities"] = out["teams"]
    if "article_teams" in out:
        out["article_entities"] = out["article_teams"]
    return out


def label_new_rows(
    t: dict[str, DataFrame],
    model: PipelineModel,
    featurize: Callable[[DataFrame], DataFrame],
    columns: list[str] = ("full_text",),
) -> tuple[DataFrame, DataFrame]:
    """(weekly_topic with the backlog's topics merged in, undated rows left out).

    ``featurize`` adds the ``features`` vector the model was trained on. An article is
    scored once even if it belongs to several entities.
    """
    backlog = topic_backlog(t["articles"], t["article_entities"], t["weekly_topic"], [])
    dated, undated = split_dated(backlog)
    texts = t["articles"].select("article_id", *columns).join(
        dated.select("article_id").distinct(), "article_id", "left_semi"
    )
    scored = predict_topics(model, featurize(texts), ["article_id"])
    updates = dated.join(scored, "article_id")
    merged = merge(
        t["weekly_topic"], updates, ROW_KEY, ["topic_id", "topic_probability"]
    )
    return merged, undated


def cluster_keywords(
    members: DataFrame,
    lexicon: DataFrame,
    group_cols: list[str] = CLUSTER,
    *,
    stop_words: list[str] | None = None,
    top_n: int = 10,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Best general and people keywords of every cluster, cleaned up; without
    ``stop_words`` the English ones are left out."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    general = phrase_counts(members, group_cols, stop_words=stop_words)
    people = people_counts(members, group_cols, gazetteer=gazetteer)
    both = (
        top_ctfidf(general, group_cols, top_n)
        .withColumn("kind", F.lit("general"))
        .unionByName(top_ctfidf(people, group_cols, top_n).withColumn("kind", F.lit("people")))
    )
    return clean_keywords(both.select(*group_cols, "keyword", "score"), group_cols, lexicon)


def replace_weeks(table: DataFrame, rows: DataFrame, touched: DataFrame) -> DataFrame:
    """The table with the rows of the touched weeks replaced."""
    kept = table.join(touched.select(*WEEK).distinct(), WEEK, "left_anti")
    return kept.unionByName(rows.select(*table.columns))


def cluster_weeks(
    t: dict[str, DataFrame],
    vectors: DataFrame,
    lexicon: DataFrame,
    *,
    n_topics: int = 7,
    as_of: Column | None = None,
    mode: str = "rebuild_week",
    stop_words: list[str] | None = None,
    gazetteer: DataFrame | None = None,
    **kmeans,
) -> dict[str, DataFrame]:
    """New versions of weekly_topic, weekly_clusters and weekly_keywords, and the rows that
    have no vector (``unclustered``).

    ``vectors`` has (article_id, embedding) or (article_id, features) for every article.
    "rebuild_week" clusters all rows of a touched week again and replaces its clusters
    and keywords; a row without a vector loses its old number, which names no cluster any
    more. "incremental" only numbers the new rows, from 0, and merges.
    """
    rows = cluster_backlog(
        t["articles"], t["article_entities"], t["weekly_topic"], as_of=as_of, columns=[], mode=mode
    )
    vector = (
        F.col("embedding") if "embedding" in vectors.columns else vector_to_array("features")
    )
    backlog = rows.join(vectors, "article_id", "left")
    unclustered = backlog.where(vector.isNull()).select(*ROW_KEY)
    points = backlog.where(vector.isNotNull()).select(
        *WEEK, "article_id", topic_features(vector, F.col("topic_id"), n_topics).alias("features")
    )
    # Read three times below; without the cut the clustering would run three times.
    assigned = cut_lineage(weekly_clusters(points, WEEK, **kmeans))
    members = assigned.join(t["articles"].select("article_id", "full_text"), "article_id")
    sizes = cluster_sizes(assigned, CLUSTER)
    keywords = cluster_keywords(
        members, lexicon, CLUSTER, stop_words=stop_words, gazetteer=gazetteer
    )
    none = unclustered.withColumn("cluster_id", F.lit(None).cast("int"))
    numbered = assigned.unionByName(none) if mode == "rebuild_week" else assigned
    topic_rows = merge(t["weekly_topic"], numbered, ROW_KEY, ["cluster_id"])
    if mode == "incremental":
        clusters = merge(t["weekly_clusters"], sizes, CLUSTER, ["size"])
        words = merge(t["weekly_keywords"], keywords, [*CLUSTER, "keyword"], ["score"])
    else:
        clusters = replace_weeks(t["weekly_clusters"], sizes, numbered)
        words = replace_weeks(t["weekly_keywords"], keywords, numbered)
    return {
        "weekly_topic": topic_rows,
        "weekly_clusters": clusters,
        "weekly_keywords": words,
        "unclustered": unclustered,
    }
