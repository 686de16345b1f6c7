"""Weekly read models. Each covers every entity and week unless a filter is given.

Tables: ``weekly_topic`` (entity_id, week_start, article_id, cluster_id, topic_id),
``weekly_clusters`` and ``weekly_keywords`` (entity_id, week_start, cluster_id, ...),
``articles``, ``outlets`` (id, name) and ``entities`` (id, name).
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekloom import vocab
from weekloom.functions.words import code_name, keyword_names
from weekloom.functions.weeks import week_start
from weekloom.operators.keywords import keyword_string

WEEK = ["entity_id", "week_start"]
STORYLINE = ["entity_id", "week_start", "cluster_id"]


def only(df: DataFrame, entity_id: int | None, day: str | datetime.date | None) -> DataFrame:
    """Restrict to one entity and to the week that holds a day."""
    if entity_id is not None:
        df = df.where(F.col("entity_id") == entity_id)
    if day is not None:
        df = df.where(F.col("week_start") == week_start(F.lit(str(day)).cast("date")))
    return df


def topic_filter(df: DataFrame, names: list[str], topics: dict[int, str] = vocab.TOPICS) -> DataFrame:
    """Rows of the named topics; no names, no filter; unknown names match nothing."""
    if not names:
        return df
    wanted = [code for code, name in topics.items() if name in names]
    return df.where(F.col("topic_id").isin(wanted))


def keyword_strings(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, digits: int = 6
) -> DataFrame:
    """Keyword string of every stored cluster; keywords without a cluster do not count."""
    stored = only(t["weekly_keywords"], entity_id, day)
    clusters = only(t["weekly_clusters"], entity_id, day).select(*STORYLINE)
    known = stored.join(clusters, STORYLINE, "left_semi").join(
        t["entities"].select(F.col("id").alias("entity_id")), "entity_id", "left_semi"
    )
    return keyword_string(known, STORYLINE, digits=digits)


def week_articles(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, topics: list[str] = ()
) -> DataFrame:
    """Rows of weekly_topic with article and outlet; full texts are never read."""
    rows = topic_filter(only(t["weekly_topic"], entity_id, day), list(topics))
    return (
        rows.select(*STORYLINE, "article_id", "topic_id")
        .join(t["entities"].select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        .join(t["articles"].select("article_id", "link", "title", "publication_date", "outlet_id"), "article_id")
        .join(
            t["outlets"].select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet")),
            "outlet_id",
        )
        .withColumn("publication_date", F.to_date("publication_date"))
        .drop("outlet_id")
    )


def week_table(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, topics: list[str] = ()
) -> DataFrame:
    """All articles of a week with their storyline's keywords."""
    rows = week_articles(t, entity_id, day, topics)
    strings = keyword_strings(t, entity_id, day)
    return (
        rows.join(strings, STORYLINE, "left")
        .withColumn("keyword_list", keyword_names(F.col("keywords")))
        .select(
            *STORYLINE, "article_id", F.col("topic_id").alias("topic"), "link", "title",
            "publication_date", "outlet", "keywords", "keyword_list",
        )
    )


def lowest_mode(col: str) -> Column:
    """Most frequent value, the smallest on a tie, NULLs not counted."""
    return F.mode(F.col(col), deterministic=True)


def week_metrics(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, topics: list[str] = ()
) -> DataFrame:
    """Articles, storylines and dominant topic per entity and week."""
    rows = week_articles(t, entity_id, day, topics)
    # Articles are counted per storyline and topic first, so the distinct count and the
    # mode of a hot week work on few rows.
    few = rows.groupBy(*STORYLINE, "topic_id").agg(F.count(F.lit(1)).alias("n"))
    per_topic = few.groupBy(*WEEK, "topic_id").agg(F.sum("n").alias("n"))
    top = per_topic.where(F.col("topic_id").isNotNull()).groupBy(*WEEK).agg(
        F.max_by("topic_id", F.struct(F.col("n"), -F.col("topic_id"))).alias("dominant_topic_id")
    )
    counts = few.groupBy(*WEEK).agg(
        F.sum("n").alias("n_articles"), F.count_distinct("cluster_id").alias("n_storylines")
    )
    return counts.join(top, WEEK, "left").withColumn(
        "dominant_topic", code_name(F.col("dominant_topic_id"), vocab.TOPICS, "N/A")
    )


def topic_overview(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, topics: list[str] = ()
) -> DataFrame:
    """Articles per topic name, entity and week; ``topic_id`` gives the display order."""
    rows = week_articles(t, entity_id, day, topics)
    return (
        rows.withColumn("topic", code_name(F.col("topic_id"), vocab.TOPICS, None))
        .where(F.col("topic").isNotNull())
        .groupBy(*WEEK, "topic_id", "topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def topic_trend(
    t: dict[str, DataFrame],
    entity_id: int | None = None,
    *,
    start: str = vocab.TREND_FIRST_DAY,
    end: str | None = None,
    last_n: int = 12,
) -> DataFrame:
    """Share of each topic in its week, for the last ``last_n`` recorded weeks.

    Rows without a topic count towards the week and form their own line. The windows run
    over counts, not articles: a few rows per week.
    """
    rows = only(t["weekly_topic"], entity_id, None).where(F.col("week_start") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("week_start") <= F.lit(end).cast("date"))
    counts = (
        rows.join(t["entities"].select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        .groupBy(*WEEK, "topic_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    total = F.sum("cnt").over(Window.partitionBy(*WEEK))
    recent = F.dense_rank().over(Window.partitionBy("entity_id").orderBy(F.desc("week_start")))
    return (
        counts.withColumn("total", total)
        .withColumn("_recent", recent)
        .where(F.col("_recent") <= last_n)
        .select(
            *WEEK,
            "topic_id",
            code_name(F.col("topic_id"), vocab.TOPICS, None).alias("topic"),
            "cnt",
            "total",
            (F.col("cnt") / F.col("total") * 100).alias("pct"),
        )
    )


def storyline_cards(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, topics: list[str] = ()
) -> DataFrame:
    """Per storyline: number, size, main topic and latest article (by date, then id)."""
    rows = week_articles(t, entity_id, day, topics).where(F.col("cluster_id").isNotNull())
    latest = F.struct(F.col("publication_date"), -F.col("article_id"))
    return (
        rows.groupBy(*STORYLINE)
        .agg(
            F.count(F.lit(1)).alias("n_articles"),
            lowest_mode("topic_id").alias("topic_id"),
            F.max_by(F.struct("article_id", "title", "link", "outlet", "publication_date"), latest).alias("top"),
        )
        .select(
            *STORYLINE,
            (F.col("cluster_id") + 1).alias("storyline_no"),
            "n_articles",
            "topic_id",
            code_name(F.col("topic_id"), vocab.TOPICS).alias("topic"),
            F.col("top.article_id").alias("article_id"),
            F.col("top.title").alias("title"),
            F.col("top.link").alias("link"),
            F.col("top.outlet").alias("outlet"),
            F.col("top.publication_date").alias("publication_date"),
        )
    )


def storyline_articles(
    t: dict[str, DataFrame], entity_id: int | None = None, day=None, topics: list[str] = ()
) -> DataFrame:
    """All articles of every storyline, newest first inside each; a global sort, so no
    storyline has to fit one task."""
    rows = week_articles(t, entity_id, day, topics).where(F.col("cluster_id").isNotNull())
    return rows.orderBy(*STORYLINE, F.desc("publication_date"), "article_id")


def keyword_chips(keywords: DataFrame, *, head: int = 5, dedupe: bool = False) -> DataFrame:
    """Keywords shown for a storyline, with their strength.

    The best ``head`` by score and ``head`` more from the middle of the list; with fewer
    than ``2 * head`` keywords the two parts overlap, and ``dedupe`` shows a keyword once.
    Scores are scaled to 0.4..1 within the storyline (0.7 if all are equal).

    ``keywords`` has (entity_id, week_start, cluster_id, keyword, score): a storyline's
    stored keywords, a short list.
    """
    story = Window.partitionBy(*STORYLINE)
    ranked = (
        keywords.withColumn("keyword", F.trim("keyword"))
        .groupBy(*STORYLINE, "keyword")
        .agg(F.max(F.abs("score")).alias("score"))
        .withColumn("_r", F.row_number().over(story.orderBy(F.desc("score"), "keyword")) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(story))
    )
    r, n = F.col("_r"), F.col("_n")
    mid = F.floor(n / 2)
    first = F.when(r < head, r + 1)
    second = F.when((r >= mid) & (r < mid + head), F.least(n, F.lit(head)) + r - mid + 1)
    slots = F.array_compact(F.array(first.cast("int"), second.cast("int")))
    if dedupe:
        slots = F.slice(slots, 1, 1)
    shown = ranked.select(*STORYLINE, "keyword", "score", F.explode(slots).alias("slot"))
    low, high = F.min("score").over(story), F.max("score").over(story)
    norm = F.when(high == low, F.lit(0.7)).otherwise(
        (F.col("score") - low) / (high - low) * 0.6 + 0.4
    )
    return shown.withColumn("norm", norm).select(
        *STORYLINE,
        "slot",
        "keyword",
        "score",
        "norm",
        F.floor(12 + F.lit(6) * F.col("norm")).cast("int").alias("font_size"),
        F.floor(20 + F.lit(60) * F.col("norm")).cast("int").alias("bar_width"),
    )


def export_columns(table: DataFrame) -> DataFrame:
    """A week table ready for CSV: no array columns."""
    return table.drop("keyword_list")
