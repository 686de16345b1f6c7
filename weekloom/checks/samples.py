"""Storyline tables derived from the given test tables, for checks and benches.

Everything here is computed from whole tables: documents stand for articles, labels for
manual topics, embeddings for text vectors, pages for article pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekloom.functions.words import tokens
from weekloom.functions.weeks import with_week
from weekloom.operators.entities import explode_hits, mention_hits
from weekloom.session import spread, stored

# A vocabulary that occurs in the test texts: (entity_id, ord, name, pattern).
LEXICON = [
    (1, 1, "Alpha", "that|with"),
    (2, 2, "Beta", "this|from"),
    (3, 3, "Gamma", "pour|dans"),
    (4, 4, "Delta", "sich|nicht"),
    (5, 5, "Epsilon", "los|una"),
    (6, 6, "Zeta", "the|and"),
]
OUTLETS = [(1, "BBC"), (2, "TheGuardian"), (3, "SkySports")]
# Patterns for single words, plain and other.
PATTERNS = ["that|with", "th(?:is|e)", "[0-9]+", "ni[ck]ht|sich", "un[ao]?", "d[ae]ns*", "los", "pour|po+r", "[a-z]{2}", "fro?m|und"]
PROMO_LINES = ["The", "En", "Nicht", "los", "the", "und", "sch"]
# Characters of text whose words one task counts before the counts are shuffled, and those
# whose counts one task adds up behind the shuffle.
PIECE_CHARS = 4_000_000
SLICE_CHARS = 16_000_000
STOP_WORDS = ["the", "and", "that", "with", "for", "this", "from", "les", "des", "und", "der", "los"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small constant table whose size the planner knows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(str(r) for r in rows)} AS t({columns})")


def lexicon(spark: SparkSession) -> DataFrame:
    return _values(spark, LEXICON, "entity_id, ord, name, pattern")


def entities(spark: SparkSession) -> DataFrame:
    return lexicon(spark).select(F.col("entity_id").alias("id"), "name")


def outlets(spark: SparkSession) -> DataFrame:
    return _values(spark, OUTLETS, "id, name")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve weeks of articles from Monday 2025-05-19."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("link"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("full_text"),
        (F.substring("source", 4, 10).cast("int") % 3 + 1).alias("outlet_id"),
        F.expr(
            "timestamp_ntz '2025-05-19 00:00:00'"
            " + make_dt_interval(0, cast(doc_id * 7919 % 2016 as int), 0, 0)"
        ).alias("publication_date"),
    )


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = mention_hits(articles(spark, sf_dir).select("article_id", "full_text"), lexicon(spark))
    return explode_hits(hits, ["article_id"])


def article_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_counts(spark, sf_dir).select("article_id", "entity_id")


def weekly_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh article has no cluster; articles without a label have no topic."""
    dated = with_week(articles(spark, sf_dir).select("article_id", "publication_date"))
    topic = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("article_id"), (F.col("quality") + 2 * F.col("toxic")).alias("topic_id")
    )
    cluster = F.when(F.col("article_id") % 7 != 0, (F.col("article_id") * 31 % 5).cast("int"))
    return (
        article_entities(spark, sf_dir)
        .join(dated, "article_id")
        .join(topic, "article_id", "left")
        .select(
            "entity_id",
            "week_start",
            "week_end",
            "article_id",
            cluster.alias("cluster_id"),
            F.col("topic_id").cast("int").alias("topic_id"),
            F.lit(None).cast("double").alias("topic_probability"),
        )
    )


def weekly_clusters(topic: DataFrame) -> DataFrame:
    return (
        topic.where("cluster_id is not null")
        .groupBy("entity_id", "week_start", "cluster_id")
        .agg(F.count(F.lit(1)).alias("size"))
    )


def weekly_keywords(spark: SparkSession, sf_dir: str, topic: DataFrame) -> DataFrame:
    """The twelve commonest words of five letters and more per cluster, some with a
    negative score."""
    key = ["entity_id", "week_start", "cluster_id"]
    # A task keeps a count of every different word by cluster until it is done, so its memory
    # goes by its text: as many pieces as the texts need, whatever the files' sizes and the
    # session's shuffle partitions, and as many slices of words for what the pieces counted.
    chars = table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    pieces, slices = (max(cores, -(-chars // size)) for size in (PIECE_CHARS, SLICE_CHARS))

    def by_piece(df: DataFrame) -> DataFrame:
        # The column tells Spark that the join and the first counts need no other shuffle.
        piece = F.pmod(F.xxhash64("article_id"), F.lit(pieces)).cast("int")
        return df.withColumn("_piece", piece).repartitionById(pieces, F.col("_piece"))

    # One row per article next to its text, so the text is neither repeated for each of its
    # entities nor counted by article first.
    places = (
        by_piece(topic.where("cluster_id is not null").select("article_id", *key))
        .groupBy("_piece", "article_id", *key)
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("_piece", "article_id")
        .agg(F.collect_list(F.struct(*key, "times")).alias("places"))
    )
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("full_text"))
    words = F.filter(tokens(F.col("full_text")), lambda w: F.length(w) >= 5)
    found = (
        by_piece(texts)
        .join(places, ["_piece", "article_id"])
        .select("_piece", "places", F.explode(words).alias("keyword"))
        .select("_piece", F.explode("places").alias("p"), "keyword")
        .select("_piece", *[F.col(f"p.{c}").alias(c) for c in key], "keyword", "p.times")
    )
    counted = found.groupBy("_piece", *key, "keyword").agg(F.sum("times").alias("times"))
    # Not by entity: an article's word is counted for its entities one after the other, and
    # rows that stay neighbours take a fifth less room in the shuffle.
    counts = (
        counted.drop("_piece")
        .repartition(slices, "week_start", "cluster_id", "keyword")
        .groupBy(*key, "keyword")
        .agg(F.sum("times").alias("cnt"))
    )
    totals = counts.groupBy(*key).agg(F.sum("cnt").alias("total"))
    best = Window.partitionBy(*key).orderBy(F.desc("cnt"), "keyword")
    sign = F.when(F.length("keyword") % 5 == 0, F.lit(-1)).otherwise(F.lit(1))
    return (
        counts.withColumn("rn", F.row_number().over(best))
        .where("rn <= 12")
        .join(totals, key)
        .select(
            *key,
            "keyword",
            (F.round(F.col("cnt").cast("double") / F.col("total").cast("double"), 6) * sign).alias("score"),
        )
    )


def storyline_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables; the rows of articles and entities are written once, the others lazy."""
    topic = stored(weekly_topic(spark, sf_dir), "weekly-topic")
    return {
        "articles": articles(spark, sf_dir),
        "article_entities": article_entities(spark, sf_dir),
        "entities": entities(spark),
        "outlets": outlets(spark),
        "weekly_topic": topic,
        "weekly_clusters": weekly_clusters(topic),
        "weekly_keywords": weekly_keywords(spark, sf_dir, topic),
    }


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, embedding, label) of the articles that have one."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), "embedding", "label"
    )
