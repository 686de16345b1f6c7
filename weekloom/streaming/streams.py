"""The same work on arriving data, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekloom.operators.topics import predict_topics
from weekloom.sources.publish import merge_published

# Spark counts windows from 1970-01-01, a Thursday; four days later is a Monday.
WEEK, MONDAY = "7 days", "4 days"


def first_copies(
    items: DataFrame, *, link_col: str = "link", ts_col: str = "published_at", delay: str = "1 day"
) -> DataFrame:
    """First copy of every link; later copies are dropped while its state is kept, that is
    until the watermark passes its time plus ``delay``."""
    timed = items.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return timed.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([link_col])


def closed_week_counts(
    rows: DataFrame, by: list[str], *, ts_col: str = "ts", delay: str | None = "1 day"
) -> DataFrame:
    """Rows per Monday week and ``by``; in append mode a week comes out once the watermark
    has passed its end, and rows later than that are dropped.

    ``delay=None`` if the input has a watermark already.
    """
    timed = rows if delay is None else rows.withColumn(
        ts_col, F.col(ts_col).cast("timestamp")
    ).withWatermark(ts_col, delay)
    return (
        timed.groupBy(F.window(ts_col, WEEK, startTime=MONDAY).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(
            *by,
            F.to_date("w.start").alias("week_start"),
            F.date_sub(F.to_date("w.end"), 1).alias("week_end"),
            "cnt",
        )
    )


def score_topics(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Topic and probability of arriving rows; the model works row by row."""
    return predict_topics(model, rows, keep)


def labels_with_pairs(
    pairs: DataFrame,
    labels: DataFrame,
    *,
    pair_ts: str = "published_at",
    label_ts: str = "labelled_at",
    within: str = "30 days",
    delay: str = "1 day",
) -> DataFrame:
    """Labels met with (article, entity) pairs, whichever arrives first.

    Both are streams with (article_id, entity_id) and a time. A label meets its pair if
    their times lie at most ``within`` apart; the row comes out at once, with ``kind``
    "label". A label whose pair does not come is an "orphan", a pair without a label "open";
    these come out when the watermarks of both streams have passed what could still meet
    them, so the state of either side is bounded by ``within`` and ``delay``.
    """
    left = pairs.withColumn("_pair_at", F.col(pair_ts).cast("timestamp")).withWatermark("_pair_at", delay)
    right = labels.select(
        F.col("article_id").alias("_article"),
        F.col("entity_id").alias("_entity"),
        "topic",
        F.col(label_ts).cast("timestamp").alias("_label_at"),
    ).withWatermark("_label_at", delay)
    met = left.join(
        right,
        F.expr(
            "article_id = _article and entity_id = _entity"
            f" and _label_at >= _pair_at - interval {within} and _label_at <= _pair_at + interval {within}"
        ),
        "full_outer",
    )
    kind = F.when(F.col("article_id").isNull(), "orphan").when(F.col("_article").isNull(), "open").otherwise("label")
    return met.select(
        F.coalesce("article_id", "_article").alias("article_id"),
        F.coalesce("entity_id", "_entity").alias("entity_id"),
        "topic",
        kind.alias("kind"),
    )


def merge_stream(
    rows: DataFrame,
    base: str,
    table: str,
    keys: list[str],
    update_cols: list[str],
    *,
    checkpoint: str,
    order_col: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Merge every micro-batch into a published table, as the batch merge would.

    Keep weekly tables by weeks (``publish_weeks``), so that a batch rewrites only the
    weeks it touches. The merge gives the same table if a batch is run again after a
    failure. ``trigger`` is that of ``writeStream``; without it, what is there now is
    processed.
    """

    def apply(batch: DataFrame, _: int) -> None:
        new = prepare(batch) if prepare else batch
        merge_published(batch.sparkSession, base, table, new, keys, update_cols, order_col=order_col)

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_to_parquet(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> None:
    """Write into Parquet files until the query ends: without another ``trigger``, when
    all that is there now is processed."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
