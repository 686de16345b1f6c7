"""Stored tables, labelled CSV files and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions.words import name_code, safe_int


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table under its declared schema."""
    return spark.read.schema(schema).parquet(path)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    id_col: str,
    low: int,
    high: int,
    partitions: int,
    properties: dict | None = None,
) -> DataFrame:
    """A database table, read in ``partitions`` ranges of a numeric column."""
    return spark.read.jdbc(
        url,
        table,
        column=id_col,
        lowerBound=low,
        upperBound=high,
        numPartitions=partitions,
        properties=properties or {},
    )


def run_query(spark: SparkSession, query: str, args: dict | list | None = None) -> DataFrame:
    """A read query with bound parameters over registered tables."""
    return spark.sql(query, args=args)


def write_weekly(df: DataFrame, path: str) -> None:
    """A weekly table, one folder per week, so a week filter prunes files. Rebalancing keeps
    files few and still splits a week that is far larger than others."""
    df.hint("rebalance", F.col("week_start")).write.mode("overwrite").partitionBy("week_start").parquet(path)


def read_labels(
    spark: SparkSession, path: str, team_ids: dict[str, int], encoding: str = "UTF-16"
) -> DataFrame:
    """Labels (article_id, entity_id, topic, row_no) of a ``;``-separated file.

    Header names count without case and padding. The entity is given by id (``team_id``)
    or by name (``team``); rows without one are dropped. ``row_no`` keeps the file order.
    """
    raw = (
        spark.read.option("sep", ";")
        .option("header", True)
        .option("encoding", encoding)
        .option("multiLine", True)
        .csv(path)
    )
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if not {"article_id", "topic"} <= set(raw.columns):
        raise ValueError("the file must have columns Article_ID and Topic")
    if "team_id" in raw.columns:
        entity = safe_int(F.col("team_id"))
    elif "team" in raw.columns:
        entity = name_code(F.col("team"), team_ids)
    else:
        raise ValueError("the file must have a column team_id or Team")
    return raw.select(
        safe_int(F.col("article_id")).cast("long").alias("article_id"),
        entity.cast("int").alias("entity_id"),
        safe_int(F.col("topic")).alias("topic"),
        F.monotonically_increasing_id().alias("row_no"),
    ).where(F.col("entity_id").isNotNull() & F.col("article_id").isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated export with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv_utf16(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """UTF-16 export with a header; ``by`` gives one folder per value, in one pass."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("encoding", "UTF-16")
    (writer.partitionBy(*by) if by else writer).csv(path)
