"""Landed feed files and pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RSS_ITEM = "title string, description string, link string, pubDate string, category array<string>"


def _items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "title",
        F.col("description").alias("summary"),
        "link",
        F.col("pubDate").alias("published"),
        F.col("category").alias("tags"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files (title, summary, link, published, tags)."""
    return _items(spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path))


def stream_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same items from a folder that feed files keep arriving in."""
    return _items(
        spark.readStream.format("xml")
        .option("rowTag", "item")
        .option("maxFilesPerTrigger", files_per_batch)
        .schema(RSS_ITEM)
        .load(path)
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages (url, html)."""
    return spark.read.parquet(path).select("url", "html")
