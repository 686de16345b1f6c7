"""Monday-to-Sunday week buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_start(at: Column) -> Column:
    """The Monday on or before a date or time. Date arithmetic only, so no time zone applies."""
    day = at.cast("date")
    return F.date_sub(day, F.weekday(day))


def week_end(at: Column) -> Column:
    return F.date_add(week_start(at), 6)


def with_week(df: DataFrame, ts_col: str = "publication_date") -> DataFrame:
    """Add the week's first and last day (both inclusive)."""
    return df.withColumn("week_start", week_start(F.col(ts_col))).withColumn(
        "week_end", F.date_add("week_start", 6)
    )
