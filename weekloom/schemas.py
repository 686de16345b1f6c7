"""Declared schemas of the stored tables and of the rows in flight."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


INT, LONG, STR, DATE = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()
NTZ, DOUBLE = T.TimestampNTZType(), T.DoubleType()

OUTLETS = _struct(("id", INT, False), ("name", STR))
AUTHORS = _struct(("id", LONG, False), ("name", STR, False))
TEAMS = _struct(("id", INT, False), ("name", STR))
ARTICLES = _struct(
    ("id", LONG, False),
    ("link", STR, False),
    ("title", STR),
    ("summary", STR),
    ("publication_date", NTZ),
    ("outlet_id", INT),
    ("author_id", LONG),
    ("full_text", STR),
)
ARTICLE_TEAMS = _struct(("article_id", LONG, False), ("team_id", INT, False))
WEEKLY_TOPIC = _struct(
    ("team_id", INT, False),
    ("week_start", DATE, False),
    ("week_end", DATE, False),
    ("article_id", LONG, False),
    ("cluster_id", INT),
    ("topic_id", INT),
    ("topic_probability", DOUBLE),
)
WEEKLY_CLUSTERS = _struct(
    ("team_id", INT, False),
    ("week_start", DATE, False),
    ("week_end", DATE, False),
    ("cluster_id", INT, False),
    ("size", LONG),
)
WEEKLY_KEYWORDS = _struct(
    ("team_id", INT, False),
    ("week_start", DATE, False),
    ("week_end", DATE, False),
    ("cluster_id", INT, False),
    ("keyword", STR, False),
    ("score", DOUBLE, False),
)

FEED_ITEM = _struct(
    ("title", STR),
    ("summary", STR),
    ("link", STR),
    ("published", STR),
    ("tags", T.ArrayType(STR)),
)
SCRAPED = _struct(
    ("title", STR),
    ("summary", STR),
    ("link", STR),
    ("published_at", NTZ),
    ("author", STR),
    ("teams", T.ArrayType(STR)),
    ("article", STR),
    ("outlet", STR),
)
LEXICON = _struct(("entity_id", INT), ("ord", INT), ("name", STR), ("pattern", STR))

CLUSTER_KEY = ["team_id", "week_start", "week_end", "cluster_id"]
WEEK_KEY = ["team_id", "week_start", "week_end"]
