"""The article-by-entity extract that topic labels are made on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import vocab
from weekloom.functions.words import code_name
from weekloom.operators.entities import (
    assign_entities,
    drop_frequent_term,
    explode_assigned,
    inline_lexicon,
    known_entities,
    mention_hits,
)


def training_extract(
    articles: DataFrame,
    article_entities: DataFrame,
    lexicon: DataFrame,
    *,
    outlet_names: dict[int, str],
    excluded_term: str = vocab.EXCLUDED_TRAINING_TERM,
    excluded_min: int = vocab.EXCLUDED_TRAINING_MIN,
    min_count: int = vocab.SECONDARY_ENTITY_MIN,
    on_no_match: str = "first",
) -> DataFrame:
    """(full_text, article_id, outlet, date, team, title), one row per assigned entity.

    Articles in the bridge table only; those with a missing text, outlet, date or title,
    or with the excluded term ``excluded_min`` times or more, are left out.
    """
    needed = ["article_id", "full_text", "outlet_id", "publication_date", "title"]
    usable = articles.select(*needed).dropna(subset=needed)
    usable = drop_frequent_term(usable, excluded_term, excluded_min, "full_text")
    if on_no_match == "fallback":
        usable = usable.join(known_entities(article_entities), "article_id")
    else:
        usable = usable.join(article_entities.select("article_id"), "article_id", "left_semi")
    hits = mention_hits(usable, lexicon)
    given = assign_entities(
        hits, lexicon, min_count=min_count, on_no_match=on_no_match, known_ids_col="known_ids"
    )
    rows = explode_assigned(given, needed).select(
        "full_text",
        "article_id",
        code_name(F.col("outlet_id"), outlet_names, None).alias("outlet"),
        F.col("publication_date").alias("date"),
        "entity_id",
        "title",
    )
    few = inline_lexicon(lexicon)
    if few is not None:  # no join on the few ids, whose rows hold whole texts
        team = code_name(F.col("entity_id"), {r["entity_id"]: r["name"] for r in few}, None)
        named = rows.withColumn("team", team).where(F.col("team").isNotNull())
    else:
        named = rows.join(lexicon.select("entity_id", F.col("name").alias("team")), "entity_id")
    return named.select(
        "full_text", "article_id", "outlet", "date", "team", "title"
    )
