"""From landed feed items and pages to the normalised article tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import vocab
from weekloom.functions.words import blank_to_null, feed_time, join_text, name_code
from weekloom.operators.entities import match_entities, mentions_any
from weekloom.operators.merge import (
    assign_ids,
    fold_updates,
    insert_ignore,
    last_id,
    lookup_or_create,
    merge,
)
from weekloom.operators.pages import drop_pages_linking_to, extract_pages

# ---- fixed values: what sets the outlets apart -----------------------------------------
OUTLET_RULES = {
    "SkySports": {"tags": vocab.STORY_TAGS, "excluded_hrefs": [], "promo_lines": []},
    "BBC": {"tags": [], "excluded_hrefs": [vocab.EXCLUDED_SECTION_HREF], "promo_lines": []},
    "TheGuardian": {"tags": [], "excluded_hrefs": [], "promo_lines": vocab.PROMO_LINES},
}
# ---- end of fixed values ----------------------------------------------------------------


def select_items(
    feed: DataFrame,
    lexicon: DataFrame,
    *,
    lower: Column | None = None,
    upper: Column | None = None,
    tags: list[str] = (),
) -> DataFrame:
    """Feed items inside the window (default: the last 24 hours, ends included), with an
    allowed first tag if tags are given, that mention an entity in title or summary."""
    now = F.current_timestamp().cast("timestamp_ntz")
    upper = now if upper is None else upper
    lower = now - F.expr("interval 1 day") if lower is None else lower
    dated = feed.withColumn("published_at", feed_time(F.col("published"))).where(
        F.col("published_at").between(lower, upper)
    )
    if tags:
        dated = dated.where(F.get("tags", F.lit(0)).isin(list(tags)))
    text = join_text(F.col("title"), F.col("summary"))
    hit = mentions_any(text, lexicon)
    if hit is not None:
        # The test for any alias is cheaper than building the list, so it goes first.
        return match_entities(dated.where(hit), lexicon, text=text, out_col="teams")
    return match_entities(dated, lexicon, text=text, out_col="teams").where(F.size("teams") > 0)


def rejected_items(feed: DataFrame) -> DataFrame:
    """Feed items whose date cannot be read."""
    return feed.where(feed_time(F.col("published")).isNull())


def ingest_feed(
    feed: DataFrame,
    pages: DataFrame,
    lexicon: DataFrame,
    outlet: str,
    *,
    lower: Column | None = None,
    upper: Column | None = None,
    selectors: dict = vocab.PAGE_SELECTORS,
    rules: dict | None = None,
    excluded_term: str = vocab.EXCLUDED_BODY_TERM,
) -> DataFrame:
    """Scraped rows of one outlet (see ``schemas.SCRAPED``).

    Items are filtered before they meet the pages; an item without a page, or whose page
    has no body, is dropped, as is a body that holds the excluded term. Of several copies
    of a page the first by text is taken.
    """
    rules = OUTLET_RULES[outlet] if rules is None else rules
    items = select_items(feed, lexicon, lower=lower, upper=upper, tags=rules["tags"])
    # Every page wanted is read once, however many items or copies of it there are.
    wanted = pages.select(F.col("url").alias("link"), "html").join(
        items.select("link"), "link", "left_semi"
    )
    fetched = wanted.groupBy("link").agg(F.min("html").alias("html")).withColumn(
        "outlet", F.lit(outlet)
    )
    read = extract_pages(
        fetched,
        selectors,
        promo_lines=rules["promo_lines"],
        excluded_hrefs=rules["excluded_hrefs"],
    )
    usable = drop_pages_linking_to(read).where(
        (F.col("body") != "") & ~F.col("body").contains(excluded_term)
    )
    kept = items.join(usable, "link")
    own_summary = bool(selectors[outlet]["standfirst"])
    return kept.select(
        "title",
        F.col("standfirst" if own_summary else "summary").alias("summary"),
        "link",
        "published_at",
        "author",
        "teams",
        F.col("body").alias("article"),
        "outlet",
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources' rows; ``order_no`` keeps a fixed order for later merges."""
    placed = [
        s.withColumn("order_no", F.struct(F.lit(i).alias("source"), F.col("published_at"), F.col("link"), F.xxhash64("title", "article").alias("copy")))
        for i, s in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, placed)


def _insertable(outlet_ids: dict[str, int]) -> Column:
    """A scraped row with a link and a known outlet."""
    return F.col("link").isNotNull() & name_code(F.col("outlet"), outlet_ids).isNotNull()


def rejected_rows(
    scraped: DataFrame,
    *,
    team_ids: dict[str, int] = vocab.TEAM_IDS,
    outlet_ids: dict[str, int] = vocab.OUTLET_IDS,
) -> DataFrame:
    """(link, reason, name) of all that ``upsert_scraped`` leaves out.

    A row without a link ("link") or with an unknown outlet ("outlet") is not written at
    all; an unknown team ("team") only keeps that pair out of article_teams. Trimmed names
    count; a missing name is unknown.
    """
    bad = scraped.where(~_insertable(outlet_ids)).select(
        "link",
        F.when(F.col("link").isNull(), "link").otherwise("outlet").alias("reason"),
        F.col("outlet").alias("name"),
    )
    teams = scraped.where(_insertable(outlet_ids)).select("link", F.lit("team").alias("reason"), F.explode("teams").alias("name"))
    return bad.unionByName(teams.where(name_code(F.col("name"), team_ids).isNull()))


def upsert_scraped(
    tables: dict[str, DataFrame],
    scraped: DataFrame,
    *,
    team_ids: dict[str, int] = vocab.TEAM_IDS,
    outlet_ids: dict[str, int] = vocab.OUTLET_IDS,
    author_collation: str | None = None,
) -> dict[str, DataFrame]:
    """New versions of outlets, teams, authors, articles and article_teams.

    A known link keeps its date, outlet and author and gets the new title, summary and
    text. Within the batch the first row of a link gives the former, the last the latter;
    ``order_no`` defines the order. Rows without a link or a known outlet and teams that
    are not known are left out, so no key is NULL; ``rejected_rows`` lists them.
    """
    rows = scraped.where(_insertable(outlet_ids)).select(
        "link",
        "title",
        "summary",
        F.col("published_at").alias("publication_date"),
        name_code(F.col("outlet"), outlet_ids).alias("outlet_id"),
        blank_to_null(F.col("author")).alias("author"),
        F.col("article").alias("full_text"),
        "outlet",
        "teams",
        "order_no",
    )
    outlets = insert_ignore(
        tables["outlets"],
        rows.select(F.col("outlet_id").alias("id"), F.trim("outlet").alias("name")).distinct(),
        ["id"],
    )
    named = (
        rows.select("link", F.explode("teams").alias("name"))
        .select("link", F.trim("name").alias("name"), name_code(F.col("name"), team_ids).alias("team_id"))
        .where("team_id is not null")
    )
    teams = insert_ignore(
        tables["teams"], named.select(F.col("team_id").alias("id"), "name").distinct(), ["id"]
    )
    authors = lookup_or_create(
        tables["authors"], rows, name_col="author", key_collation=author_collation
    )
    fresh = rows.select("link").distinct().join(tables["articles"].select("link"), "link", "left_anti")
    new_ids = assign_ids(fresh, "link", last_id(tables["articles"])).select("link", "id")
    # Copies of a link are folded first, so no join sees a hot link.
    texts = ["title", "summary", "full_text"]
    columns = ["link", *texts, "publication_date", "outlet_id", "author"]
    folded = fold_updates(rows.select(*columns, "order_no"), ["link"], texts, "order_no")
    # Rows without an author would all meet in one task under the key NULL.
    name = F.coalesce("author", F.concat(F.lit("\0"), "link"))
    by_name = authors.select(F.col("id").alias("author_id"), F.col("name").alias("_name"))
    if author_collation:
        name = F.collate(name, author_collation)
        by_name = by_name.withColumn("_name", F.collate("_name", author_collation))
    updates = (
        folded.withColumn("_author", name)
        .join(by_name, F.col("_author") == F.col("_name"), "left")
        .drop("author", "_author", "_name")
        .join(new_ids, "link", "left")
    )
    articles = merge(tables["articles"], updates, ["link"], texts)
    every_id = tables["articles"].select("link", "id").unionByName(new_ids)
    bridge = (
        named.select("link", "team_id").distinct()
        .join(every_id, "link")
        .select(F.col("id").alias("article_id"), "team_id")
    )
    article_teams = insert_ignore(tables["article_teams"], bridge, ["article_id", "team_id"])
    return {
        "outlets": outlets,
        "teams": teams,
        "authors": authors,
        "articles": articles,
        "article_teams": article_teams,
    }
