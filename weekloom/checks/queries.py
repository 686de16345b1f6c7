"""Checkable queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import vocab
from weekloom.checks import samples as S
from weekloom.functions.weeks import with_week
from weekloom.functions.words import code_name, keyword_entries, tokens as words_of
from weekloom.operators import backlog, boosting, clusters, entities, kernels, keywords, labels, latent, merge, pages
from weekloom.operators import people, quality
from weekloom.operators import topics as models
from weekloom.plans import ingest, marts, training, weekly
from weekloom.schemas import FEED_ITEM
from weekloom.session import fresh_path, stored
from weekloom.sources import buckets, feeds, publish, tables
from weekloom.sources import models as saved
from weekloom.streaming import refresh, streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


WEEK = ["entity_id", "week_start"]
STORY = ["entity_id", "week_start", "cluster_id"]
ROW = ["entity_id", "week_start", "week_end", "article_id"]


def _r(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


# ---- weekly read models ---------------------------------------------------------------


@query
def topic_trend(spark, sf):
    t = S.storyline_tables(spark, sf)
    rows = marts.topic_trend(t, end="2025-08-10", last_n=8)
    return rows.select(*WEEK, "topic_id", "topic", "cnt", "total", _r("pct"))


@query
def week_table(spark, sf):
    rows = marts.week_table(S.storyline_tables(spark, sf))
    return rows.withColumn("keyword_list", F.array_join("keyword_list", "|"))


@query
def week_table_one_topic(spark, sf):
    t = S.storyline_tables(spark, sf)
    rows = marts.week_articles(t, 6, "2025-06-18", [vocab.TOPICS[1], "no such topic"])
    return rows.select(*STORY, "article_id", "topic_id", "link", "publication_date", "outlet")


@query
def week_metrics(spark, sf):
    return marts.week_metrics(S.storyline_tables(spark, sf))


@query
def topic_overview(spark, sf):
    return marts.topic_overview(S.storyline_tables(spark, sf))


@query
def storyline_cards(spark, sf):
    return marts.storyline_cards(S.storyline_tables(spark, sf))


@query
def storyline_articles(spark, sf):
    return marts.storyline_articles(S.storyline_tables(spark, sf))


@query
def keyword_string(spark, sf):
    return marts.keyword_strings(S.storyline_tables(spark, sf))


@query
def score_parse(spark, sf):
    strings = marts.keyword_strings(S.storyline_tables(spark, sf))
    entries = strings.select(*STORY, F.explode(keyword_entries(F.col("keywords"))).alias("e"))
    return entries.groupBy(*STORY, F.col("e.keyword").alias("keyword")).agg(
        F.max("e.score").alias("score")
    )


@query
def keyword_chips(spark, sf):
    t = S.storyline_tables(spark, sf)
    return marts.keyword_chips(t["weekly_keywords"]).select(
        *STORY, "slot", "keyword", _r("score"), _r("norm"), "font_size", "bar_width"
    )


@query
def cluster_sizes(spark, sf):
    return clusters.cluster_sizes(S.weekly_topic(spark, sf), [*STORY, "week_end"])


@query
def label_distribution(spark, sf):
    lab = S.table(spark, sf, "labels").select((F.col("quality") + 2 * F.col("toxic")).alias("label"))
    named = models.label_distribution(lab)
    return named.select("label", code_name(F.col("label"), vocab.TOPICS).alias("topic"), "n", _r("share"))


# ---- entities and texts ---------------------------------------------------------------


@query
def entity_match(spark, sf):
    docs = S.articles(spark, sf).select("article_id", "full_text")
    lex, text = S.lexicon(spark), F.col("full_text")
    hit = entities.match_entities(docs.where(entities.mentions_any(text, lex)), lex, text=text)
    return hit.select("article_id", F.array_join("teams", "|").alias("teams"))


@query
def entity_match_indexed(spark, sf):
    docs = S.articles(spark, sf).select("article_id", "full_text")
    hit = entities.match_entities(
        docs, S.lexicon(spark), text=F.col("full_text"), inline_limit=0
    )
    return hit.where(F.size("teams") > 0).select("article_id", F.array_join("teams", "|").alias("teams"))


@query
def entity_match_patterns(spark, sf):
    """Mentions by an indexed lexicon of plain words and of other patterns."""
    rows = [(100 + i, i, f"n{i}", pattern) for i, pattern in enumerate(S.PATTERNS)]
    lex = spark.createDataFrame(rows, "entity_id int, ord int, name string, pattern string")
    docs = S.articles(spark, sf).select("article_id", "full_text")
    hits = entities.mention_hits(docs, lex, inline_limit=0)
    return entities.explode_hits(hits, ["article_id"]).select("article_id", "entity_id", "cnt")


@query
def entity_counts(spark, sf):
    return S.entity_counts(spark, sf)


@query
def entity_assign(spark, sf):
    docs = S.articles(spark, sf).select("article_id", "full_text")
    lex = S.lexicon(spark)
    given = entities.assign_entities(entities.mention_hits(docs, lex), lex)
    return entities.explode_assigned(given, ["article_id"])


@query
def known_entities(spark, sf):
    known = entities.known_entities(S.article_entities(spark, sf))
    return known.select(
        "article_id", F.array_join(F.transform("known_ids", lambda i: i.cast("string")), "|").alias("ids")
    )


@query
def training_extract(spark, sf):
    rows = training.training_extract(
        S.articles(spark, sf),
        S.article_entities(spark, sf),
        S.lexicon(spark),
        outlet_names=dict(S.OUTLETS),
        excluded_term="was",
    )
    return rows.select(
        "article_id", "outlet", "date", "team", "title", F.md5(F.col("full_text").cast("binary")).alias("text_md5")
    )


@query
def week_bucket(spark, sf):
    ev = with_week(S.table(spark, sf, "events"), "ts")
    return ev.select("event_id", "week_start", "week_end")


def _feed(spark, sf):
    """Documents as feed items, with the page text next to them."""
    a = S.articles(spark, sf)
    return a.select(
        "title",
        F.expr("substring(full_text, 81)").alias("summary"),
        "link",
        F.concat(F.date_format("publication_date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" BST")).alias("published"),
        F.array(F.when(F.col("article_id") % 2 == 0, F.lit("News Story")).otherwise(F.lit("Live"))).alias("tags"),
        "outlet_id",
        "full_text",
    )


@query
def feed_filter(spark, sf):
    feed, lex = _feed(spark, sf), S.lexicon(spark)
    parts = []
    for code, name in S.OUTLETS:
        items = ingest.select_items(
            feed.where(F.col("outlet_id") == code),
            lex,
            lower=F.expr("timestamp_ntz '2025-06-02 00:00:00'"),
            upper=F.expr("timestamp_ntz '2025-07-20 23:00:00'"),
            tags=ingest.OUTLET_RULES[name]["tags"],
        )
        kept = items.where((F.col("full_text") != "") & ~F.col("full_text").contains("Nicht"))
        parts.append(
            kept.select("link", "title", "published_at", "teams", F.col("full_text").alias("article"), F.lit(name).alias("outlet"))
        )
    rows = ingest.union_sources(*parts)
    return rows.select("link", "published_at", F.array_join("teams", "|").alias("teams"), "outlet")


@query
def feed_files(spark, sf):
    """Feed items written as RSS items and read back from the files."""
    path = fresh_path(spark, "feed")
    items = _feed(spark, sf).select(
        F.regexp_replace("title", r"\s+", " ").alias("title"),
        F.concat(F.lit("a & b <c> "), F.regexp_replace("summary", r"\s+", " ")).alias("description"),
        "link",
        F.col("published").alias("pubDate"),
        F.col("tags").alias("category"),
    )
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    back = feeds.read_feed(spark, path).select(*FEED_ITEM.fieldNames())
    return back.select(
        F.trim("title").alias("title"), F.trim("summary").alias("summary"), "link", "published", F.array_join("tags", "|").alias("tags")
    )


_PAGE_RULES = {
    "test": {
        "author": [[(("h1",), None, ())]],
        "standfirst": [[(("div",), "class", ("ad",))]],
        "body": (("article",), None, ()),
        "every_body": False,
        "blocks": ("p", "h2"),
        "children_only": False,
    }
}


def _pages(spark, sf):
    raw = S.table(spark, sf, "pages").withColumn("outlet", F.lit("test"))
    return pages.extract_pages(raw, _PAGE_RULES, excluded_hrefs=["/The", "/En"])


@query
def page_text(spark, sf):
    return _pages(spark, sf).select("page_id", "url", "body")


@query
def page_promo_lines(spark, sf):
    """The links of every menu, without those that are promotional lines."""
    rules = {"test": _PAGE_RULES["test"] | {"body": (("nav",), None, ()), "blocks": ("a",)}}
    raw = S.table(spark, sf, "pages").withColumn("outlet", F.lit("test"))
    return pages.extract_pages(raw, rules, promo_lines=S.PROMO_LINES).select("page_id", "body")


@query
def ingest_articles(spark, sf):
    """Feed items about all pages, taken through selection, page reading and clean-up."""
    raw = S.table(spark, sf, "pages")
    feed = raw.select(
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.col("url").alias("link"),
        F.concat(
            F.date_format(
                F.expr("timestamp_ntz '2025-06-01 00:00:00' + make_dt_interval(0, cast(page_id as int), 0, 0)"),
                "EEE, dd MMM yyyy HH:mm:ss",
            ),
            F.lit(" GMT"),
        ).alias("published"),
        F.array().cast("array<string>").alias("tags"),
    )
    rows = ingest.ingest_feed(
        feed,
        raw.select("url", "html"),
        S.lexicon(spark),
        "test",
        lower=F.expr("timestamp_ntz '2025-06-02 00:00:00'"),
        upper=F.expr("timestamp_ntz '2026-06-01 00:00:00'"),
        selectors=_PAGE_RULES,
        rules={"tags": [], "excluded_hrefs": ["/The", "/En"], "promo_lines": []},
        excluded_term="Nicht",
    )
    return rows.select(
        "link", "published_at", "author", F.array_join("teams", "|").alias("teams"), "summary", "article", "outlet"
    )


@query
def training_file(spark, sf):
    """The training extract written as CSV and read back."""
    path = fresh_path(spark, "training")
    rows = training.training_extract(
        S.articles(spark, sf),
        S.article_entities(spark, sf),
        S.lexicon(spark),
        outlet_names=dict(S.OUTLETS),
        on_no_match="drop",
        min_count=3,
    )
    tables.write_csv(rows.select("article_id", "outlet", "date", "team", F.length("full_text").alias("n_chars")), path)
    return spark.read.option("header", True).schema(
        "article_id long, outlet string, date timestamp_ntz, team string, n_chars int"
    ).csv(path)


@query
def page_headings(spark, sf):
    return _pages(spark, sf).select("page_id", "author", "standfirst")


@query
def page_exclusion(spark, sf):
    return pages.drop_pages_linking_to(_pages(spark, sf)).select("page_id", "url")


# ---- backlogs, labels, merges ---------------------------------------------------------


@query
def topic_backlog(spark, sf):
    rows = backlog.topic_backlog(
        S.articles(spark, sf), S.article_entities(spark, sf), S.weekly_topic(spark, sf)
    )
    return rows.select(*ROW, F.length("full_text").cast("long").alias("n_chars"))


def _cluster_backlog(spark, sf, mode):
    return backlog.cluster_backlog(
        S.articles(spark, sf),
        S.article_entities(spark, sf),
        S.weekly_topic(spark, sf),
        as_of=F.lit("2025-07-16").cast("date"),
        columns=[],
        mode=mode,
    )


@query
def cluster_backlog(spark, sf):
    return _cluster_backlog(spark, sf, "incremental")


@query
def cluster_backlog_weeks(spark, sf):
    return _cluster_backlog(spark, sf, "rebuild_week")


def _labels(spark, sf):
    """A label for every pair of a labelled document, and as many for unknown articles."""
    lab = S.table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), ((F.col("quality") + 3 * F.col("toxic") + 1) % 7).alias("topic")
    )
    pairs = S.article_entities(spark, sf).join(lab, "article_id")
    gone = pairs.withColumn("article_id", F.col("article_id") + 1000000)
    return pairs.unionByName(gone).select("article_id", "entity_id", F.col("topic").cast("int").alias("topic"))


@query
def label_merge(spark, sf):
    updates = labels.label_updates(S.articles(spark, sf), S.article_entities(spark, sf), _labels(spark, sf))
    return labels.merge_labels(S.weekly_topic(spark, sf), updates, dry_run=True)


@query
def label_orphans(spark, sf):
    return labels.label_orphans(S.article_entities(spark, sf), _labels(spark, sf))


@query
def label_file(spark, sf):
    """Labels written as a UTF-16 file with ``;`` and read back."""
    path = fresh_path(spark, "labels")
    out = _labels(spark, sf).join(
        S.lexicon(spark).select("entity_id", F.concat(F.lit(" "), "name").alias("Team")), "entity_id"
    )
    out.select(F.col("article_id").alias(" Article_ID"), "Team", F.col("topic").alias("TOPIC")).write.option(
        "sep", ";"
    ).option("header", True).option("encoding", "UTF-16").csv(path)
    codes = {name: code for code, _, name, _ in S.LEXICON}
    return tables.read_labels(spark, path, codes).drop("row_no")


@query
def label_file_blanks(spark, sf):
    """A label file with padded names, blank and unknown teams, and topics that are no numbers."""
    path = fresh_path(spark, "labels")
    number = F.col("article_id") % 7
    out = _labels(spark, sf).join(S.lexicon(spark).select("entity_id", "name"), "entity_id").select(
        F.concat(F.lit(" "), F.col("article_id").cast("string")).alias("ARTICLE_ID"),
        F.when(number == 1, F.lit("  ")).when(number == 2, F.lit("Omega")).when(number != 3, F.concat("name", F.lit(" "))).alias(" Team"),
        F.when(number == 4, F.lit("none")).when(number != 5, F.col("topic").cast("string")).alias("Topic "),
    )
    out.write.option("sep", ";").option("header", True).option("encoding", "UTF-16").csv(path)
    codes = {name: code for code, _, name, _ in S.LEXICON}
    return tables.read_labels(spark, path, codes).drop("row_no")


@query
def label_preview(spark, sf):
    """What a dry run shows: rows per action, and the first rows that would be written."""
    updates = labels.label_updates(S.articles(spark, sf), S.article_entities(spark, sf), _labels(spark, sf))
    counts, first = labels.preview_rows(labels.merge_labels(S.weekly_topic(spark, sf), updates))
    empty = F.lit(None)
    return first.select("_action", *[c for c in ROW], "topic_id", empty.cast("long").alias("n")).unionByName(
        counts.select(
            "_action", "n", empty.cast("int").alias("entity_id"), empty.cast("date").alias("week_start"),
            empty.cast("date").alias("week_end"), empty.cast("long").alias("article_id"), empty.cast("int").alias("topic_id"),
        )
    )


def _scraped(spark, sf):
    """All documents as scraped rows, and a second copy of each labelled one."""
    docs = S.articles(spark, sf).join(
        S.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("author")),
        "article_id",
    )
    first = docs.select(
        "article_id",
        F.concat(F.lit("new "), "title").alias("title"),
        F.lit("s1").alias("summary"),
        "link",
        F.col("publication_date").alias("published_at"),
        "author",
        F.array(F.lit("Arsenal"), F.when(F.col("author") == "en", F.lit("Chelsea"))).alias("teams"),
        F.col("full_text").alias("article"),
        F.element_at(F.array(*[F.lit(n) for _, n in S.OUTLETS]), F.col("outlet_id")).alias("outlet"),
        F.lit(1).alias("order_no"),
    )
    again = first.join(
        S.table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), "quality"), "article_id"
    ).select(
        "article_id",
        F.concat(F.lit("again "), F.col("quality").cast("string")).alias("title"),
        F.lit("s2").alias("summary"),
        "link",
        (F.col("published_at") + F.expr("interval 1 day")).alias("published_at"),
        F.lit("").alias("author"),
        F.array(F.lit("Liverpool")).alias("teams"),
        "article",
        F.lit("BBC").alias("outlet"),
        F.lit(2).alias("order_no"),
    )
    rows = first.unionByName(again)
    return rows.withColumn("teams", F.array_compact("teams")).drop("article_id")


def _upserted(spark, sf, rows=None):
    """The scraped rows merged into tables that know the English documents already."""
    a = S.articles(spark, sf)
    english = S.table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("article_id"))
    stored = {
        "outlets": S.outlets(spark).where("id < 3"),
        "teams": spark.createDataFrame([(1, "Arsenal")], "id int, name string"),
        "authors": spark.createDataFrame([(7, "en")], "id long, name string"),
        "articles": a.join(english, "article_id", "left_semi").select(
            F.col("article_id").alias("id"),
            "link",
            "title",
            F.lit("s0").alias("summary"),
            "publication_date",
            "outlet_id",
            F.lit(7).cast("long").alias("author_id"),
            "full_text",
        ),
        "article_teams": a.join(english, "article_id", "left_semi").select("article_id", F.lit(1).alias("team_id")),
    }
    return ingest.upsert_scraped(stored, _scraped(spark, sf) if rows is None else rows)


@query
def upsert_articles(spark, sf):
    out = _upserted(spark, sf)["articles"]
    return out.withColumn("full_text", F.md5(F.col("full_text").cast("binary")))


@query
def upsert_dimensions(spark, sf):
    out = _upserted(spark, sf)
    return (
        out["authors"].withColumn("dim", F.lit("author"))
        .unionByName(out["outlets"].withColumn("dim", F.lit("outlet")))
        .unionByName(out["teams"].withColumn("dim", F.lit("team")))
        .select("dim", F.col("id").cast("long").alias("id"), "name")
    )


@query
def upsert_article_teams(spark, sf):
    return _upserted(spark, sf)["article_teams"]


@query
def keyed_article_merge(spark, sf):
    """The scraped rows merged into a table in buckets that knows the English documents."""
    base = fresh_path(spark, "articles-by-link")
    columns = ["link", "title", "summary", "publication_date", "full_text"]
    english = S.table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("article_id"))
    old = S.articles(spark, sf).join(english, "article_id", "left_semi").withColumn("summary", F.lit("s0"))
    buckets.create_buckets(spark, base, old.select(*columns), ["link"], buckets=16)
    renamed = {"published_at": "publication_date", "article": "full_text"}
    rows = _scraped(spark, sf).withColumnsRenamed(renamed).select(*columns, "order_no")
    buckets.merge_buckets(spark, base, rows, ["title", "summary", "full_text"], order_col="order_no")
    out = buckets.read_buckets(spark, base)
    return out.withColumn("full_text", F.md5(F.col("full_text").cast("binary")))


@query
def ingest_rejects(spark, sf):
    """What is left out if some links, outlets, teams and dates are not usable, and the tables then."""
    number = F.regexp_extract("link", r"\d+", 0).cast("long")
    rows = _scraped(spark, sf).select(
        F.when(number % 11 != 0, F.col("link")).alias("link"),
        F.when(number % 5 == 0, "ITV").otherwise(F.col("outlet")).alias("outlet"),
        F.when(F.col("author") == "fr", F.array_append("teams", F.lit("Everton"))).otherwise(F.col("teams")).alias("teams"),
        *["title", "summary", "published_at", "author", "article", "order_no"],
    )
    feed = _feed(spark, sf).withColumn("published", F.when(number % 13 == 0, "soon").otherwise(F.col("published")))
    out = _upserted(spark, sf, rows)
    pairs = out["article_teams"].join(out["articles"].select(F.col("id").alias("article_id"), "link"), "article_id")
    named = lambda df, kind, key, name: df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(name).cast("string").alias("name")
    )
    return (
        ingest.rejected_rows(rows).select(F.col("reason").alias("kind"), F.col("link").alias("key"), "name")
        .unionByName(named(ingest.rejected_items(feed), "date", "link", "published"))
        .unionByName(named(out["articles"], "articles", "link", "outlet_id"))
        .unionByName(named(pairs, "article_teams", "link", "team_id"))
        .unionByName(named(out["outlets"], "outlets", "id", "name"))
        .unionByName(named(out["teams"], "teams", "id", "name"))
    )


@query
def bridge_insert_ignore(spark, sf):
    counts = S.entity_counts(spark, sf)
    stored = counts.where("cnt >= 5").select("article_id", "entity_id")
    return merge.insert_ignore(stored, counts, ["article_id", "entity_id"])


@query
def cluster_column_merge(spark, sf):
    """New cluster numbers for all rows; topics stay as they are."""
    topic = S.weekly_topic(spark, sf)
    new = topic.select(*ROW, (F.col("article_id") % 3).cast("int").alias("cluster_id"))
    return merge.merge(topic, new, ROW, ["cluster_id"])


@query
def cluster_tables_merge(spark, sf):
    """Sizes and keywords of a later run merged into the stored ones, as in incremental mode."""
    t = S.storyline_tables(spark, sf)
    # Each is both merged into and merged.
    for name in ("weekly_clusters", "weekly_keywords"):
        t[name] = stored(t[name], name)
    moved = (F.col("cluster_id") + F.col("entity_id") % 2).cast("int")
    sizes = t["weekly_clusters"].select(*WEEK, moved.alias("cluster_id"), (F.col("size") + 10).alias("size"))
    words = t["weekly_keywords"].select(*WEEK, moved.alias("cluster_id"), "keyword", F.lit(2.0).alias("score"))
    clusters_now = merge.merge(t["weekly_clusters"], sizes, STORY, ["size"])
    words_now = merge.merge(t["weekly_keywords"], words, [*STORY, "keyword"], ["score"])
    return clusters_now.select(*STORY, F.lit("").alias("keyword"), F.col("size").cast("double").alias("value")).unionByName(
        words_now.select(*STORY, "keyword", F.round("score", 6).alias("value"))
    )


@query
def delete_cascade(spark, sf):
    t = S.storyline_tables(spark, sf)
    gone = t["weekly_clusters"].where("size < 3")
    return merge.delete_cascade(t["weekly_keywords"], gone, STORY).select(*STORY, "keyword", _r("score"))


@query
def delete_set_null(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    gone = S.table(spark, sf, "customer").where("c_acctbal < 0")
    return merge.delete_set_null(orders, gone, "o_custkey", "c_custkey")


@query
def published_tables(spark, sf):
    """Two tables published together, one of them twice."""
    base = fresh_path(spark, "tables")
    topic = S.weekly_topic(spark, sf)
    publish.publish(
        spark, base, {"topic": topic, "clusters": S.weekly_clusters(topic)}, {"topic": ["week_start"]}
    )
    stored = publish.read_published(spark, base, "topic")
    new = topic.select(*ROW, F.lit(6).alias("topic_id"))
    publish.publish(spark, base, {"topic": merge.merge(stored, new, ROW, ["topic_id"])})
    kept = publish.read_published(spark, base, "topic").join(
        publish.read_published(spark, base, "clusters"), STORY
    )
    return kept.select(*STORY, "article_id", "topic_id", "size")


@query
def storyline_export(spark, sf):
    """The week table as UTF-16 files, one folder per storyline number, read back."""
    path = fresh_path(spark, "export")
    t = S.storyline_tables(spark, sf)
    out = marts.week_articles(t).select(
        *STORY, "article_id", "topic_id", "link", "publication_date", "outlet"
    ).where("cluster_id is not null")
    tables.write_csv_utf16(out, path, ["cluster_id"])
    back = (
        spark.read.option("header", True).option("encoding", "UTF-16").option("multiLine", True)
        .option("basePath", path)
        .schema(
            "entity_id int, week_start date, article_id long, topic_id int, link string,"
            " publication_date date, outlet string, cluster_id int"
        )
        .csv(path)
    )
    return back


@query
def audit_constraints(spark, sf):
    docs, lab = S.table(spark, sf, "documents"), S.table(spark, sf, "labels")
    orders, line = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    hashed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    topic = S.weekly_topic(spark, sf)
    return quality.audit(
        [
            quality.unique_violations("documents.text", hashed, ["text_md5"]),
            quality.unique_violations("lineitem.key", line, ["l_orderkey", "l_linenumber"]),
            quality.orphan_violations("documents.label", docs, ["doc_id"], lab, ["doc_id"]),
            quality.orphan_violations("orders.part", orders, ["o_custkey"], S.table(spark, sf, "part"), ["p_partkey"]),
            quality.null_violations("weekly_topic.topic", topic, "topic_id", ROW),
            quality.length_violations("documents.text", docs, "text", 5000, ["doc_id"]),
            quality.membership_violations("documents.lang", docs, "lang", ["en", "fr"]),
            quality.membership_violations(
                "events.type",
                S.table(spark, sf, "events"),
                "event_type",
                spark.createDataFrame([("view",), ("click",)], "name string"),
            ),
        ]
    )


@query
def storyline_audit(spark, sf):
    """Every declared constraint over stored tables that break many of them."""
    t = S.storyline_tables(spark, sf)
    docs = S.table(spark, sf, "documents")
    code = (F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("long")
    end = F.date_add("week_start", 6).alias("week_end")
    team = {"entity_id": "team_id"}
    broken = {
        "outlets": t["outlets"],
        "teams": t["entities"],
        "authors": docs.select(code.alias("id"), F.when(F.col("lang") != "de", F.col("lang")).alias("name")).distinct(),
        "articles": t["articles"].join(docs.select(F.col("doc_id").alias("article_id"), "lang"), "article_id").where("article_id % 30 != 0").select(
            F.col("article_id").alias("id"),
            F.when(F.col("article_id") % 50 == 0, F.rpad("link", 600, "x")).when(F.col("article_id") % 90 != 7, F.col("link")).alias("link"),
            F.when(F.col("article_id") % 40 == 1, F.lit(9)).otherwise(F.col("outlet_id")).alias("outlet_id"),
            code.alias("author_id"),
        ),
        "article_teams": S.entity_counts(spark, sf).where("cnt >= 2").select("article_id", F.col("entity_id").alias("team_id")),
        "weekly_topic": t["weekly_topic"].withColumnsRenamed(team),
        "weekly_clusters": t["weekly_clusters"].where("size >= 3").select("*", end).withColumnsRenamed(team),
        "weekly_keywords": t["weekly_keywords"].select(
            "entity_id", "week_start", end, "cluster_id", "keyword", F.when(F.length("keyword") != 9, F.col("score")).alias("score")
        ).withColumnsRenamed(team),
    }
    # Written once, as tables are that an audit reads; each is read by many rules.
    return quality.audit_storyline_tables({name: stored(df, name) for name, df in broken.items()})


# ---- keywords -------------------------------------------------------------------------


def _members(spark, sf):
    topic = S.weekly_topic(spark, sf).where("cluster_id is not null")
    return topic.select(*STORY, "article_id").join(
        S.articles(spark, sf).select("article_id", "full_text"), "article_id"
    )


@query
def keyword_ctfidf(spark, sf):
    counts = keywords.phrase_counts(_members(spark, sf), STORY, stop_words=S.STOP_WORDS)
    best = keywords.top_ctfidf(counts, STORY)
    return best.select(*STORY, "keyword", "cnt", _r("score"), "rank")


@query
def people_keywords(spark, sf):
    counts = keywords.people_counts(_members(spark, sf), STORY)
    best = keywords.top_keywords(keywords.score_ctfidf(counts, STORY), STORY)
    return best.select(*STORY, "keyword", "cnt", _r("score"), "rank")


@query
def people_names(spark, sf):
    """Names by the corpus's own case and neighbours, per cluster."""
    corpus = S.articles(spark, sf).select("full_text")
    return people.people_names(_members(spark, sf), STORY, corpus=corpus)


@query
def people_gazetteer(spark, sf):
    """Names of one to three words from a list: here the first words of every document."""
    first = words_of(F.col("full_text"))
    names = S.articles(spark, sf).select(
        F.array_join(F.slice(first, 1, (F.col("article_id") % 3 + 1).cast("int")), " ").alias("name")
    )
    return keywords.people_counts(_members(spark, sf), STORY, gazetteer=names)


@query
def keyword_dedup(spark, sf):
    t = S.storyline_tables(spark, sf)
    return keywords.clean_keywords(t["weekly_keywords"], STORY, S.lexicon(spark)).select(
        *STORY, "keyword", _r("score")
    )


@query
def keyword_centroid(spark, sf):
    """The stored keywords scored by the mean vector of the articles that hold them."""
    t = S.storyline_tables(spark, sf)
    members = _members(spark, sf).join(S.vectors(spark, sf), "article_id")
    scored = keywords.score_centroid(members, t["weekly_keywords"], STORY, high=1)
    return scored.select(*STORY, "keyword", _r("score", 5))


# ---- clusters -------------------------------------------------------------------------


def _points(spark, sf):
    rows = S.weekly_topic(spark, sf).join(S.vectors(spark, sf), "article_id")
    features = clusters.topic_features(F.col("embedding"), F.col("topic_id"), len(vocab.TOPICS))
    return rows.select(*WEEK, "article_id", features.alias("features"))


@query
def elbow_k(spark, sf):
    """Elbow over a falling curve: articles outside the k fullest weeks of an entity."""
    per_week = S.weekly_topic(spark, sf).groupBy(*WEEK).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    fullest = Window.partitionBy("entity_id").orderBy(F.desc("n"), "week_start")
    after = fullest.rowsBetween(1, Window.unboundedFollowing)
    curve = per_week.select(
        "entity_id",
        F.row_number().over(fullest).alias("k"),
        F.coalesce(F.sum("n").over(after), F.lit(0)).cast("double").alias("inertia"),
    ).where("k >= 2")
    return clusters.elbow_k(curve, ["entity_id"])


@query
def kmeans_sweep(spark, sf):
    return clusters.kmeans_sweep(_points(spark, sf), WEEK).select(*WEEK, "k", _r("inertia", 4))


@query
def kmeans_sweep_chunked(spark, sf):
    """The same with every group of more than four articles cut into chunks."""
    swept = clusters.kmeans_sweep(
        _points(spark, sf), WEEK, local_rows=4, chunk_rows=8
    )
    return swept.select(*WEEK, "k", _r("inertia", 4))


@query
def weekly_clusters(spark, sf):
    return clusters.weekly_clusters(_points(spark, sf), WEEK)


@query
def weekly_clusters_chunked(spark, sf):
    """The same with every group of more than four articles cut into chunks."""
    return clusters.weekly_clusters(_points(spark, sf), WEEK, local_rows=4, chunk_rows=8)


@query
def weekly_storylines(spark, sf):
    """The whole weekly job: backlog, clusters, keywords; the new keyword table."""
    t = S.storyline_tables(spark, sf)
    have = S.vectors(spark, sf)
    t["article_entities"] = t["article_entities"].join(have.select("article_id"), "article_id", "left_semi")
    end = F.date_add("week_start", 6).alias("week_end")
    t["weekly_clusters"] = t["weekly_clusters"].select("entity_id", "week_start", end, "cluster_id", "size")
    t["weekly_keywords"] = t["weekly_keywords"].select(
        "entity_id", "week_start", end, "cluster_id", "keyword", "score"
    )
    out = weekly.cluster_weeks(
        t,
        have.select("article_id", "embedding"),
        S.lexicon(spark),
        as_of=F.lit("2025-08-01").cast("date"),
        stop_words=S.STOP_WORDS,
    )
    rows = out["weekly_keywords"].join(out["weekly_clusters"], weekly.CLUSTER)
    return rows.select(*weekly.CLUSTER, "keyword", _r("score"), "size")


# ---- topic models ---------------------------------------------------------------------


def _examples(spark, sf):
    rows = S.vectors(spark, sf)
    return models.embed(rows, encoder="embedding").select("article_id", "label", "features")


def _topic_examples(spark, sf):
    lab = S.table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), (F.col("quality") + 2 * F.col("toxic")).alias("label")
    )
    return _examples(spark, sf).drop("label").join(lab, "article_id")


def _judged(spark, sf):
    lab = S.table(spark, sf, "labels")
    label = F.col("quality") + 2 * F.col("toxic")
    return lab.select(
        label.alias("label"), F.when(F.col("doc_id") % 5 == 0, (label + 1) % 4).otherwise(label).alias("prediction")
    )


@query
def class_weights(spark, sf):
    return models.class_weights(S.vectors(spark, sf)).select("label", "n", _r("weight"))


@query
def stratified_split(spark, sf):
    rows = S.vectors(spark, sf).select("article_id", "label")
    return models.stratified_split(rows)


@query
def stratified_folds(spark, sf):
    rows = S.vectors(spark, sf).select("article_id", "label")
    return models.stratified_folds(rows, folds=10, repeat=1)


@query
def confusion_matrix(spark, sf):
    counts = models.confusion_counts(_judged(spark, sf))
    return models.confusion_matrix(counts, [0, 1, 2, 3, 4]).select("label", "prediction", "n", _r("share"))


@query
def model_scores(spark, sf):
    scores = models.accuracy(models.confusion_counts(_judged(spark, sf)))
    return scores.select("rows", _r("accuracy"), _r("balanced_accuracy"))


@query
def topic_model_eval(spark, sf):
    """Fit on 70 %, score on 30 %."""
    rows = stored(models.stratified_split(_examples(spark, sf)), "split")
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    model = models.fit(models.logistic(train.count()), train)
    return models.accuracy(models.confusion_counts(model.transform(test)))


@query
def topic_predictions(spark, sf):
    """A model fitted on all labelled articles, saved, loaded, and used on the backlog."""
    train = _topic_examples(spark, sf)
    path = fresh_path(spark, "model")
    saved.save_model(
        models.fit(models.logistic(train.count()), train),
        path,
        classes=[0, 1, 2, 3],
        created_at=saved.model_name(spark, "t"),
        notes="C=0.0001, balanced",
    )
    model, _ = saved.load_model(spark, path)
    rows = backlog.topic_backlog(
        S.articles(spark, sf), S.article_entities(spark, sf), S.weekly_topic(spark, sf), []
    )
    return models.predict_topics(model, rows.join(_examples(spark, sf), "article_id"), ROW)


@query
def saved_model_scores(spark, sf):
    """A model saved and loaded scores as the one in memory, and its description is kept."""
    train = _topic_examples(spark, sf)
    path = fresh_path(spark, "model")
    model = models.fit(models.logistic(train.count()), train)
    saved.save_model(model, path, classes=[0, 1, 2, 3], created_at=saved.model_name(spark, "t"), notes="balanced")
    again, info = saved.load_model(spark, path)
    rows = stored(_examples(spark, sf).select("article_id", "features"), "examples")
    one = models.predict_topics(model, rows, ["article_id"])
    other = models.predict_topics(again, rows, ["article_id"]).withColumnsRenamed(
        {"topic_id": "again_id", "topic_probability": "again_probability"}
    )
    same = (F.col("topic_id") == F.col("again_id")) & (F.col("topic_probability") == F.col("again_probability"))
    usable = F.col("topic_id").isin(list(info["classes"])) & F.col("topic_probability").between(0.25, 1.0)
    return one.join(other, "article_id").select(
        "article_id", same.alias("same"), usable.alias("usable"), F.lit(info["notes"]).alias("notes")
    )


@query
def topic_backlog_empty(spark, sf):
    """The labelling job with nothing to label: the table stays as it is."""
    t = S.storyline_tables(spark, sf)
    t["weekly_topic"] = t["weekly_topic"].withColumn("topic_id", F.coalesce("topic_id", F.lit(6)))
    train = _topic_examples(spark, sf)
    model = models.fit(models.logistic(train.count()), train)
    merged, undated = weekly.label_new_rows(
        t, model, lambda rows: rows.join(_examples(spark, sf).drop("label"), "article_id"), []
    )
    return merged.unionByName(undated, allowMissingColumns=True)


@query
def cross_val_predictions(spark, sf):
    rows = _examples(spark, sf)
    return models.cross_val_predict(rows, lambda n: models.logistic(n, c=1.0))


@query
def penalty_grid(spark, sf):
    """All eleven penalties, ten folds three times."""
    return models.summarize_grid(models.evaluate_grid(_examples(spark, sf)))


@query
def penalty_grid_optimality(spark, sf):
    """All 330 fits end where the gradient vanishes, and score every row three times a penalty."""
    grid, _ = models.solve_grid(_examples(spark, sf))
    return models.grid_optimality(grid, spark)


@query
def support_vector_eval(spark, sf):
    rows = models.stratified_split(_examples(spark, sf))
    model = kernels.fit_kernel_machine(rows.where("part = 'train'"))
    return models.accuracy(models.confusion_counts(model.transform(rows.where("part = 'test'"))))


@query
def support_vector_optimality(spark, sf):
    """A machine over all labelled rows: its pairs of classes, solved."""
    solved = kernels.fit_kernel_machine(_topic_examples(spark, sf)).optimality(spark)
    return solved.select("first", "second", "rows", _r("residual"))


@query
def boosting_eval(spark, sf):
    rows = models.stratified_split(_topic_examples(spark, sf))
    model = boosting.fit_boosting(rows.where("part = 'train'"))
    return models.accuracy(models.confusion_counts(model.transform(rows.where("part = 'test'"))))


@query
def boosting_fit(spark, sf):
    """A hundred rounds over all labelled rows; each lowers the loss."""
    return boosting.fit_boosting(_topic_examples(spark, sf)).summary(spark)


@query
def text_features(spark, sf):
    """Hashed TF-IDF of every document: its vector's length and number of entries."""
    docs = S.articles(spark, sf).select("article_id", "full_text")
    rows = models.embed(docs, encoder=models.text_encoder())
    squares = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, v: s + v * v)
    used = F.size(F.filter(vector_to_array("features"), lambda v: v > 0))
    return rows.select("article_id", F.round(F.sqrt(squares), 6).alias("norm"), used.alias("entries"))


@query
def article_vectors(spark, sf):
    """A dense vector for every article: its number of entries and its length."""
    docs = S.articles(spark, sf).select("article_id", "full_text")
    rows = latent.fit_encoder(docs).embed(docs)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    return rows.select("article_id", F.size("embedding").alias("entries"), F.round(F.sqrt(squares), 6).alias("norm"))


# ---- streams --------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of them: a pattern names both, where a
    plain path must be a folder."""
    schema = S.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


def _run(spark, rows, name):
    path = fresh_path(spark, name)
    streams.run_to_parquet(rows, path, fresh_path(spark, f"{name}-progress"))
    return spark.read.parquet(path)


@query
def stream_week_counts(spark, sf):
    rows = streams.closed_week_counts(_stream(spark, sf, "events"), ["event_type"])
    return _run(spark, rows, "weeks")


@query
def stream_first_copies(spark, sf):
    rows = _stream(spark, sf, "events").select(
        "ts", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("link")
    )
    firsts = streams.first_copies(rows, ts_col="ts", delay="60 days")
    return _run(spark, firsts.select("link"), "links")


@query
def stream_topic_merge(spark, sf):
    """Labels arrive as a stream and are merged into the published topic table."""
    base = fresh_path(spark, "live")
    topic = S.weekly_topic(spark, sf)
    publish.publish_weeks(spark, base, {"topic": topic})
    pairs = topic.select(*ROW)

    def rows_for(batch):
        return pairs.join(
            batch.select(F.col("doc_id").alias("article_id"), F.col("quality").alias("topic_id")), "article_id"
        ).select(*ROW, "topic_id", F.lit(1.0).alias("topic_probability"))

    streams.merge_stream(
        _stream(spark, sf, "labels"),
        base,
        "topic",
        ROW,
        ["topic_id", "topic_probability"],
        checkpoint=fresh_path(spark, "live-progress"),
        prepare=rows_for,
    ).awaitTermination()
    return publish.read_published(spark, base, "topic")


@query
def stream_article_refresh(spark, sf):
    """Scraped rows arrive in two lots, copies of a link in any order."""
    landed, base = fresh_path(spark, "scraped"), fresh_path(spark, "refreshed")
    # A lot is as many files as there are cores, so no task writes or reads half of the rows.
    files = max(1, spark.sparkContext.defaultParallelism)
    _scraped(spark, sf).drop("teams", "order_no").repartition(2 * files).write.parquet(landed)
    schema = spark.read.parquet(landed).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
    refresh.refresh_stream(
        rows,
        base,
        "link",
        ["published_at", "outlet", "author"],
        ["title", "summary", "article"],
        checkpoint=fresh_path(spark, "refresh-progress"),
        delay="365 days",
        n_buckets=16,
    ).awaitTermination()
    out = buckets.read_buckets(spark, base)
    return out.withColumn("article", F.md5(F.col("article").cast("binary")))


@query
def stream_label_arrivals(spark, sf):
    """Labels two hours before their article, and labels of unknown articles.

    A row far in the future ends each stream, as a quiet source would send to let the
    watermark pass; it meets nothing and stays in the state.
    """
    dates = S.articles(spark, sf).select("article_id", F.col("publication_date").alias("published_at"))
    pairs = S.article_entities(spark, sf).join(dates, "article_id")
    known = dates.withColumn("_key", F.col("article_id")).drop("article_id")
    given = _labels(spark, sf).withColumn("_key", F.col("article_id") % 1000000).join(known, "_key").select(
        "article_id", "entity_id", "topic", (F.col("published_at") - F.expr("interval 2 hours")).alias("labelled_at")
    )

    def stream(df, name, ts_col, beat):
        path = fresh_path(spark, name)
        df.write.parquet(path)
        written = spark.read.schema(df.schema).parquet(path)
        late = [F.lit(beat if c == "article_id" else None) if c != ts_col else F.expr("timestamp_ntz '2099-01-01'") for c in df.columns]
        for _ in range(2):
            end = spark.range(1).select(*[v.cast(df.schema[c].dataType).alias(c) for c, v in zip(df.columns, late)])
            end.coalesce(1).write.mode("append").parquet(path)
        # All rows arrive first, in as many files as tasks wrote them; then the late ones.
        files = max(1, len(written.inputFiles()))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)

    rows = streams.labels_with_pairs(
        stream(pairs, "pairs", "published_at", -1), stream(given, "given", "labelled_at", -2), within="7 days", delay="365 days"
    )
    return _run(spark, rows, "arrivals")


@query
def stream_scores_as_batch(spark, sf):
    """Every arriving row is scored once, as the batch scores it."""
    train = _examples(spark, sf)
    model = models.fit(models.logistic(train.count()), train)
    arriving = _stream(spark, sf, "embeddings").withColumnRenamed("vec_id", "article_id")
    arrived = _run(spark, streams.score_topics(model, models.embed(arriving, encoder="embedding"), ["article_id"]), "scores")
    batch = models.predict_topics(model, train, ["article_id"]).withColumnsRenamed(
        {"topic_id": "batch_id", "topic_probability": "batch_probability"}
    )
    same = (F.col("topic_id") == F.col("batch_id")) & (F.col("topic_probability") == F.col("batch_probability"))
    return arrived.join(batch, "article_id", "full").select("article_id", F.coalesce(same, F.lit(False)).alias("same"))


@query
def stream_topic_scores(spark, sf):
    train = _examples(spark, sf)
    model = models.fit(models.logistic(train.count()), train)
    arriving = _stream(spark, sf, "embeddings").withColumnRenamed("vec_id", "article_id")
    rows = streams.score_topics(model, models.embed(arriving, encoder="embedding"), ["article_id"])
    return _run(spark, rows, "scores")
