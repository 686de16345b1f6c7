"""Pages, feeds, scraped rows, article tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekloom import schemas, vocab
from weekloom.functions.html import read_html
from weekloom.operators.pages import extract_pages
from weekloom.plans import ingest
from weekloom.session import cut_lineage
from weekloom.plans.weekly import working_tables
from weekloom.operators.quality import audit_storyline_tables
from weekloom.sources import feeds
from weekloom.sources.tables import empty_table

SKY = (
    '<div class="sdc-article-author"><span class="x sdc-article-author__name"> Jo Doe </span></div>'
    '<div class="sdc-article-body sdc-article-body--lead"><p> One <b>two</b> </p><div><p>nested</p></div>'
    "<p>Three<script>var p='</p>'</script></p></div><p>outside</p>"
)
BBC = (
    '<div data-component="byline-block"><div class="ssrcss-12jkbjf-Text-TextContributorName e19uhciu6">A B</div></div>'
    '<div data-component="text-block"><p>P1</p><p>P2 &amp; more</p></div><div data-component="other"><p>no</p></div>'
    '<div data-component="subheadline-block"><h2>Head</h2></div>'
)
GUARDIAN = (
    '<div data-gu-name="standfirst"><p> Sub title </p></div><a data-component="section"><span>Opinion</span></a>'
    '<div class="article-body-commercial-selector article-body-viewer-selector dcr-11jq3zt"><p>G1</p>'
    "<p> after newsletter promotion </p><h2>G2</h2></div>"
)


def test_pages(spark):
    rows = [
        (1, "SkySports", SKY), (2, "BBC", BBC), (3, "TheGuardian", GUARDIAN), (4, "SkySports", "<p>bare</p>"),
        (5, "BBC", '<a href="/sport/football/womens">W</a>' + BBC), (6, "Nowhere", SKY), (7, "BBC", None),
        (8, "BBC", '<a href="/sport/football/womens/x">W</a><div data-component="text-block"><p>a<p>b</div>'),
    ]
    df = spark.createDataFrame(rows, "id int, outlet string, html string")
    out = extract_pages(
        df, vocab.PAGE_SELECTORS, promo_lines=vocab.PROMO_LINES, excluded_hrefs=[vocab.EXCLUDED_SECTION_HREF]
    )
    got = {r["id"]: (r["author"], r["standfirst"], r["body"], r["excluded_link"]) for r in out.collect()}
    assert got[1] == ("Jo Doe", "", "One two\nThree\n", False)
    assert got[2] == ("A B", "", "P1\nP2 & more\nHead\n", False)
    assert got[3] == ("Opinion", "Sub title", "G1\nG2\n", False)
    assert got[4] == got[6] == got[7] == ("", "", "", False)
    assert got[5][3] is True
    assert got[8] == ("", "", "ab\nb\n", False)


def test_reader_ignores_stray_ends():
    root = read_html("</div><p>a</b><br/>b</p></p><!-- c --><p>d &lt; e")
    assert [n.text() for n in root.descendants() if n.tag == "p"] == ["ab", "d < e"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(vocab.lexicon_rows(vocab.INGEST_ALIASES), schemas.LEXICON)


def day(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def feed(spark):
    rows = [
        ("Arsenal win", None, "l1", "Mon, 04 Aug 2025 10:00:00 BST", ["News Story", "x"]),
        ("Spurs and Reds", "s", "l2", "Mon, 04 Aug 2025 00:00:00 BST", ["Article/Blog"]),
        ("Chelsea", "s", "l3", "Mon, 04 Aug 2025 10:00:00 BST", ["Live"]),
        ("Chelsea", "s", "l4", "Tue, 05 Aug 2025 00:00:01 BST", ["News Story"]),
        ("Nobody", "s", "l5", "Mon, 04 Aug 2025 10:00:00 BST", ["News Story"]),
        ("Chelsea", "s", "l6", "not a date", ["News Story"]),
        ("Blues", "s", "l7", "Tue, 05 Aug 2025 00:00:00 BST", []),
        ("Chelsea WSL", "s", "l8", "Mon, 04 Aug 2025 12:00:00 BST", ["News Story"]),
        ("Chelsea", "no page", "l9", "Mon, 04 Aug 2025 12:00:00 BST", ["News Story"]),
    ]
    return spark.createDataFrame(rows, schemas.FEED_ITEM)


def test_select_items(feed, lexicon):
    window = {"lower": day("2025-08-04 00:00:00"), "upper": day("2025-08-05 00:00:00")}
    got = {r["link"]: r["teams"] for r in ingest.select_items(feed, lexicon, tags=vocab.STORY_TAGS, **window).collect()}
    assert got == {"l1": ["Arsenal"], "l2": ["Liverpool", "Tottenham Hotspur"], "l8": ["Chelsea"], "l9": ["Chelsea"]}
    free = {r["link"] for r in ingest.select_items(feed, lexicon, **window).collect()}
    assert free == {"l1", "l2", "l3", "l7", "l8", "l9"}
    assert [r["link"] for r in ingest.rejected_items(feed).collect()] == ["l6"]
    assert ingest.select_items(feed, lexicon).count() == 0  # the last 24 hours


def test_feed_files(spark, tmp_path):
    item = (
        "<item><title><![CDATA[Arsenal & co]]></title><description>d</description><link>l1</link>"
        "<pubDate>Mon, 04 Aug 2025 10:00:00 BST</pubDate><category>News Story</category><category>b</category></item>"
    )
    (tmp_path / "a.xml").write_text(f"<rss><channel><title>t</title>{item}</channel></rss>")
    row = feeds.read_feed(spark, str(tmp_path)).first()
    assert (row["title"], row["link"], row["tags"]) == ("Arsenal & co", "l1", ["News Story", "b"])
    stream = feeds.stream_feed(spark, str(tmp_path))
    assert stream.isStreaming and stream.columns == schemas.FEED_ITEM.fieldNames()


def test_ingest_to_tables(spark, feed, lexicon):
    pages = spark.createDataFrame(
        [("l1", SKY), ("l2", SKY.replace("Jo Doe", "")), ("l8", SKY.replace("One", "WSL")), ("l3", SKY)],
        "url string, html string",
    )
    window = {"lower": day("2025-08-04 00:00:00"), "upper": day("2025-08-05 00:00:00")}
    sky = ingest.ingest_feed(feed, pages, lexicon, "SkySports", **window)
    assert sky.columns == schemas.SCRAPED.fieldNames()
    guardian = ingest.ingest_feed(
        feed, spark.createDataFrame([("l7", GUARDIAN), ("l1", GUARDIAN)], "url string, html string"), lexicon,
        "TheGuardian", **window,
    )
    rows = ingest.union_sources(sky, guardian)
    assert sorted((r["link"], r["outlet"], r["summary"]) for r in rows.collect()) == [
        ("l1", "SkySports", None), ("l1", "TheGuardian", "Sub title"), ("l2", "SkySports", "s"),
        ("l7", "TheGuardian", "Sub title"),
    ]
    empty = {
        name: empty_table(spark, schema)
        for name, schema in {
            "outlets": schemas.OUTLETS, "teams": schemas.TEAMS, "authors": schemas.AUTHORS,
            "articles": schemas.ARTICLES, "article_teams": schemas.ARTICLE_TEAMS,
        }.items()
    }
    out = ingest.upsert_scraped(empty, rows)
    arts = {r["link"]: r for r in out["articles"].collect()}
    assert sorted(r["id"] for r in arts.values()) == [1, 2, 3]
    names = {r["id"]: r["name"] for r in out["authors"].collect()}
    # Repeated link: outlet and author of the first source, text of the last.
    assert arts["l1"]["outlet_id"] == 3 and names[arts["l1"]["author_id"]] == "Jo Doe"
    assert arts["l1"]["full_text"] == "G1\nG2\n" and arts["l1"]["summary"] == "Sub title"
    assert arts["l2"]["author_id"] is None
    assert {(r["article_id"], r["team_id"]) for r in out["article_teams"].collect()} == {
        (arts["l1"]["id"], 1), (arts["l2"]["id"], 3), (arts["l2"]["id"], 6), (arts["l7"]["id"], 2),
    }
    assert {r["id"] for r in out["outlets"].collect()} == {2, 3}

    again = ingest.upsert_scraped(out, rows)
    for name in out:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, out[name].collect()))

    weekly = {
        "weekly_topic": empty_table(spark, schemas.WEEKLY_TOPIC),
        "weekly_clusters": empty_table(spark, schemas.WEEKLY_CLUSTERS),
        "weekly_keywords": empty_table(spark, schemas.WEEKLY_KEYWORDS),
    }
    assert audit_storyline_tables({**out, **weekly}).count() == 0
    broken = weekly | {
        "weekly_topic": spark.createDataFrame(
            [(1, dt.date(2025, 8, 4), dt.date(2025, 8, 10), 77, None, None, None)], schemas.WEEKLY_TOPIC
        )
    }
    found = {r["check_name"] for r in audit_storyline_tables({**out, **broken}).collect()}
    assert found == {"weekly_topic.pair"}
    work = working_tables({**out, **weekly})
    assert "article_id" in work["articles"].columns and "entity_id" in work["article_entities"].columns


def test_unknown_names_are_rejected(spark):
    at = dt.datetime(2025, 8, 4, 10)
    rows = spark.createDataFrame(
        [
            ("t", "s", "l1", at, "A", ["Arsenal", "Everton", None, " Chelsea "], "x", "BBC"),
            ("t", "s", "l1", at, "A", ["Arsenal"], "x", " BBC "),
            ("t", "s", "l2", at, "B", ["Arsenal"], "x", "ITV"),
            ("t", "s", "l3", at, "C", ["Arsenal"], "x", None),
            ("t", "s", None, at, "D", ["Arsenal"], "x", "BBC"),
            ("t", "s", "l4", at, None, None, "x", "BBC"),
        ],
        schemas.SCRAPED,
    )
    rejects = sorted(map(str, (tuple(r) for r in ingest.rejected_rows(rows).collect())))
    assert rejects == sorted(map(str, [
        ("l1", "team", "Everton"), ("l1", "team", None), ("l2", "outlet", "ITV"), ("l3", "outlet", None), (None, "link", "BBC"),
    ]))
    empty = {
        name: empty_table(spark, schema)
        for name, schema in {
            "outlets": schemas.OUTLETS, "teams": schemas.TEAMS, "authors": schemas.AUTHORS,
            "articles": schemas.ARTICLES, "article_teams": schemas.ARTICLE_TEAMS,
        }.items()
    }
    out = {n: cut_lineage(df) for n, df in ingest.upsert_scraped(empty, ingest.union_sources(rows)).items()}
    assert [tuple(r) for r in out["outlets"].collect()] == [(1, "BBC")]
    assert {tuple(r) for r in out["teams"].collect()} == {(1, "Arsenal"), (2, "Chelsea")}
    ids = {r["link"]: r["id"] for r in out["articles"].collect()}
    assert set(ids) == {"l1", "l4"}
    assert {tuple(r) for r in out["article_teams"].collect()} == {(ids["l1"], 1), (ids["l1"], 2)}
    assert {r["name"] for r in out["authors"].collect()} == {"A"}
    again = ingest.upsert_scraped(out, ingest.union_sources(rows))
    for name in out:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, out[name].collect()))
