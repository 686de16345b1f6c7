"""Keyword clean-up and scores, weekly read models."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from weekloom import vocab
from weekloom.operators import keywords as K
from weekloom.plans import marts

STORY = marts.STORYLINE
W = dt.date(2025, 8, 4)


def greedy(items):
    kept = []
    for kw, score in sorted(items, key=lambda e: (len(e[0]), e[1]), reverse=True):
        if not any(kw.lower() in u.lower() or u.lower() in kw.lower() for u, _ in kept):
            kept.append((kw, score))
    return kept


def test_contained_equals_greedy(spark):
    rnd = random.Random(3)
    groups, rows = {}, []
    for g in range(120):
        items = {}
        for _ in range(rnd.randint(1, 12)):
            items["".join(rnd.choice("abA ") for _ in range(rnd.randint(1, 6)))] = rnd.random()
        groups[g] = list(items.items())
        rows += [(g, k, s) for k, s in groups[g]]
    df = spark.createDataFrame(rows, "g int, keyword string, score double")
    got = {}
    for r in K.drop_contained(df, ["g"]).collect():
        got.setdefault(r["g"], set()).add((r["keyword"], r["score"]))
    assert got == {g: set(greedy(items)) for g, items in groups.items()}


def test_own_aliases(spark):
    lex = spark.createDataFrame(
        vocab.lexicon_rows(vocab.KEYWORD_ALIASES), "entity_id int, ord int, name string, pattern string"
    )
    rows = [(1, "arsenal win"), (1, "chelsea"), (1, "gunnersbury"), (2, "the BLUES"), (99, "arsenal"), (99, "")]
    df = spark.createDataFrame([(e, k, 1.0) for e, k in rows], "entity_id int, keyword string, score double")
    got = {(r["entity_id"], r["keyword"]) for r in K.drop_own_aliases(df, lex).collect()}
    assert got == {(1, "chelsea"), (1, "gunnersbury"), (99, "arsenal")}


def test_ctfidf_and_people(spark):
    df = spark.createDataFrame(
        [(1, "Bukayo Saka scored 2 goals. Saka"), (1, "goals goals"), (2, "Declan Rice Junior rests, goals")],
        "g int, full_text string",
    )
    counts = K.phrase_counts(df, ["g"], high=1, stop_words=["rests"])
    got = {(r["g"], r["keyword"]): (r["cnt"], r["score"]) for r in K.score_ctfidf(counts, ["g"]).collect()}
    assert got[(1, "goals")][0] == 3 and (2, "rests") not in got and (1, "2") not in got
    mean = (7 + 4) / 2
    assert got[(1, "goals")][1] == pytest.approx(3 / 7 * math.log(1 + mean / 4))
    people = {(r["g"], r["keyword"]): r["cnt"] for r in K.people_counts(df, ["g"]).collect()}
    assert people == {(1, "bukayo saka"): 1, (2, "declan rice junior"): 1}
    gaz = spark.createDataFrame([("Saka",), ("Declan Rice",)], "name string")
    listed = {(r["g"], r["keyword"]): r["cnt"] for r in K.people_counts(df, ["g"], gazetteer=gaz).collect()}
    assert listed == {(1, "saka"): 2, (2, "declan rice"): 1}


def test_best_phrases_whatever_is_left_in(spark, monkeypatch):
    """Clusters of few articles leave most phrases in: then none is written again, and the best are the same."""
    rnd = random.Random(5)
    rows = [(g % 15, " ".join(rnd.choice("abcdefghijklmnop") * 2 for _ in range(12))) for g in range(40)]
    counts = K.phrase_counts(spark.createDataFrame(rows, "g int, full_text string"), ["g"])
    want = sorted(map(tuple, K.top_keywords(K.score_ctfidf(counts, ["g"]), ["g"], 3).collect()))
    written, stored = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df, name: written.append(name) or stored(df, name))
    for most in (0.0, 1.0):
        monkeypatch.setattr(K, "MOST_LEFT", most, raising=False)
        written.clear()
        assert sorted(map(tuple, K.top_ctfidf(counts, ["g"], 3).collect())) == want
        assert ("phrases-left" in written) == (most == 1.0)
    none = K.top_ctfidf(counts.where("false"), ["g"], 3)
    assert none.collect() == []


def chips(spark, scores, **kw):
    rows = [(1, W, 0, f"k{i}", s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "entity_id int, week_start date, cluster_id int, keyword string, score double")
    return sorted(marts.keyword_chips(df, **kw).collect(), key=lambda r: r["slot"])


def test_chips_overlap_and_scale(spark):
    got = chips(spark, [-0.9, 0.8, 0.7, 0.6, 0.5, 0.4])
    assert [r["keyword"] for r in got] == ["k0", "k1", "k2", "k3", "k4", "k3", "k4", "k5"]
    assert [r["slot"] for r in got] == list(range(1, 9))
    assert got[0]["norm"] == 1.0 and got[-1]["norm"] == pytest.approx(0.4)
    assert (got[0]["font_size"], got[0]["bar_width"], got[-1]["font_size"]) == (18, 80, 14)
    assert [r["keyword"] for r in chips(spark, [-0.9, 0.8, 0.7, 0.6, 0.5, 0.4], dedupe=True)] == [
        f"k{i}" for i in range(6)
    ]
    assert {r["norm"] for r in chips(spark, [0.5, 0.5, -0.5])} == {0.7}
    many = chips(spark, [1 - i / 100 for i in range(20)])
    assert [r["keyword"] for r in many] == [f"k{i}" for i in [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]]


@pytest.fixture(scope="module")
def tables(spark):
    topic = [
        (1, W, 0, 1, 2), (1, W, 0, 2, 1), (1, W, 0, 3, 1), (1, W, 1, 4, None), (1, W, None, 5, 2),
        (1, W - dt.timedelta(7), 0, 6, 0), (1, dt.date(2025, 5, 26), 0, 7, 0), (2, W, 0, 1, 6),
    ]
    arts = [(i, f"l{i}", f"t{i}", dt.datetime(2025, 8, 4 + i % 3, i), 1 if i != 4 else None) for i in range(1, 8)]
    return {
        "weekly_topic": spark.createDataFrame(
            topic, "entity_id int, week_start date, cluster_id int, article_id long, topic_id int"
        ),
        "articles": spark.createDataFrame(
            arts, "article_id long, link string, title string, publication_date timestamp_ntz, outlet_id int"
        ),
        "outlets": spark.createDataFrame([(1, "BBC")], "id int, name string"),
        "entities": spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string"),
        "weekly_clusters": spark.createDataFrame(
            [(1, W, 0, 3)], "entity_id int, week_start date, cluster_id int, size long"
        ),
        "weekly_keywords": spark.createDataFrame(
            [(1, W, 0, "b", 0.5), (1, W, 0, "a", -0.5), (1, W, 0, "c", 0.75), (1, W, 1, "orphan", 0.1)],
            "entity_id int, week_start date, cluster_id int, keyword string, score double",
        ),
    }


def test_week_table_and_strings(tables):
    got = {r["article_id"]: r for r in marts.week_table(tables, 1, "2025-08-10").collect()}
    assert set(got) == {1, 2, 3, 5}  # 4 has no outlet
    assert got[1]["keywords"] == "c:0.750000,a:-0.500000,b:0.500000"
    assert got[1]["keyword_list"] == ["c", "a", "b"]
    assert got[5]["keywords"] is None and got[5]["keyword_list"] == []
    some = marts.week_table(tables, 1, "2025-08-04", [vocab.TOPICS[1], "none"]).collect()
    assert {r["article_id"] for r in some} == {2, 3}
    assert marts.week_table(tables, 1, "2025-08-04", ["none"]).count() == 0


def test_metrics_overview_cards(tables):
    m = {(r["entity_id"], r["week_start"]): r for r in marts.week_metrics(tables).collect()}
    row = m[(1, W)]
    assert (row["n_articles"], row["n_storylines"], row["dominant_topic_id"]) == (4, 1, 1)
    assert row["dominant_topic"] == vocab.TOPICS[1]
    o = {(r["entity_id"], r["topic_id"]): r["n"] for r in marts.topic_overview(tables, None, W).collect()}
    assert o == {(1, 2): 2, (1, 1): 2, (2, 6): 1}
    cards = {(r["entity_id"], r["week_start"]): r for r in marts.storyline_cards(tables).collect()}
    card = cards[(1, W)]
    assert (card["storyline_no"], card["n_articles"], card["topic_id"], card["article_id"]) == (1, 3, 1, 2)


def test_trend(tables):
    got = marts.topic_trend(tables, 1).collect()
    weeks = {r["week_start"] for r in got}
    assert dt.date(2025, 5, 26) not in weeks and len(weeks) == 2
    now = {r["topic_id"]: (r["cnt"], r["total"], r["pct"]) for r in got if r["week_start"] == W}
    assert now == {2: (2, 5, 40.0), 1: (2, 5, 40.0), None: (1, 5, 20.0)}
    assert {r["week_start"] for r in marts.topic_trend(tables, 1, last_n=1).collect()} == {W}
    assert marts.topic_trend(tables, 1, end="2025-08-03").count() == 1
    sums = marts.topic_trend(tables).groupBy("entity_id", "week_start").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r["s"] - 100) < 1e-9 for r in sums)


def test_newest_first(tables):
    got = [r["article_id"] for r in marts.storyline_articles(tables, 1, W).collect()]
    assert got == [2, 1, 3]


def test_own_names_go_on_both_ways(spark, monkeypatch):
    lexicon = spark.createDataFrame(
        [(1, 1, "A", "arsenal|gunners"), (1, 2, "A", "the arse"), (2, 3, "B", r"f\.?c")], "entity_id int, ord int, name string, pattern string"
    )
    rows = [(1, "Arsenal win"), (1, "fc"), (1, "the arse"), (2, "F.C"), (2, "gunners"), (3, "fc"), (3, ""), (None, "x"), (2, ""), (1, "gunnersx")]
    words = spark.createDataFrame(rows, "entity_id int, keyword string")
    want = [(None, "x"), (1, "fc"), (1, "gunnersx"), (2, ""), (2, "gunners"), (3, "fc")]
    for rows_or_none in (None, False):
        if rows_or_none is False:
            monkeypatch.setattr(K, "inline_lexicon", lambda lexicon: None)
        out = K.drop_own_aliases(words, lexicon)
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] or 0, r[1])) == want
