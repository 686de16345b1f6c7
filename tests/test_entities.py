"""Alias matching, counting, assignment, training extract."""

import re

import pytest
from pyspark.sql import functions as F

from weekloom import vocab
from weekloom.operators import entities as E
from weekloom.plans.training import training_extract

TEXTS = [
    "Arsenal beat Spurs. ARSENAL! The gunners' day",
    "Manchester United and Man United met Manchester City; City won",
    "nothing to see, Arsenalish Reds2 _Blues",
    "Étihad? Etihad! Éreds reds Spurs-Tottenham Tottenham Hotspur",
    "city city city city city united united united united united",
    "",
]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = vocab.lexicon_rows(vocab.TRAINING_ALIASES)
    return spark.createDataFrame(rows, "entity_id int, ord int, name string, pattern string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "article_id long, full_text string")


def expected_counts():
    out = {}
    for i, text in enumerate(TEXTS):
        for name, pattern in vocab.TRAINING_ALIASES:
            n = len(re.findall(rf"\b({pattern})\b", text, re.IGNORECASE))
            if n:
                out[(i, name)] = n
    return out


@pytest.mark.parametrize("limit", [64, 0])
def test_counts_equal_plain_regex(docs, lexicon, limit):
    hits = E.mention_hits(docs, lexicon, inline_limit=limit)
    got = {(r["article_id"], r["name"]): r["cnt"] for r in E.explode_hits(hits, ["article_id"]).collect()}
    assert got == expected_counts()


def test_overlapping_aliases_use_one_pattern_each(spark, docs):
    rows = [(1, 1, "A", "Man|Manchester United"), (2, 2, "B", "United"), (3, 3, "C", "Spurs")]
    lex = spark.createDataFrame(rows, "entity_id int, ord int, name string, pattern string")
    assert not E.one_scan(E.inline_lexicon(lex))
    got = E.explode_hits(E.mention_hits(docs, lex), ["article_id"]).where("article_id = 1").collect()
    assert {(r["name"], r["cnt"]) for r in got} == {("A", 2), ("B", 2)}


@pytest.mark.parametrize("limit", [64, 0])
def test_match_list_in_lexicon_order(docs, lexicon, limit):
    got = E.match_entities(
        docs, lexicon, text=F.col("full_text"), inline_limit=limit
    ).collect()
    want = {}
    for (i, name) in expected_counts():
        want.setdefault(i, []).append(name)
    assert {r["article_id"]: r["teams"] for r in got} == {i: want.get(i, []) for i in range(len(TEXTS))}


def test_assignment_ties_and_threshold(spark, docs, lexicon):
    known = spark.createDataFrame([(2, [3]), (5, [1, 2])], "article_id long, known array<int>")
    hits = E.mention_hits(docs, lexicon).join(known, "article_id", "left")

    def run(**kw):
        return {r["article_id"]: r["assigned"] for r in E.assign_entities(hits, lexicon, **kw).collect()}

    first = run()
    assert first[0] == [1]
    assert first[2] == [1] and first[5] == [1]  # no mention: the first entity
    assert first[4] == [5, 4]  # tie at five each; lexicon order decides, both stay
    assert run(on_no_match="drop")[2] == []
    fallback = run(on_no_match="fallback", known_ids_col="known")
    assert fallback[2] == [3] and fallback[5] == []


def test_four_mentions_are_not_enough(spark, lexicon):
    docs = spark.createDataFrame(
        [(1, "Arsenal " * 6 + "Chelsea " * 4 + "Reds " * 5)], "article_id long, full_text string"
    )
    got = E.assign_entities(E.mention_hits(docs, lexicon), lexicon).first()["assigned"]
    assert got == [1, 3]


def test_training_extract(spark, lexicon):
    rows = [
        (1, "Arsenal Arsenal", 1, "2025-01-01 10:00:00", "a"),
        (2, "Arsenal " + "Women " * 5, 2, "2025-01-01 10:00:00", "b"),
        (3, "Spurs women women women women", 3, "2025-01-01 10:00:00", "c"),
        (4, "Spurs", None, "2025-01-01 10:00:00", "d"),
        (5, "Spurs", 1, "2025-01-01 10:00:00", "not in the bridge"),
    ]
    arts = spark.createDataFrame(
        rows, "article_id long, full_text string, outlet_id int, d string, title string"
    ).withColumn("publication_date", F.col("d").cast("timestamp_ntz"))
    bridge = spark.createDataFrame([(i, 1) for i in range(1, 5)], "article_id long, entity_id int")
    got = training_extract(arts, bridge, lexicon, outlet_names={1: "BBC", 3: "SkySports"}).collect()
    assert {(r["article_id"], r["team"], r["outlet"]) for r in got} == {
        (1, "Arsenal", "BBC"), (3, "Tottenham Hotspur", "SkySports"),
    }


ODD = ["s?purs", "gunners?", "(?:the )?reds?", "[cm]ity", "man(?:chester)? united", "a|the", "İstanbul", "ok_", "x{0,1}y z"]


def test_patterns_give_the_same_hits_on_all_ways(spark):
    """Optional first letters, groups and classes; repeated rows and rows without an id."""
    texts = ["the purs and spurs win", "old gunner", "The Reds, red; mity city", "man united Manchester UNITED", None, "", "ok_ istanbul xy z y z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])], "article_id long, full_text string")
    rows = [(i, i, f"n{i}", p) for i, p in enumerate(ODD)] + [(50, 50, "plain", "old|win spurs|city")]
    lex = spark.createDataFrame(rows, "entity_id int, ord int, name string, pattern string")

    def found(limit):
        got = E.mention_hits(docs, lex, inline_limit=limit).collect()
        return sorted((str(r["article_id"]), str(r["full_text"]), [(h["name"], h["cnt"]) for h in r["hits"]]) for r in got)

    inline = found(64)
    assert inline == found(0)
    assert ("0", texts[0], [("n0", 2), ("n5", 1)]) in inline and ("None", texts[1], [("n1", 1), ("plain", 1)]) in inline
