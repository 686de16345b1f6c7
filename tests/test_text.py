"""Column functions: dates, weeks, tokens, keyword strings."""

import datetime as dt

from pyspark.sql import functions as F

from weekloom.functions import words
from weekloom.functions.weeks import with_week


def test_feed_time(spark):
    rows = [
        ("Sat, 09 Aug 2025 15:35:00 BST", dt.datetime(2025, 8, 9, 15, 35)),
        ("Sat, 9 Aug 2025 15:35:00 +0100", dt.datetime(2025, 8, 9, 15, 35)),
        ("Sun, 30 Mar 2025 01:30:00 GMT", dt.datetime(2025, 3, 30, 1, 30)),
        ("Sat, 31 Feb 2025 15:35:00 BST", None),
        ("Sat, 09 Foo 2025 15:35:00 BST", None),
        ("09 Aug 2025", None),
        (None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    got = [r[0] for r in df.select(words.feed_time(F.col("p"))).collect()]
    assert got == [r[1] for r in rows]


def test_week_bounds(spark):
    df = spark.createDataFrame(
        [("2025-08-10 23:59:59",), ("2025-08-11 00:00:00",), (None,)], "t string"
    ).select(F.col("t").try_cast("timestamp_ntz").alias("t"))
    got = [(r["week_start"], r["week_end"]) for r in with_week(df, "t").collect()]
    assert got == [
        (dt.date(2025, 8, 4), dt.date(2025, 8, 10)),
        (dt.date(2025, 8, 11), dt.date(2025, 8, 17)),
        (None, None),
    ]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([(1, "L'été 2025, Müller 4ever; 12 goals")], "id int, t string")
    row = df.select(words.tokens(F.col("t")), words.wordy_tokens(F.col("t"))).first()
    assert row[0] == ["l", "été", "2025", "müller", "4ever", "12", "goals"]
    assert row[1] == ["l", "été", "müller", "4ever", "goals"]
    cut = df.select("id", words.drop_words(words.wordy_tokens(F.col("t")), ["l"]).alias("w"))
    got = [r["keyword"] for r in words.explode_ngrams(cut, ["id"], "w", 1, 3).collect()]
    w = ["été", "müller", "4ever", "goals"]
    want = w + [" ".join(w[i : i + 2]) for i in range(3)] + [" ".join(w[i : i + 3]) for i in range(2)]
    assert sorted(got) == sorted(want)


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(1, []), (2, ["a"])], "id int, w array<string>")
    got = words.explode_ngrams(df, ["id"], "w", 1, 3).collect()
    assert [(r["id"], r["keyword"]) for r in got] == [(2, "a")]
    assert words.explode_ngrams(df, ["id"], "w", 2, 2).count() == 0


def test_keyword_entries(spark):
    df = spark.createDataFrame(
        [("a b:-0.5, x:y:0.25 ,bad:zz,plain,,:1",), (None,), ("",)], "k string"
    )
    got = df.select(words.keyword_entries(F.col("k")), words.keyword_names(F.col("k"))).collect()
    assert [tuple(e) for e in got[0][0]] == [
        ("a b", 0.5), ("x:y", 0.25), ("bad", 0.0), ("plain", 0.0), ("", 1.0),
    ]
    assert got[0][1] == ["a b", "x", "bad", "plain", ""]
    assert got[1][0] == [] and got[2][0] == [] and got[1][1] == []


def test_safe_int_and_codes(spark):
    df = spark.createDataFrame([(" 7 ", "Arsenal "), ("", "Nobody"), ("x", None)], "a string, b string")
    got = df.select(
        words.safe_int(F.col("a")), words.name_code(F.col("b"), {"Arsenal": 1}),
        words.blank_to_null(F.col("a")),
    ).collect()
    assert [tuple(r) for r in got] == [(7, 1, " 7 "), (None, None, None), (None, None, "x")]
    names = spark.range(2).select(words.code_name(F.col("id").cast("int"), {1: "one"})).collect()
    assert [r[0] for r in names] == ["Unknown", "one"]
