"""Merges, ids, deletes, labels, backlogs, audits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekloom.operators import backlog, labels, merge, quality
from weekloom.operators.ranking import digest_order


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(
        [(1, "a", 10, "old"), (2, "b", 20, "old"), (3, "c", None, "old")], "k int, x string, y int, z string"
    )


def test_only_named_columns_change(spark, target):
    new = spark.createDataFrame([(2, "B", 21), (3, "c", 31), (4, "d", 40)], "k int, x string, y int")
    out = merge.merge_preview(target, new, ["k"], ["y"])
    assert rows(out, "k", "x", "y", "z", "_action") == [
        (1, "a", 10, "old", "same"), (2, "b", 21, "old", "update"),
        (3, "c", 31, "old", "update"), (4, "d", 40, None, "insert"),
    ]


def test_merge_twice_is_merge_once(spark, target):
    new = spark.createDataFrame([(2, "B", None), (4, "d", 40)], "k int, x string, y int")
    once = merge.merge(target, new, ["k"], ["x", "y"])
    twice = merge.merge_preview(once, new, ["k"], ["x", "y"])
    assert rows(twice, "k", "x", "y", "z") == rows(once, "k", "x", "y", "z")
    assert twice.where("_action <> 'same'").count() == 0


def test_repeated_key_first_and_last_row(spark, target):
    new = spark.createDataFrame(
        [(4, "first", 1, 1), (4, "mid", 2, 2), (4, "last", None, 3), (1, "n", 7, 4), (1, "m", 8, 5)],
        "k int, x string, y int, o int",
    )
    out = merge.merge(target, new, ["k"], ["y"], order_col="o")
    assert rows(out.where("k in (1, 4)"), "k", "x", "y") == [(1, "a", 8), (4, "first", None)]


def test_collated_keys(spark):
    old = spark.createDataFrame([("José", 1)], "k string, v int")
    new = spark.createDataFrame([("JOSE", 2), ("Ana", 3)], "k string, v int")
    out = merge.merge(old, new, ["k"], ["v"], key_collation="UNICODE_CI_AI")
    assert rows(out, "k", "v") == [("Ana", 3), ("José", 2)]


def test_ids_follow_the_highest_and_are_stable(spark):
    table = spark.createDataFrame([(5, "x"), (9, "y")], "id long, name string")
    names = spark.createDataFrame([("x",), ("n1",), ("n2",), ("n1",), (None,)], "name string")
    out = merge.lookup_or_create(table, names)
    got = {r["name"]: r["id"] for r in out.collect()}
    assert got["x"] == 5 and got["y"] == 9 and {got["n1"], got["n2"]} == {10, 11} and len(got) == 4
    again = merge.lookup_or_create(table, names.repartition(5))
    assert {r["name"]: r["id"] for r in again.collect()} == got
    assert out.count() == 4
    twice = merge.lookup_or_create(out, names)
    assert rows(twice, "id", "name") == rows(out, "id", "name")


def test_author_names_by_collation(spark):
    table = spark.createDataFrame([(1, "José")], "id long, name string")
    names = spark.createDataFrame([("jose",), ("Ana",), ("ANA",)], "name string")
    out = merge.lookup_or_create(table, names, key_collation="UNICODE_CI_AI")
    assert rows(out, "id", "name") == [(1, "José"), (2, "ANA")]


def test_digest_order_numbers_every_row_once(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.lit(None)))
    out = digest_order(df, ["id"], group_cols=["g"], total_col="n", digits=2)
    for g, n in (("g = 'hot'", 4000), ("g is null", 1000)):
        part = out.where(g)
        assert part.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.max("n")).first()[:] == (1, n, n, n)


def test_deletes(spark):
    child = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "k int, p int")
    gone = spark.createDataFrame([(7,), (7,)], "p int")
    assert rows(merge.delete_cascade(child, gone, ["p"]), "k") == [(2,), (3,)]
    assert rows(merge.delete_set_null(child, gone, "p", "p"), "k", "p") == [(1, None), (2, 8), (3, None)]


@pytest.fixture(scope="module")
def stored(spark):
    arts = spark.createDataFrame(
        [(1, "2025-08-04 00:00:00"), (2, "2025-08-10 23:59:59"), (3, "2025-08-11 00:00:00"), (4, None)],
        "article_id long, d string",
    ).select("article_id", F.col("d").cast("timestamp_ntz").alias("publication_date"), F.lit("t").alias("full_text"))
    bridge = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)], "article_id long, entity_id int")
    w = dt.date(2025, 8, 4), dt.date(2025, 8, 10)
    topic = spark.createDataFrame(
        [(1, *w, 1, 0, 3, 0.9), (1, *w, 2, None, 2, 0.8)],
        "entity_id int, week_start date, week_end date, article_id long, cluster_id int, topic_id int,"
        " topic_probability double",
    )
    return arts, bridge, topic


def test_backlogs(stored):
    arts, bridge, topic = stored
    todo = backlog.topic_backlog(arts, bridge, topic)
    dated, undated = backlog.split_dated(todo)
    assert rows(dated, "entity_id", "article_id") == [(1, 3), (2, 2)]
    assert rows(undated, "article_id") == [(4,)]
    day = F.lit("2025-08-11").cast("date")
    new = backlog.cluster_backlog(arts, bridge, topic, as_of=day, mode="incremental")
    assert rows(new, "entity_id", "article_id", "topic_id") == [(1, 2, 2), (2, 2, None)]
    weeks = backlog.cluster_backlog(arts, bridge, topic, as_of=day)
    assert rows(weeks, "entity_id", "article_id") == [(1, 1), (1, 2), (2, 2)]
    open_week = backlog.cluster_backlog(arts, bridge, topic, as_of=F.lit("2025-08-10").cast("date"))
    assert open_week.count() == 0


def test_label_merge_keeps_clusters(spark, stored):
    arts, bridge, topic = stored
    lab = spark.createDataFrame(
        [(1, 1, 5, 0), (1, 1, 6, 1), (2, 2, 1, 2), (99, 1, 0, 3), (99, 1, 0, 4)],
        "article_id long, entity_id int, topic int, row_no long",
    )
    updates = labels.label_updates(arts, bridge, lab)
    preview = labels.merge_labels(topic, updates)
    assert rows(preview, "entity_id", "article_id", "cluster_id", "topic_id", "topic_probability", "_action") == [
        (1, 1, 0, 6, 1.0, "update"), (1, 2, None, 2, 0.8, "same"), (2, 2, None, 1, 1.0, "insert"),
    ]
    counts, sample = labels.preview_rows(preview)
    assert rows(counts, "_action", "n") == [("insert", 1), ("same", 1), ("update", 1)]
    assert sample.count() == 2
    assert rows(labels.label_orphans(bridge, lab), "article_id", "entity_id") == [(99, 1)]


def test_audit_finds_each_kind(spark):
    t = spark.createDataFrame([(1, "a"), (1, "abc"), (2, None)], "k int, v string")
    p = spark.createDataFrame([(1,)], "id int")
    out = quality.audit(
        [
            quality.unique_violations("u", t, ["k"]),
            quality.orphan_violations("f", t, ["k"], p, ["id"]),
            quality.null_violations("n", t, "v", ["k"]),
            quality.length_violations("l", t, "v", 2, ["k"]),
            quality.membership_violations("m", t, "v", ["a"]),
        ]
    )
    assert rows(out, "check_name", "key", "n") == [
        ("f", "2", 1), ("l", "1", 3), ("m", "abc", 1), ("n", "2", 1), ("u", "1", 2),
    ]
