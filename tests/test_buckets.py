"""Tables in hash buckets: same rows as a plain merge, few buckets read and written, no lost work."""

import pytest
from pyspark.sql import functions as F

from weekloom.operators import merge
from weekloom.session import stored
from weekloom.sources import buckets as B

SCHEMA = "link string, title string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.select("link", "title", "n").collect()), key=str)


@pytest.fixture()
def base(spark, tmp_path):
    path = str(tmp_path / "articles")
    old = spark.range(400).select(
        F.concat(F.lit("l"), F.col("id").cast("string")).alias("link"),
        F.lit("old").alias("title"),
        F.col("id").cast("int").alias("n"),
    )
    B.create_buckets(spark, path, old, ["link"], buckets=16, words=256)
    return path


def test_same_as_plain_merge_and_few_buckets_rewritten(spark, base):
    before, first = rows(B.read_buckets(spark, base)), B.current(spark, base)
    new = spark.createDataFrame([("l7", "new", 1), ("x1", "new", 2), ("x2", None, None)], SCHEMA)
    want = rows(merge.merge(B.read_buckets(spark, base), new, ["link"], ["title"]))
    v = B.merge_buckets(spark, base, new, ["title"])
    assert rows(B.read_buckets(spark, base)) == want and want != before
    assert len(v.rewritten) == 1 and set(v.rewritten) <= set(v.opened)
    changed = [b for b in v.runs if v.runs[b] != first.runs.get(b)]
    assert len(changed) <= 3
    # Buckets that were not rewritten keep the files they had.
    assert all(v.runs[b][0] == first.runs[b][0] for b in first.runs if b not in v.rewritten)
    # The version before can still be read.
    assert rows(B.read_buckets(spark, base, version=first)) == before


def test_new_keys_open_few_buckets(spark, base):
    new = spark.createDataFrame([(f"fresh{i}", "new", i) for i in range(40)], SCHEMA)
    v = B.merge_buckets(spark, base, new, ["title"])
    assert v.rewritten == [] and len(v.opened) <= 4
    assert B.read_buckets(spark, base).count() == 440


def test_every_stored_key_is_found(spark, base):
    known, _ = B.known_keys(spark, base, B.current(spark, base), B.read_buckets(spark, base).select("link"))
    assert known.count() == 400


def test_stored_keys_are_not_shuffled(spark, base):
    """The join that looks keys up streams the stored side and broadcasts the batch."""
    v = B.current(spark, base)
    plan = B._known(spark, base, v, stored(spark.createDataFrame([("l1",)], "link string"), "batch"), None)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_two_writers_lose_nothing(spark, base, monkeypatch):
    one = spark.createDataFrame([("l1", "one", 0), ("a", "one", 0)], SCHEMA)
    two = spark.createDataFrame([("l2", "two", 0), ("a", "two", 9)], SCHEMA)
    plain, raced = B._merged, []

    def late(*args):
        out = plain(*args)
        if not raced:
            raced.append(True)
            B.merge_buckets(spark, base, two, ["title"])
        return out

    monkeypatch.setattr(B, "_merged", late)
    v = B.merge_buckets(spark, base, one, ["title"])
    got = {r["link"]: (r["title"], r["n"]) for r in B.read_buckets(spark, base).collect()}
    assert v.number == 3 and len(got) == 401
    assert (got["l1"], got["l2"], got["a"]) == (("one", 1), ("two", 2), ("one", 9))


def test_a_lost_writer_blocks_nobody(spark, base, monkeypatch):
    monkeypatch.setattr(B, "PATIENCE", 0.2)
    fs, p = B._fs(spark, f"{base}/versions/{2:012d}.json")
    fs.create(p, False).close()
    assert B.current(spark, base).number == 1
    v = B.merge_buckets(spark, base, spark.createDataFrame([("z", "t", 1)], SCHEMA))
    assert v.number == 3 and B.read_buckets(spark, base).count() == 401


def test_repeats_nulls_empty_batches_and_missing_columns(spark, base):
    twice = spark.createDataFrame([("l1", "a", 1, 1), ("l1", "b", 2, 2), ("q", "c", 3, 1), ("q", "d", 4, 2)], SCHEMA + ", o int")
    with pytest.raises(ValueError):
        B.merge_buckets(spark, base, twice.drop("o"), ["title"])
    B.merge_buckets(spark, base, twice, ["title"], order_col="o")
    got = {r["link"]: (r["title"], r["n"]) for r in B.read_buckets(spark, base).collect()}
    assert (got["l1"], got["q"]) == (("b", 1), ("d", 3))
    B.merge_buckets(spark, base, spark.createDataFrame([(None, "x")], "link string, title string"), ["title"])
    assert B.read_buckets(spark, base).where("link is null and title = 'x' and n is null").count() == 1
    count = B.read_buckets(spark, base).count()
    B.merge_buckets(spark, base, spark.createDataFrame([], SCHEMA), ["title"])
    assert B.read_buckets(spark, base).count() == count


def test_many_appends_are_folded(spark, base, monkeypatch):
    monkeypatch.setattr(B, "MAX_RUNS", 2)
    for i in range(3):
        B.merge_buckets(spark, base, spark.createDataFrame([(f"f{i}-{j}", "n", j) for j in range(30)], SCHEMA))
    v = B.current(spark, base)
    assert max(len(r) for r in v.runs.values()) <= 2 and B.read_buckets(spark, base).count() == 490


def test_expiry_keeps_what_is_named(spark, base):
    for i in range(3):
        B.merge_buckets(spark, base, spark.createDataFrame([("l1", f"t{i}", 0)], SCHEMA), ["title"])
    assert B.expire(spark, base) == []
    want = rows(B.read_buckets(spark, base))
    gone = B.expire(spark, base, keep=1, min_age=-5)
    assert len(gone) == 2 and rows(B.read_buckets(spark, base)) == want
