"""Articles and labels that arrive in several lots."""

import datetime as dt

import pandas as pd

from weekloom.sources import buckets
from weekloom.streaming import refresh, streams

DAY = dt.datetime(2025, 6, 1)
ROW = "link string, published_at timestamp_ntz, outlet string, title string"


def lots(spark, folder, parts, schema):
    """Each part is one micro-batch; files are taken in the order they were written."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_refresh(spark, tmp, name, parts, **options):
    rows = lots(spark, f"{tmp}/{name}", parts, ROW)
    refresh.refresh_stream(
        rows, f"{tmp}/{name}-table", "link", ["published_at", "outlet"], ["title"],
        checkpoint=f"{tmp}/{name}-progress", n_buckets=4, **options,
    ).awaitTermination()
    return sorted((tuple(r) for r in buckets.read_buckets(spark, f"{tmp}/{name}-table").collect()), key=str)


def test_first_date_and_last_text_in_any_order_of_arrival(spark, tmp_path):
    micro = dt.timedelta(microseconds=1)
    copies = [
        [("a", DAY, "BBC", "one"), ("b", DAY, None, None)],
        [("a", DAY + micro, "Sky", "two"), (None, DAY, "x", "x"), ("c", None, "x", "x")],
        [("a", DAY + 3 * micro, "Sky", "last"), ("b", DAY - micro, "BBC", "early")],
    ]
    want = [("a", DAY, "BBC", "last"), ("b", DAY - micro, "BBC", None)]
    assert run_refresh(spark, tmp_path, "forth", copies, delay="9 days") == want
    assert run_refresh(spark, tmp_path, "back", copies[::-1], delay="9 days") == want


def test_idle_links_are_forgotten():
    class State:
        exists = hasTimedOut = removed = False
        get = None

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.removed, self.exists = True, False

        def getCurrentWatermarkMs(self):
            return 5000

        def setTimeoutTimestamp(self, ms):
            self.ms = ms

    state = State()
    part = pd.DataFrame({"at_": [4_000_000, 2_000_000], "first_": ["f4", "f2"], "last_": ["l4", "l2"]})
    out = list(refresh.first_and_last(("k",), iter([part]), state, 3000))
    assert out[0].values.tolist() == [["k", "f2", "l4"]] and state.ms == 7000
    list(refresh.first_and_last(("k",), iter([part]), state, 10))
    assert state.ms == 5001
    state.hasTimedOut = True
    assert list(refresh.first_and_last(("k",), iter([]), state, 3000)) == [] and state.removed


def test_labels_before_and_after_their_pair(spark, tmp_path):
    far = dt.datetime(2099, 1, 1)
    pairs = lots(
        spark, f"{tmp_path}/pairs",
        [[(1, 1, DAY)], [(2, 1, DAY), (3, 1, DAY)], [(-1, 0, far)], [(-1, 0, far)]],
        "article_id long, entity_id int, published_at timestamp_ntz",
    )
    labels = lots(
        spark, f"{tmp_path}/labels",
        [[(2, 1, 5, DAY)], [(1, 1, 4, DAY), (9, 1, 3, DAY), (3, 1, 6, DAY + dt.timedelta(days=40))], [(-2, 0, 0, far)], [(-2, 0, 0, far)]],
        "article_id long, entity_id int, topic int, labelled_at timestamp_ntz",
    )
    out = streams.labels_with_pairs(pairs, labels, delay="90 days")
    streams.run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/progress")
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    # The label of 3 is later than ``within`` allows.
    assert got == [(1, 1, 4, "label"), (2, 1, 5, "label"), (3, 1, 6, "orphan"), (3, 1, None, "open"), (9, 1, 3, "orphan")]
