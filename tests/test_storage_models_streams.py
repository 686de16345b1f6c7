"""Files, publishing, topic models, streams, plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom import vocab
from weekloom.checks import queries as Q
from weekloom.checks import samples as S
from weekloom.checks.oracles import all_oracles
from weekloom.operators import topics as M
from weekloom.plans.weekly import label_new_rows
from weekloom.sources import models as saved
from weekloom.sources import publish as P
from weekloom.sources import tables as T
from weekloom.streaming import streams


def test_label_file(spark, tmp_path):
    text = " Article_ID ;Team;TOPIC;Full_text\n1; Arsenal ;3;\"a;b\nc\"\n2;Nobody;1;x\n3;Liverpool;0;y\n"
    (tmp_path / "l.csv").write_text(text, encoding="utf-16")
    got = T.read_labels(spark, str(tmp_path / "l.csv"), vocab.TEAM_IDS).orderBy("row_no").collect()
    assert [(r["article_id"], r["entity_id"], r["topic"]) for r in got] == [(1, 1, 3), (3, 3, 0)]
    (tmp_path / "i.csv").write_text("article_id;team_id;topic\n5; 2 ;1\n6;;1\n", encoding="utf-16")
    ids = T.read_labels(spark, str(tmp_path / "i.csv"), {}).collect()
    assert [(r["article_id"], r["entity_id"]) for r in ids] == [(5, 2)]
    (tmp_path / "bad.csv").write_text("article_id;team_id\n5;2\n", encoding="utf-16")
    with pytest.raises(ValueError):
        T.read_labels(spark, str(tmp_path / "bad.csv"), {})


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 'say "hi", é'), (2, 1, "plain")], "id int, c int, t string")
    T.write_csv(df, str(tmp_path / "a"))
    back = pd.concat(pd.read_csv(f) for f in (tmp_path / "a").glob("*.csv"))
    assert set(back["t"]) == {'say "hi", é', "plain"}
    T.write_csv_utf16(df, str(tmp_path / "b"), ["c"])
    for c, t in ((0, 'say "hi", é'), (1, "plain")):
        (file,) = (tmp_path / "b" / f"c={c}").glob("*.csv")
        assert file.read_bytes()[:2] in (b"\xff\xfe", b"\xfe\xff")
        assert list(pd.read_csv(file, encoding="utf-16")["t"]) == [t]


def test_weekly_layout_prunes(spark, tmp_path):
    rows = [(dt.date(2025, 8, 4), 1), (dt.date(2025, 8, 11), 2)]
    T.write_weekly(spark.createDataFrame(rows, "week_start date, v int"), str(tmp_path / "w"))
    one = spark.read.parquet(str(tmp_path / "w")).where("week_start = date '2025-08-04'")
    assert [r["v"] for r in one.collect()] == [1] and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(week_start" in one._jdf.queryExecution().toString()


def test_publish_all_or_nothing(spark, tmp_path):
    base = str(tmp_path / "base")
    assert P.current_version(spark, base) == P.Version()
    assert P.publish(spark, base, {"a": spark.range(3), "b": spark.range(1)}) == 1
    boom = spark.range(5).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))
    with pytest.raises(Exception):
        P.publish(spark, base, {"a": spark.range(9), "b": boom})
    assert P.current_version(spark, base).number == 1
    assert P.read_published(spark, base, "a").count() == 3
    assert P.publish(spark, base, {"b": P.read_published(spark, base, "b").union(spark.range(1))}) == 2
    assert (P.read_published(spark, base, "a").count(), P.read_published(spark, base, "b").count()) == (3, 2)


def test_publish_by_weeks(spark, tmp_path):
    base = str(tmp_path / "base")
    a, b, c = (dt.date(2025, 8, d) for d in (4, 11, 18))
    schema = "id int, v string, week_start date"
    P.publish_weeks(spark, base, {"w": spark.createDataFrame([(1, "x", a), (2, "x", b)], schema)})
    first = P.current_version(spark, base).weeks["w"]
    new = spark.createDataFrame([(2, "y", b), (3, "y", c)], schema)
    assert P.merge_published(spark, base, "w", new, ["id", "week_start"], ["v"]) == 2
    got = {tuple(r) for r in P.read_published(spark, base, "w").select("id", "v", "week_start").collect()}
    assert got == {(1, "x", a), (2, "y", b), (3, "y", c)}
    now = P.current_version(spark, base).weeks["w"]
    assert now[str(a)] == first[str(a)] and now[str(b)] != first[str(b)]
    assert P.read_published(spark, base, "w", [a]).count() == 1
    assert P.read_published(spark, base, "w", [dt.date(2024, 1, 1)]).count() == 0
    P.publish_weeks(spark, base, {"w": new.where("id = 3")}, [b, c])
    assert {r["id"] for r in P.read_published(spark, base, "w").collect()} == {1, 3}
    assert P.merge_published(spark, base, "w", new.limit(0), ["id", "week_start"], ["v"]) == 3


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        label = 0 if i % 10 < 6 else (1 if i % 10 < 9 else 2)
        rows.append((i, label, [float(v) for v in rng.normal(0, 1, 4) + 4 * np.eye(4)[label]]))
    df = spark.createDataFrame(rows, "article_id long, label int, embedding array<float>")
    return M.embed(df, encoder="embedding").cache()


def test_split_and_folds_keep_class_shares(examples):
    parts = M.stratified_split(examples).groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {
        (0, "test"): 54, (0, "train"): 126, (1, "test"): 27, (1, "train"): 63, (2, "test"): 9, (2, "train"): 21,
    }
    folds = M.stratified_folds(examples, folds=7).groupBy("label", "fold").count().collect()
    for label, n in ((0, 180), (1, 90), (2, 30)):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 7 and sum(sizes) == n and max(sizes) - min(sizes) <= 1
    other = M.stratified_folds(examples, folds=7, repeat=1)
    one = M.stratified_folds(examples, folds=7)
    assert one.join(other, ["article_id", "fold"]).count() < 150


def test_weights_and_penalty(examples):
    w = {r["label"]: r["weight"] for r in M.class_weights(examples).collect()}
    assert w == {0: pytest.approx(300 / 540), 1: pytest.approx(300 / 270), 2: pytest.approx(300 / 90)}
    assert M.reg_param(1e-4, 500) == pytest.approx(20.0) and M.reg_param(0.0, 500) == 0.0


def test_fit_save_predict(spark, examples, tmp_path):
    model = M.fit(M.logistic(300, c=1.0), examples)
    saved.save_model(model, str(tmp_path / "m1"), classes=[0, 1, 2], created_at="20250809T153500Z", notes="C=1")
    again, meta = saved.load_model(spark, str(tmp_path / "m1"))
    assert meta["filename"] == "m1" and meta["classes"] == [0, 1, 2]
    got = M.predict_topics(again, examples, ["article_id", "label"])
    assert got.count() == 300 and got.where("topic_probability between 0.33 and 1").count() == 300
    score = M.accuracy(M.confusion_counts(got, pred_col="topic_id")).first()
    assert score["rows"] == 300 and score["balanced_accuracy"] > 0.9
    with pytest.raises(Exception):
        saved.load_model(spark, str(tmp_path / "none"))


def test_confusion(spark):
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    counts = M.confusion_counts(preds)
    m = {(r["label"], r["prediction"]): (r["n"], r["share"]) for r in M.confusion_matrix(counts, [0, 1, 2]).collect()}
    assert len(m) == 9 and m[(0, 1)] == (1, 0.5) and m[(1, 1)] == (2, 1.0) and m[(2, 0)] == (0, 0.0)
    s = M.accuracy(counts).first()
    assert (s["accuracy"], s["balanced_accuracy"]) == (0.75, 0.75)


def test_grid_and_cross_validation(examples):
    grid = M.evaluate_grid(examples, penalties=[0.0, 0.1], folds=3, repeats=2, parallelism=4, max_iter=20)
    rows = grid.collect()
    assert len(rows) == 12 and all(r["balanced_accuracy"] > 0.8 for r in rows)
    assert sum(r["rows"] for r in rows if r["penalty"] == 0.1) == 600
    assert {r["fits"] for r in M.summarize_grid(grid).collect()} == {6}
    preds = M.cross_val_predict(examples, lambda n: M.logistic(n, c=1.0, max_iter=20), folds=3)
    assert preds.count() == 300 and preds.select("article_id").distinct().count() == 300


def test_other_models(examples):
    mapped = M.fourier_features(examples, "features", "mapped", n_out=64, gamma=0.1)
    svm = M.fit(M.support_vectors(features_col="mapped", max_iter=10), mapped)
    assert M.accuracy(M.confusion_counts(svm.transform(mapped))).first()["accuracy"] > 0.8
    gbt = M.fit(M.boosting(trees=3), examples)
    assert M.accuracy(M.confusion_counts(gbt.transform(examples))).first()["accuracy"] > 0.8


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "one three")], "article_id long, full_text string")
    vec = M.embed(docs, encoder=M.text_encoder(buckets=64)).select("features").first()[0]
    assert abs(vec.norm(2) - 1) < 1e-9

    def load():
        def run(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return run

    got = M.embed(docs, encoder=load).collect()
    assert [list(r["features"]) for r in got] == [[11.0, 1.0], [9.0, 1.0]]


def test_label_new_rows(spark, examples):
    model = M.fit(M.logistic(300, c=1.0), examples)
    arts = examples.select("article_id", F.lit(dt.datetime(2025, 8, 5)).cast("timestamp_ntz").alias("publication_date"), "embedding")
    bridge = examples.select("article_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("entity_id"))
    w = dt.date(2025, 8, 4), dt.date(2025, 8, 10)
    topic = spark.createDataFrame(
        [(1, *w, 0, 4, 6, 1.0), (1, *w, 1, 4, None, None)],
        "entity_id int, week_start date, week_end date, article_id long, cluster_id int, topic_id int, topic_probability double",
    )
    t = {"articles": arts, "article_entities": bridge, "weekly_topic": topic}
    out, undated = label_new_rows(t, model, lambda d: M.embed(d, encoder="embedding"), ["embedding"])
    rows = {(r["entity_id"], r["article_id"]): r for r in out.collect()}
    assert len(rows) == 600 and undated.count() == 0
    assert rows[(1, 0)]["topic_id"] == 6 and rows[(1, 1)]["cluster_id"] == 4 and rows[(1, 1)]["topic_id"] is not None


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame(
        [(f"2025-08-{d:02d} 12:00:00", "a" if d % 3 else "b") for d in range(1, 29)], "t string, kind string"
    ).select(F.col("t").cast("timestamp_ntz").alias("ts"), "kind")
    ev.where("ts < '2025-08-15'").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    counts = streams.closed_week_counts(src, ["kind"])
    for _ in range(2):
        streams.run_to_parquet(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
        ev.where("ts >= '2025-08-15'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {(r["week_start"], r["kind"]): r["cnt"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from weekloom.functions.weeks import with_week

    want = with_week(ev, "ts").where("week_end < date '2025-08-27'").groupBy("week_start", "kind").count().collect()
    assert got == {(r["week_start"], r["kind"]): r["count"] for r in want}


def test_stream_merge(spark, tmp_path):
    base = str(tmp_path / "base")
    P.publish(spark, base, {"t": spark.createDataFrame([(1, "a", 0)], "k int, v string, n int")})
    new = spark.createDataFrame([(1, "b", 1, 1), (1, "c", 1, 2), (2, "d", 1, 3)], "k int, v string, n int, o int")
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.merge_stream(src, base, "t", ["k"], ["v"], checkpoint=str(tmp_path / "cp"), order_col="o").awaitTermination()
    got = sorted(tuple(r) for r in P.read_published(spark, base, "t").collect())
    assert got == [(1, "c", 0), (2, "d", 1)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    every = Q.all_queries()
    for name in ("topic_trend", "week_metrics", "storyline_cards", "keyword_chips", "topic_backlog", "label_merge",
                 "keyword_ctfidf", "entity_match_indexed", "upsert_articles", "training_extract"):
        text = plan(every[name](spark, sf))
        for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
            assert banned not in text, (name, banned)
    assert "WindowGroupLimit" in plan(every["keyword_ctfidf"](spark, sf))
    cards = plan(every["week_metrics"](spark, sf))
    assert "title" not in cards  # columns a report does not show are not read


def test_catalogue(spark):
    every = Q.all_queries()
    assert set(all_oracles()) <= set(every) and len(every) > 50
    assert S.lexicon(spark).count() == len(S.LEXICON)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"entity_id", "week_start", "topic_id", "topic", "cnt", "total", "pct"}
    assert entry.queries().keys() >= entry.oracle_sql().keys()
