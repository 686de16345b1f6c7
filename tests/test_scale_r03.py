"""Tables in several files, and steps that must not put a whole table into one task."""

from __future__ import annotations

import re

import pytest

from weekloom.checks import queries as Q
from weekloom.checks import samples as S
from weekloom.operators import entities, pages
from weekloom.operators import keywords as K


@pytest.fixture
def parted(spark, tmp_path):
    """Twenty vectors as a folder of files."""
    rows = [(i, [float(i % 3), float(i % 2)], i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_streams_read_tables_of_several_files(spark, parted):
    scored = Q.all_queries()["stream_topic_scores"](spark, parted)
    assert sorted(r["article_id"] for r in scored.collect()) == list(range(20))
    same = Q.all_queries()["stream_scores_as_batch"](spark, parted).collect()
    assert len(same) == 20 and all(r["same"] for r in same)


def test_pages_are_read_in_small_batches(spark):
    """A worker gets pages a hundred at a time, whatever the session's Arrow batches."""
    raw = spark.createDataFrame(
        [(1, "<article><h1>a</h1><p>x</p><p>y</p></article>", "test"), (2, None, "test"), (3, "<p>z</p>", None)],
        "page_id long, html string, outlet string",
    )
    found = pages.extract_pages(raw, Q._PAGE_RULES, excluded_hrefs=["/The"])
    assert found.columns == ["page_id", "outlet", "author", "standfirst", "excluded_link", "body"]
    assert [tuple(r)[2:] for r in found.orderBy("page_id").collect()] == [
        ("a", "", False, "x\ny\n"), ("", "", False, ""), ("", "", False, "")
    ]
    plan = pages.drop_pages_linking_to(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "InPandas" not in plan


def test_gazetteer_prunes_before_counting(spark):
    members = spark.createDataFrame([(1, "Anna Bell met carl dunn and anna bell")], "g int, full_text string")
    names = spark.createDataFrame([("anna bell",), ("dunn",)], "keyword string")
    found = K.phrase_counts(members, ["g"], low=1, high=3, among=names)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "anna bell", 2), (1, "dunn", 1)]
    listed = K.people_counts(members, ["g"], gazetteer=names.withColumnRenamed("keyword", "name"))
    assert sorted(tuple(r) for r in listed.select("g", "keyword", "cnt").collect()) == [(1, "anna bell", 2), (1, "dunn", 1)]


def test_few_and_many_letter_groups_find_the_same(spark, monkeypatch):
    rows = [(1, 1, "a", "th(?:is|e)"), (2, 2, "b", "ni[ck]ht"), (3, 3, "c", "[0-9]+"), (4, 4, "d", "kö?ln")]
    lexicon = spark.createDataFrame(rows, "entity_id int, ord int, name string, pattern string")
    texts = ["This the 7", "NICHT Kln", None, "", "İn the Köln ſthe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "article_id int, full_text string")

    def hits():
        found = entities.mention_hits(docs, lexicon, inline_limit=0)
        return sorted(tuple(r) for r in entities.explode_hits(found, ["article_id"]).collect())

    few = hits()
    monkeypatch.setattr(entities, "FEW_GRAMS", 0)
    assert few == hits() and {r[1] for r in few} == {1, 2, 3, 4}


def test_storyline_rows_are_written_once(spark, sf):
    """Tables made of the rows of articles and entities do not scan the texts for them again."""
    t = S.storyline_tables(spark, sf)
    assert t["weekly_topic"].inputFiles() and all("weekly-topic" in f for f in t["weekly_topic"].inputFiles())


def test_word_counts_come_in_pieces_of_text(spark, tmp_path, monkeypatch):
    """A task counts the words of a bounded piece of text, however large a file is."""
    texts = [(i, f"that wordy article{i % 3} wordy", "en", "src1", 30) for i in range(1, 40)] + [(40, None, "en", "src1", 0)]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(1, "2025-05-19", i % 2, i) for i in range(1, 41)]
    topic = spark.createDataFrame(rows, "entity_id int, week_start string, cluster_id int, article_id long")
    want = sorted(tuple(r) for r in S.weekly_keywords(spark, str(tmp_path), topic).collect())
    assert {r[3] for r in want} == {"wordy", "article0", "article1", "article2"}
    monkeypatch.setattr(S, "PIECE_CHARS", 25)
    pieced = S.weekly_keywords(spark, str(tmp_path), topic)
    pieces = -(-sum(len(t[1] or "") for t in texts) // 25)
    assert f", {pieces}), REPARTITION_BY_NUM" in pieced._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in pieced.collect()) == want


def test_word_counts_keep_their_pieces_in_a_shuffled_join(spark, tmp_path, monkeypatch):
    """Pieces of text and slices of words go by the text, not by the session's shuffle
    partitions, also where the articles' clusters are too many for a broadcast."""
    texts = [(i % 40 or None, f"that wordy article{i % 3} wordy", "en", "src1", 30) for i in range(80)]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(1, "2025-05-19", i % 2, i % 40 or None) for i in range(80)]
    topic = spark.createDataFrame(rows, "entity_id int, week_start string, cluster_id int, article_id long")
    want = sorted(tuple(r) for r in S.weekly_keywords(spark, str(tmp_path), topic).collect())
    assert {r[3] for r in want} == {"wordy", "article0", "article1", "article2"}
    monkeypatch.setattr(S, "PIECE_CHARS", 25)
    monkeypatch.setattr(S, "SLICE_CHARS", 50, raising=False)
    chars = sum(len(t[1]) for t in texts)
    # A task's sort or hash table of counts stands behind one of these two shuffles only.
    expected = {-(-chars // 25), -(-chars // 50)}
    broadcasts = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for conf in broadcasts:
        spark.conf.set(conf, "-1")
    try:
        pieced = S.weekly_keywords(spark, str(tmp_path), topic)
        plan = pieced._jdf.queryExecution().executedPlan().toString()
        dealt = {int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)}
        found = sorted(tuple(r) for r in pieced.collect())
    finally:
        for conf in broadcasts:
            spark.conf.unset(conf)
    assert "BroadcastHashJoin" not in plan and dealt == expected
    assert not re.search(r"hashpartitioning\([^)]*keyword[^)]*\), ENSURE", plan)
    assert found == want
