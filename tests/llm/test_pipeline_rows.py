"""Stages of the pipeline on odd rows, next to brute force."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, row_key string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    return [" ".join(word() for _ in range(60)) for _ in range(8)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "k") for i, t in rows], COLUMNS).repartition(3)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def brute(rows):
    """First of each text that stands for its near copies; here all copies are equal, or differ in the last word."""
    seen, out = set(), 0
    for _, text in rows:
        if text and text.strip():
            name = text.rsplit(" ", 1)[0]
            if name in seen:
                continue
            seen.add(name)
        out += 1
    return out


def test_near_duplicates_of_odd_rows(spark, sf, texts):
    a, b, c, d = texts[:4]
    rows = [(5, a)] * 3 + [(6, a.rsplit(" ", 1)[0] + " other"), (7, b), (7, c), (8, c), (None, d), (None, d), (9, None), (9, ""), (10, texts[4])]
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), sf)
    assert got.columns == table(spark, rows).columns
    kept = pairs(got)
    assert len(kept) == brute(rows)
    assert sum(t in (a, rows[3][1]) for _, t in kept) == 1 and (7, b) in kept and (10, texts[4]) in kept
    assert sum(t == c for _, t in kept) == 1 and sum(t == d for _, t in kept) == 1 and (9, None) in kept and (9, "") in kept


def test_near_duplicates_keep_the_smallest_id(spark, sf, texts):
    rows = [(3, texts[0]), (2, texts[0]), (4, texts[1])]
    assert pairs(corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), sf)) == sorted([rows[1], rows[2]], key=str)


def test_leaks_are_judged_row_by_row(spark, sf, texts):
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 10)
    leak = f"{texts[0]} {item} {texts[1]}"
    rows = [(1, leak), (1, texts[2]), (None, leak), (None, texts[3]), (2, texts[4]), (2, texts[4]), (3, None), (4, item.upper())]
    got = corpus_pipeline.drop_leaks(spark, table(spark, rows), sf)
    assert pairs(got) == sorted([r for r in rows if item not in (r[1] or "") and r[1] != item.upper()], key=str)
    assert got.columns == table(spark, rows).columns


def test_toxicity_keeps_clashing_columns(spark, sf, texts):
    rows = [(1, texts[0]), (1, texts[0]), (None, None), (2, "")]
    got = corpus_pipeline.drop_toxic(spark, table(spark, rows), sf)
    assert pairs(got) == sorted(rows, key=str) and {r.toxicity for r in got.collect()} == {0.5}


def test_empty_tables_stay_empty(spark, sf):
    empty = table(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
