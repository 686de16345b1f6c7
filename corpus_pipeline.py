"""From raw documents to packed sequences: toxicity, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import table, written
from weekloom.llm.decontaminate import leaks
from weekloom.llm.near_dup import near_duplicates
from weekloom.llm.packing import pack_documents
from weekloom.llm.toxicity import THRESHOLD, learnable, score_texts, train


# Arrow batches of texts, which both the JVM and the workers hold outside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH``, so that long texts do not fill a task's
    memory, unless it sets them itself. Plans read these settings when they run, so they
    are left in place."""
    for name, most in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(most))


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column ``key`` that tells its rows apart, the same on every read.

    That is doc_id if each row has its own; else rows are numbered in a written copy.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, find: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``docs`` without the rows that ``find`` names by doc_id, given rows (doc_id, text) of their own ids."""
    key = _free(docs, "row_key")
    keyed = _keyed(docs, key)
    found = find(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(written(found, name), key, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Rows are judged one by one by their text, whatever their id, so repeated rows share their
    fate; a null text is judged as an empty one. Without usable labels nothing is rejected. An
    empty table stays empty; other columns pass through.
    """
    _small_batches(spark)
    model, clash = train(docs, learnable(table(spark, sf_dir, "labels"))), _free(docs, "toxicity")
    scored = score_texts(docs.withColumnRenamed("toxicity", clash), model).filter(F.col("toxicity") < THRESHOLD).drop("toxicity")
    return scored.withColumnRenamed(clash, "toxicity").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more): the
    one with the smallest id.

    If ids are null or shared, rows are told apart by a number instead and the first row stays;
    of repeated rows one stays, and two texts with one id are judged each by itself. Documents
    without words have no copies and stay. An empty table stays empty; other columns pass through.
    """
    _small_batches(spark)
    return _without(docs, lambda rows: near_duplicates(rows, words=5, percent=80).filter("not kept"), "duplicates")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Each row is judged by its own text, with or without id; repeated rows share their fate and
    null texts stay. An empty table stays empty; other columns pass through.
    """
    _small_batches(spark)
    benchmark = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda rows: leaks(rows, benchmark), "leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 ids.

    Every row is packed, repeated ones and those without id or text too; an empty table gives
    no pieces. Columns but doc_id and text are left out.
    """
    _small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer are no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
