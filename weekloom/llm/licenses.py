"""License scan: TF-IDF cosine of headers to templates, and inheritance down the tree.

All of it is column expressions and joins. Sentences that speak of a license are headers;
each becomes a sparse vector of term weights (rows), whose cosine with the templates comes
from a join on terms. A file whose text is mostly such sentences is the licence file of its
folder; a file without a licence takes that of the nearest folder above it that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import table, written

# Licence names and the wording of their notices: fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
]
ANCHOR = r"(?i)licen[cs]e|public domain|all rights reserved|permission is hereby granted|redistribution and use"
SENTENCE = r"(?<=[.!?])\s+(?=\p{Lu})|[\r\n]+"
TERM = r"[\p{L}\p{N}.-]*[\p{L}\p{N}]"
THRESHOLD = 0.8
FILE_SHARE = 50


def _terms(text):
    return F.expr(f"regexp_extract_all(lower({text}), r'{TERM}', 0)")


def headers(files: DataFrame) -> DataFrame:
    """path and header: the sentences of each file's whole text that speak of a license."""
    sentence = F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SENTENCE))
    some = files.filter(F.col("text").rlike(ANCHOR)).select("path", sentence.alias("header"))
    return some.filter(F.col("header").rlike(ANCHOR)).select("path", F.trim("header").alias("header"))


def match_headers(found: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """header, license and score: each distinct header's best template, if good enough.

    Inverse document frequencies count templates and all headers of the corpus. Equal
    scores go to the licence that sorts first.
    """
    spark = found.sparkSession
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, body string")
    counted = written(found.groupBy("header").count(), "headers")
    side = lambda df, key, body: df.select(*key, F.explode(_terms(body)).alias("term")).groupBy(*key, "term").count().withColumnRenamed("count", "tf")
    total = counted.agg((F.coalesce(F.sum("count"), F.lit(0)) + len(templates)).alias("total"))
    of_headers = side(counted.withColumnRenamed("count", "times"), ["header", "times"], "header")
    of_templates = side(known, ["template", "license"], "body")
    frequency = of_headers.select("term", F.col("times").alias("n")).unionByName(of_templates.select("term", F.lit(1).alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    # ``total`` is one row.
    idf = written(frequency.join(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    weigh = lambda df, key: df.join(idf, "term").select(*key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = lambda df, key: df.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    h, t = weigh(of_headers, ["header"]), weigh(of_templates, ["template", "license"])
    dots = h.join(t.withColumnRenamed("w", "v"), "term").groupBy("header", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm(h, ["header"]), "header").join(norm(t, ["template"]).withColumnRenamed("norm", "t_norm"), "template")
    scored = scored.select("header", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 9).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("header", "license").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("header").orderBy(F.desc("score"), "license")
    return best.withColumn("nth", F.row_number().over(rank)).filter("nth = 1").drop("nth")


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, score and origin for every row of ``files(path, text)``.

    ``origin`` is ``header`` (its own best header), ``file`` (it is its folder's licence
    file: at least half of its words are in matched headers), ``inherited`` (from the
    nearest folder above with a licence file) or ``none`` (then license and score are
    null). Equal scores, also of several licence files in a folder, go to the licence that
    sorts first. Null texts have no header; null paths are in the top folder. Rows with the
    same path are one file with several texts: they share what is found in any. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    found = written(headers(rows), "license-headers")
    matched = written(found.join(match_headers(found, templates or TEMPLATES, threshold), "header"), "license-matches")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    own = matched.groupBy("path").agg(F.max("score").alias("score"), F.sum(words("header")).alias("header_words"))
    top = matched.join(own.select("path", "score"), ["path", "score"]).groupBy("path").agg(F.min("license").alias("license"))
    own = written(own.join(top, "path"), "own-licenses")
    sized = rows.select("path", words(F.coalesce("text", F.lit(""))).alias("n_words"))
    whole = sized.join(own, "path").groupBy("path", "license", "score", "header_words").agg(F.sum("n_words").alias("n_words"))
    whole = written(whole.withColumn("is_file", F.col("header_words") * 100 >= F.col("n_words") * FILE_SHARE), "licensed")
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    of_folder = whole.filter("is_file").withColumn("folder", folder("path"))
    best = of_folder.groupBy("folder").agg(F.max("score").alias("score"))
    of_folder = of_folder.join(best, ["folder", "score"]).groupBy("folder", "score").agg(F.min("license").alias("license"))
    # Every folder once, then all folders above it: the nearest with a licence file.
    folders = rows.select(folder("path").alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = folders.select("folder", F.explode(F.array_distinct(above)).alias("upper")).join(of_folder.withColumnRenamed("folder", "upper"), "upper")
    near = up.groupBy("folder").agg(F.max_by(F.struct("license", "score"), F.length("upper")).alias("near"))
    out = rows.select("path", folder("path").alias("folder")).join(whole.drop("n_words", "header_words"), "path", "left").join(near, "folder", "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("license", "near.license").alias("license"), F.coalesce("score", "near.score").alias("score"), origin.alias("origin"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents as files ``source/doc_id``: each source is a folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    found = scan_licenses(docs.select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "score", "origin")
