"""How the sources of a language differ in their words.

Terms are counted in portions of text by length-bucketed packing: a term of up to 8 bytes is
one 64-bit word, one of up to 16 bytes two, and such words are radix-sorted and their runs
counted; longer terms are sorted as bytes, one bucket for each length. Spark adds the counts
up, and the divergences are sums over cells of a grid of term blocks and source blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import kept, table, written

LEAST_DOCS = 10
TOP_TERMS = 10
PORTION = 4 << 20  # bytes of text in hand at a time
TERMS_IN_CELL = 1024
SOURCES_IN_CELL = 128
SALTS = 16
COUNTS = "lang string, source string, term string, n long, docs long"


# ---- counting terms in a task ------------------------------------------------------------


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it belongs to a term, and its lower case."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    return inside, lower


def _pack(data: np.ndarray, begin: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at + 8`` of each term as a 64-bit word, first byte highest."""
    word = np.zeros(len(begin), np.uint64)
    for k in range(at, at + 8):
        byte = np.where(k < length, data[np.minimum(begin + k, len(data) - 1)], 0)
        word |= byte.astype(np.uint64) << np.uint64(8 * (at + 7 - k))
    return word


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by several columns of unsigned 64-bit integers, the first one leading.

    Sixteen bits a pass, lowest first; NumPy sorts 16-bit integers by radix. A pass in which
    all digits are equal is left out.
    """
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 64, 16):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(order: np.ndarray, differs: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of documents of each run; ``differs[i]`` says that place
    i + 1 of the order begins a new one. Documents ascend within a run."""
    first = np.flatnonzero(np.concatenate([[True], differs]))
    docs = doc[order]
    new_doc = np.concatenate([[True], differs | (docs[1:] != docs[:-1])])
    return first, np.diff(np.append(first, len(order))), np.add.reduceat(new_doc.astype(np.int64), first)


def count_terms(texts: pa.LargeBinaryArray, group: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a portion of texts; ``group`` has one number per text."""
    inside, lower = kept("term letters", _letters)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data, within = lower[raw], inside[raw]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts], last[cuts - 1] = within[cuts], within[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length, doc = end - begin, np.searchsorted(offsets, begin, "right") - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low, high in ((0, 8), (8, 16)):
        at = np.flatnonzero((length > low) & (length <= high))
        if len(at):
            words = [_pack(data, begin[at], length[at], k) for k in range(0, high, 8)]
            columns = [group[doc[at]].astype(np.uint64), *words]
            order = radix_order(columns)
            differs = np.zeros(len(at) - 1, bool)
            for column in columns:
                differs |= column[order[1:]] != column[order[:-1]]
            start, n, docs = _runs(order, differs, doc[at])
            found.append((at[order[start]], n, docs))
    long = np.flatnonzero(length > 16)
    for size in np.unique(length[long]).tolist():
        at = long[length[long] == size]
        terms = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, size)[begin[at]]).view(f"S{size}").reshape(-1)
        order = np.argsort(terms, kind="stable")
        order = order[np.argsort(group[doc[at]][order], kind="stable")]
        owner, sorted_terms = group[doc[at]][order], terms[order]
        start, n, docs = _runs(order, (owner[1:] != owner[:-1]) | (sorted_terms[1:] != sorted_terms[:-1]), doc[at])
        found.append((at[order[start]], n, docs))
    token, n, docs = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    ends = np.cumsum(length[token])
    places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length[token] - begin[token], length[token])
    bounds = np.concatenate([[0], ends]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(token), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[places])))
    return group[doc[token]], terms, n, docs


def _portions(texts: pa.LargeBinaryArray) -> Iterator[tuple[int, int]]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PORTION, "right")) - 1)
        yield at, min(upto, len(texts))
        at = upto


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        width = max(1, len(sources.dictionary))
        group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        texts = batch.column(2).cast(pa.large_binary())
        for a, b in _portions(texts):
            owner, terms, n, docs = count_terms(texts.slice(a, b - a), group[a:b])
            columns = [langs.dictionary.take(pa.array(owner // width)), sources.dictionary.take(pa.array(owner % width)), terms, pa.array(n), pa.array(docs)]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])


# ---- divergences ---------------------------------------------------------------------------


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _share(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)), in decimals wide enough for any counts;
    a language without terms has no shares, and what stands there for them is not used."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast(greatest({total} + 2 * terms, 1) as decimal(20, 0))")


def _pair_cell(rows: pa.Table) -> pa.Table:
    """Divergence of all pairs of sources in a cell, summed over the terms of its block.

    Rows without a term tell of the sources themselves: ``p`` is then the share of a term that
    the source does not have, and ``block_terms`` the number of terms in the block.
    """
    head = rows.filter(pa.compute.is_null(rows["term"]))
    numbers, names = head["number"].to_numpy(), head["source"]
    order = np.argsort(numbers)
    without, block_terms = head["p"].to_numpy()[order], head["block_terms"][0].as_py()
    lang, a, b = (head[c][0].as_py() for c in ("lang", "a", "b"))
    body = rows.filter(pa.compute.is_valid(rows["term"]))
    terms = body["term"].combine_chunks().dictionary_encode()
    p = np.repeat(without[:, None], len(terms.dictionary), axis=1)
    p[np.searchsorted(numbers[order], body["number"].to_numpy()), terms.indices.to_numpy()] = body["p"].to_numpy()
    block = numbers[order] // SOURCES_IN_CELL
    right, out = np.flatnonzero(block == b), []
    for i in np.flatnonzero(block == a):
        total = ((p[i] - p[right]) ** 2 // (p[i] + p[right])).sum(axis=1)
        absent = (without[i] - without[right]) ** 2 // (without[i] + without[right])
        out.append(total + (block_terms - p.shape[1]) * absent)
    left = np.repeat(np.flatnonzero(block == a), len(right))
    other, value = np.tile(right, len(out)), np.concatenate([*out, np.zeros(0, np.int64)])
    if a == b:
        left, other, value = (x[left != other] for x in (left, other, value))
    else:
        left, other, value = np.append(left, other), np.append(other, left), np.append(value, value)
    names = names.take(pa.array(order))
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": names.take(pa.array(left)), "item": names.take(pa.array(other)), "value": pa.array(value)})


def source_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs(text, lang, source)``.

    Part ``pair`` compares a source with each other source of its language, part ``term`` names
    the terms that it has more of than its language. Null text, lang and source are empty
    strings, which are values like others; repeated rows count as often as they occur; other
    columns are ignored; an empty table gives an empty result. A source without terms still
    has its pairs, all 0 where the language has no term in ``least_docs`` documents.

    A term of any length is counted whole. A hot source or language is added up in each task
    first; joins on its terms are salted, and a cell never holds more than about
    ``TERMS_IN_CELL`` terms of twice ``SOURCES_IN_CELL`` sources.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    raw = read.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term")
    counts = written(raw.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("salt", _salt("source")), "term-counts")
    common = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_set("salt").alias("salts"))
    terms = written(common.filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "salts"), "kept-terms")
    spread = terms.select("lang", "term", "lang_n", F.explode("salts").alias("salt"))
    uses = written(counts.drop("docs").join(spread, ["lang", "term", "salt"]).drop("salt"), "term-uses")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = Window.partitionBy("lang").orderBy("source")
    sources = read.select("lang", "source").distinct().withColumn("number", F.row_number().over(numbered) - 1)
    sizes = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = F.lit(0).cast("long")
    sources = written(
        sources.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"]),
        "sources",
    )
    shares = written(
        uses.withColumn("salt", _salt("term")).join(_salted(sources), ["lang", "source", "salt"])
        .withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total"))
        .drop("salt", "n", "lang_n", "total", "lang_total"),
        "term-shares",
    )

    gap = F.col("p") - F.col("q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    top = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / TERMS_IN_CELL))
    own = (F.col("number") / SOURCES_IN_CELL).cast("int")
    meets = F.explode(F.sequence(F.lit(0), ((F.col("sources") - 1) / SOURCES_IN_CELL).cast("int"))).alias("meets")
    in_block = F.pmod(F.xxhash64("term"), blocks).alias("block")
    counted = terms.withColumn("salt", _salt("term")).join(_salted(langs), ["lang", "salt"])
    per_block = counted.groupBy("lang", in_block).agg(F.count(F.lit(1)).alias("block_terms"))
    heads = sources.select("lang", "source", "number", "sources", F.explode(F.sequence(zero, blocks - 1)).alias("block"), _share("0", "total").alias("p"))
    heads = heads.join(per_block, ["lang", "block"], "left").na.fill(0, ["block_terms"]).withColumn("term", F.lit(None).cast("string"))
    bodies = shares.select("lang", "source", "number", "sources", in_block, "p", "term", zero.alias("block_terms"))
    cells = heads.select(*bodies.columns).unionByName(bodies).select("*", meets)
    cells = cells.withColumn("a", F.least(own, "meets")).withColumn("b", F.greatest(own, "meets")).drop("meets", "sources")
    parts = cells.groupBy("lang", "block", "a", "b").applyInArrow(_pair_cell, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(top)


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    """Sources of all documents."""
    return source_audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
tokens AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM tokens GROUP BY ALL),
terms AS (
    SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM terms GROUP BY ALL),
pool AS (SELECT DISTINCT lang, source FROM docs),
uses AS (
    SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, t.n AS lang_n, l.v, l.total AS lang_total
    FROM pool g JOIN terms t USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (
    SELECT lang, source, term, n,
           1 + 1000000000 * (n + 2) // ((sum(n) OVER (PARTITION BY lang, source))::BIGINT + 2 * v) AS p,
           1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS q
    FROM uses),
pairs AS (
    SELECT g.lang, g.source, h.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0)::BIGINT AS value
    FROM pool g JOIN pool h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source
    LEFT JOIN shares b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
    GROUP BY ALL),
found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
