"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Partitions cut their texts' 64-bit hashes to as many bits as the table needs, sort them and
send each owner of a range of hashes one compressed list of distinct values. The owner
answers each list with a bitmap of the values that occur more than once. Only texts whose
hash did so, the suspects, are shuffled, folded per task first, and compared byte by byte;
all other texts stay where they are.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import kept, table, written
from weekloom.session import fresh_path

SPARE_BITS = 8  # a text without a copy becomes a suspect with probability 2^-8
PIECE = 1 << 16  # hashes of one compressed list, all owners together
OWNED = 1 << 19  # hashes per owner
CHUNK_BITS = 20  # rows behind one bitmap of suspects
SALTS = 256

LISTS = "chunk string, piece string, owner int, n long, code binary, repeated binary, counts binary, places binary"
ANSWERS = "piece string, owner int, bits binary"


# ---- Golomb codes (the parameter is a power of two) ------------------------------------


def _remainder_bits(n: int, span: int) -> int:
    return max(0, math.floor(math.log2(max(1.0, math.log(2) * span / max(1, n)))))


def golomb_encode(values: np.ndarray, low: int, high: int) -> bytes:
    """Sorted distinct integers of ``[low, high)``; the decoder needs their number, low and high."""
    if not len(values):
        return b""
    bits = np.uint64(_remainder_bits(len(values), high - low))
    gaps = values.astype(np.uint64) - np.uint64(low)
    gaps[1:] -= gaps[:-1].copy() + np.uint64(1)
    quotients = (gaps >> bits).astype(np.int64)
    rest = (gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    return np.packbits(rest.astype(np.uint8)).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(code: bytes, n: int, low: int, high: int) -> np.ndarray:
    """The integers that ``golomb_encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = _remainder_bits(n, high - low)
    raw, head = np.frombuffer(code, np.uint8), -(-n * bits // 8)
    rest = np.unpackbits(raw[:head], count=n * bits).reshape(n, bits).astype(np.uint64)
    low_part = (rest << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    marks = np.flatnonzero(np.unpackbits(raw[head:]))[:n]
    quotients = np.diff(marks, prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(bits)) + low_part
    return np.cumsum(gaps + np.uint64(1), dtype=np.uint64) - np.uint64(1) + np.uint64(low)


def _bounds(owners: int, width: int) -> list[int]:
    """Owner o has the hashes from ``bounds[o]`` up to, not including, ``bounds[o + 1]``."""
    return [-(-(o << width) // owners) for o in range(owners + 1)]


# ---- the exchange ----------------------------------------------------------------------


def _lists(owners: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (chunk, place, fingerprint) to one row for each list and owner."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(owners, width)
        cuts = np.array(bounds[1:-1], np.uint64)

        def piece(chunk: str, places: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(prints, kind="stable")
            values, first, counts = np.unique(prints[order], return_index=True, return_counts=True)
            at = [0, *np.searchsorted(values, cuts).tolist(), len(values)]
            ends, rows, name = np.append(first, len(order)), [], uuid.uuid4().hex
            for o, (a, b) in enumerate(zip(at, at[1:])):
                if a < b:
                    code = golomb_encode(values[a:b], bounds[o], bounds[o + 1])
                    mine = places[order[ends[a] : ends[b]]].astype("<u4").tobytes()
                    rows.append((chunk, name, o, b - a, code, np.packbits(counts[a:b] > 1).tobytes(), counts[a:b].astype("<u4").tobytes(), mine))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            names = ["chunk", "piece", "owner", "n", "code", "repeated", "counts", "places"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        held, chunk, n = [], None, 0
        for batch in batches:
            chunks = batch.column(0).dictionary_encode()
            codes, names = chunks.indices.to_numpy(), chunks.dictionary.to_pylist()
            places = batch.column(1).to_numpy()
            prints = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - width)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if n and (names[codes[a]] != chunk or n == PIECE):
                        yield piece(chunk, *map(np.concatenate, zip(*held)))
                        held, n = [], 0
                    upto = min(b, a + PIECE - n)
                    chunk, n = names[codes[a]], n + upto - a
                    held.append((places[a:upto], prints[a:upto]))
                    a = upto
        if n:
            yield piece(chunk, *map(np.concatenate, zip(*held)))

    return lists


def _answer(owners: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """All lists of an owner to a bitmap for each: which of its values occur again somewhere."""

    def answer(lists: pa.Table) -> pa.Table:
        rows = lists.to_pylist()
        bounds, owner = _bounds(owners, width), rows[0]["owner"]
        values = np.concatenate([golomb_decode(r["code"], r["n"], bounds[owner], bounds[owner + 1]) for r in rows])
        again = np.concatenate([np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        ends = np.cumsum([0] + [r["n"] for r in rows])
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
        return pa.table({"piece": lists["piece"], "owner": lists["owner"], "bits": pa.array(bits, pa.binary())})

    return answer


def _suspect_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with their answers to the places, inside the chunk, of rows whose value occurs again."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            again = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
            rows = np.repeat(again, np.frombuffer(r["counts"], "<u4"))
            out.append(np.frombuffer(r["places"], "<u4")[rows].tobytes())
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "places"])


def _keep_bitmaps(folder: str) -> Callable[[pa.Table], pa.Table]:
    """One compressed bitmap per chunk, in a file of its own for each attempt of a task."""

    def keep(rows: pa.Table) -> pa.Table:
        chunk, bits = rows["chunk"][0].as_py(), np.zeros(1 << CHUNK_BITS, bool)
        for places in rows["places"].to_pylist():
            bits[np.frombuffer(places, "<u4")] = True
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/{chunk}", recursive=True)
        with fs.open_output_stream(f"{base}/{chunk}/{uuid.uuid4().hex}") as sink:
            sink.write(zlib.compress(np.packbits(bits).tobytes()))
        return pa.table({"chunk": [chunk], "suspects": pa.array([int(bits.sum())], pa.int64())})

    return keep


def _bitmap(folder: str, chunk: str) -> np.ndarray:
    """The bitmap of a chunk; a file that a lost attempt left unfinished does not unpack."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{chunk}")):
        with fs.open_input_stream(info.path) as source:
            raw = source.read()
        try:
            return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8))
        except zlib.error:
            continue
    raise FileNotFoundError(f"{folder}/{chunk}")


def _is_suspect(folder: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("boolean")
    def suspect(chunk: pd.Series, place: pd.Series) -> pd.Series:
        held = kept(("bitmaps", folder), dict)
        out = np.zeros(len(chunk), bool)
        for name, at in chunk.groupby(chunk).indices.items():
            if name not in held:
                if len(held) >= 16:
                    held.clear()
                held[name] = _bitmap(folder, name)
            out[at] = held[name][place.to_numpy()[at]]
        return pd.Series(out)

    return suspect


# ---- the operator ----------------------------------------------------------------------


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the place of each row: ``chunk``, a run of rows of one file, and
    ``place`` in it. These are the same however often and in whatever splits a file is read.
    Rows that do not come straight from files are written to files first."""
    for from_files in (docs, None):
        if from_files is None:
            from_files = written(docs.select("doc_id", "text"), "dedup-rows")
        try:
            at = from_files.metadataColumn("_metadata")
            return from_files.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                F.concat_ws("-", F.md5(at["file_path"].cast("binary")), F.shiftright(at["row_index"], CHUNK_BITS)).alias("chunk"),
                at["row_index"].bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("place"),
            )
        except AnalysisException:
            if from_files is not docs:
                raise
    raise AssertionError


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; a null text is empty. Of equal texts the largest
    doc_id stays (a null one is the smallest); of repeated rows with that doc_id, one. Empty
    and very long texts are texts like others; other columns are ignored; an empty table gives
    an empty result. ``docs`` is read three times and must give the same rows each time.

    A hot text is one entry in every list and one row per task in the comparison; the rows of
    its copies, without text, are salted. Two different texts with the same 64-bit hash and
    the same SHA-256 stop the job; no others can be mistaken for copies.
    """
    spark = docs.sparkSession
    placed = _placed(docs)
    total = placed.count()
    width = min(64, max(1, total - 1).bit_length() + SPARE_BITS)
    owners = max(spark.sparkContext.defaultParallelism, -(-total // OWNED))
    lists = written(placed.select("chunk", "place", F.xxhash64("text")).mapInArrow(_lists(owners, width), LISTS), "dedup-lists")
    answers = lists.select("piece", "owner", "n", "code", "repeated").groupBy("owner").applyInArrow(_answer(owners, width), ANSWERS)
    found = lists.join(answers, ["piece", "owner"]).select("chunk", "n", "counts", "places", "bits")
    folder = fresh_path(spark, "dedup-bitmaps")
    places = found.mapInArrow(_suspect_places, "chunk string, places binary")
    written(places.groupBy("chunk").applyInArrow(_keep_bitmaps(folder), "chunk string, suspects long"), "dedup-manifest")

    suspect = _is_suspect(folder)(F.col("chunk"), F.col("place"))
    key, sha = F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256")
    rows = written(placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", key, sha, suspect.alias("suspect")), "dedup-digests")
    texts = placed.filter(suspect).groupBy("text").agg(F.count(F.lit(1)).alias("same")).select(key, sha, "same")

    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    members = rows.filter("suspect").select("row", "doc_id", "key", "text_sha256", salt)
    first = F.max(F.struct("doc_id", (-F.col("row")).alias("order"))).alias("first")
    slices = members.groupBy("key", "text_sha256", "salt").agg(first, F.count(F.lit(1)).alias("n"))
    groups = slices.groupBy("key", "text_sha256").agg(F.max("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    proven = groups.join(texts, ["key", "text_sha256"]).withColumn(
        "n", F.when(F.col("n") == F.col("same"), F.col("n")).otherwise(F.raise_error(F.lit("different texts with equal hashes")).cast("long"))
    )
    spread = proven.select("key", "text_sha256", "first", "n", F.explode("salts").alias("salt"))
    copies = members.join(spread, ["key", "text_sha256", "salt"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("first.order") == -F.col("row")).alias("kept"),
        "text_sha256",
    )
    single = rows.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return single.unionByName(copies)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, with the class of equal texts that each belongs to."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, false) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
