"""Best-fit packing of token sequences by a configuration linear program.

A configuration says how many pieces of each length share one sequence. Which
configurations to use, and how often, depends on the histogram of lengths alone, which has
at most ``capacity`` entries however large the corpus is: the plan is made on the driver
from that histogram, and the pieces are then dealt to the plan's places by joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import table, written
from weekloom.llm.tokens import encoded, encoder

CAPACITY = 2048
ROUNDS = 300
STEP = 0.1
SLICE_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of the highest total price that fits, by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        upto = np.searchsorted(lengths, room, "right")
        worth = best[room - lengths[:upto]] + prices[:upto]
        k = int(np.argmax(worth))
        best[room], last[room] = worth[k], k
    room, out = int(np.argmax(best)), {}
    while room > 0 and last[room] >= 0:
        out[int(last[room])] = out.get(int(last[room]), 0) + 1
        room -= int(lengths[last[room]])
    return out


def fractional_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP):
    """Multiplicative weights for the program: cover every count with the fewest sequences.

    Each round prices the lengths by how little of them is covered so far, asks the knapsack
    for the most valuable configuration, and takes as much of it as adds ``step`` to the
    coverage of its scarcest length. Returns (configuration, times), times as fractions.
    """
    common = np.flatnonzero(counts >= capacity // lengths)  # rarer lengths cannot be repeated at will
    if not len(common):
        return []
    size, count = lengths[common], counts[common].astype(float)
    covered, chosen = np.zeros(len(common)), []
    for _ in range(rounds):
        weight = np.exp(-(covered - covered.min()) / step)
        found = _knapsack(size * weight, size, capacity)
        times = step * min(count[i] / k for i, k in found.items())
        for i, k in found.items():
            covered[i] += k * times / count[i]
        chosen.append(({int(common[i]): k for i, k in found.items()}, times))
    scale = max(covered.max(), 1e-9)
    return [(c, t / scale) for c, t in chosen]


def _fill(left: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The largest piece that is left, and the pieces that fill the rest of its sequence best."""
    first = int(np.flatnonzero(left)[-1])
    room = capacity - int(lengths[first])
    out, reach, steps = {first: 1}, 1, []
    full = (1 << (room + 1)) - 1
    for i in np.flatnonzero(left[: np.searchsorted(lengths, room, "right")])[::-1].tolist():
        size = int(lengths[i])
        spare, part = min(int(left[i]) - (i == first), room // size), 1
        while spare > 0 and not reach >> room & 1:
            part = min(part, spare)
            grown = (reach | reach << (part * size)) & full
            steps.append((i, part, reach))
            reach, spare, part = grown, spare - part, part * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            out[i] = out.get(i, 0) + part
            at -= part * int(lengths[i])
    return out


@dataclass
class Plan:
    """Places for the pieces of each length, as intervals of their rank.

    Interval j holds the ranks ``low[j] <= rank < high[j]`` of pieces of length
    ``length[j]``: ``per[j]`` of them to a sequence, from sequence ``sequence[j]`` on, the
    first of each at ``offset[j]``. Intervals are sorted by length and rank.
    """

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks (from 0)."""
        key = self.length.astype(np.int64) << 44 | self.low
        j = np.searchsorted(key, lengths.astype(np.int64) << 44 | ranks, "right") - 1
        nth = ranks - self.low[j]
        return self.sequence[j] + nth // self.per[j], self.offset[j] + nth % self.per[j] * lengths


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """An integral plan for ``histogram`` (length -> pieces).

    The fractional times are rounded down, and what is then left is packed by repeated exact
    filling: the largest piece, the subset of the others that fills its sequence best, as
    often as the counts allow. Every piece gets a place; the size of the plan depends on the
    number of lengths, not on the number of pieces.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    rows, sequences, used = [], 0, np.zeros(len(lengths), np.int64)

    def take(config: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for i in sorted(config, reverse=True):
            k = config[i]
            rows.append((int(lengths[i]), int(used[i]), int(used[i] + k * times), k, sequences, offset))
            used[i] += k * times
            left[i] -= k * times
            offset += k * int(lengths[i])
        sequences += times

    if len(lengths):
        for config, times in fractional_plan(lengths, left.copy(), capacity):
            if sum(int(lengths[i]) * k for i, k in config.items()) < capacity:
                continue  # the exact filling below does no worse
            if (n := min(int(times), *(int(left[i]) // k for i, k in config.items()))) > 0:
                take(config, n)
    while left.any():
        config = _fill(left, lengths, capacity)
        take(config, min(int(left[i]) // k for i, k in config.items()))
    columns = np.array(sorted(rows), np.int64).reshape(-1, 6).T
    return Plan(*columns, sequences)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, the end id included."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            end = np.array([end_id], encoder(tokenizer).dtype)
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1).to_pylist())):
                ids = np.append(ids, end).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out) if out else ([],) * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def _ranked(pieces: DataFrame, n: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.

    Ranks are counted inside slices of about ``SLICE_ROWS`` rows, so that a length which a
    third of all pieces have is no single group; slice totals then shift them.
    """
    slices = max(1, n // SLICE_ROWS)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sliced.groupBy("length", "slice").count().select("length", "slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    ranked = sliced.withColumn("nth", F.row_number().over(inside)).join(shift, ["length", "slice"])
    return ranked.withColumn("rank", F.col("shift") + F.col("nth") - 1).drop("slice", "nth", "shift")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all ``docs(doc_id, text)`` into sequences of at most ``capacity`` ids.

    Returns PIECES plus ``sequence_id`` and ``offset``. Only documents longer than
    ``capacity`` are cut. A null text is empty: one piece, the end id. A null doc_id is kept;
    repeated rows are packed as often as they come; other columns are ignored; an empty table
    gives no rows.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = pack_plan(histogram, capacity)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            sequence, offset = plan.places(df["length"].to_numpy(), df["rank"].to_numpy())
            yield df.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = _ranked(pieces, sum(histogram.values())).select(*pieces.columns, "rank")
    return ranked.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
