"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weekloom.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts lineage: a lost executor costs the tasks of one step, not of all steps so far.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(key: object, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps from task to task."""
    store = sys.modules.setdefault("weekloom_worker", types.ModuleType("weekloom_worker"))
    held = vars(store).setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


# Multipliers of the hash finaliser: fixed values.
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits (a one-to-one map)."""
    shift = np.uint64(33)
    x = x ^ (x >> shift)
    x = x * np.uint64(_M1)
    x = x ^ (x >> shift)
    x = x * np.uint64(_M2)
    return x ^ (x >> shift)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20


class _Tables:
    """Look-up tables by byte, and powers of the base and of its inverse."""

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.value = mix(np.arange(1, 257, dtype=np.uint64))
        self.up, self.down = self._powers(_BASE), self._powers(_INVERSE)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(_STEP + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def _tables() -> _Tables:
    return kept("word tables", _Tables)


class Words:
    """All words of a batch of texts as 64-bit hashes, in order.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. ``hashes`` holds
    them text after text; ``bounds[i]:bounds[i + 1]`` are those of text i; ``begin`` and
    ``end`` are their places in ``data`` (lower-cased UTF-8 bytes). A null text has none.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        data = _tables().lower[raw]
        inside = ~_tables().space[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.data, self.begin, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.begin, offsets)
        self.hashes = mix(_polynomials(data, self.begin, self.end) + (self.end - self.begin).astype(np.uint64))

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _polynomials(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of value * base^(place in the word) for each span, modulo 2^64, by prefix sums."""
    out, tables = np.zeros(len(begin), np.uint64), _tables()
    for at in range(0, max(len(data), 1), _STEP):
        part = data[at : at + _STEP]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(tables.value[part] * tables.up[: len(part)], out=sums[1:])
        lo, hi = np.searchsorted(end, at, "right"), np.searchsorted(begin, at + len(part), "left")
        b, e = begin[lo:hi], end[lo:hi]
        inner, outer = np.maximum(b - at, 0), np.minimum(e - at, len(part))
        piece = (sums[outer] - sums[inner]) * tables.down[inner]
        cut = np.flatnonzero(b < at)  # a word that began before this step: shift by what is gone
        for i in cut:
            piece[i : i + 1] *= np.uint64(pow(_BASE, int(at - b[i]), 1 << 64))
        out[lo:hi] += piece
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each text as sorted 64-bit hashes, and their bounds.

    A text with fewer words has its whole sequence as its only one; a text without words none.
    """
    counts = np.diff(words.bounds)
    h, multiplier = words.hashes, np.uint64(_BASE)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), per)
    ends = np.cumsum(per)
    place = np.arange(len(owner)) - np.repeat(ends - per, per) + words.bounds[:-1][owner]
    length = np.minimum(counts, size)[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(size):
        live = k < length
        value[live] = mix(value[live] * multiplier + h[place[live] + k] + np.uint64(k + 1))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))
