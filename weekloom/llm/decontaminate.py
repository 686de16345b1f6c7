"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every document is scanned once for the three-word seeds of the benchmark. Seeds of one item
that lie on near diagonals of the document make a candidate passage, and one seed is enough.
A candidate that cannot reach the threshold, because too few of the item's words occur in
it, is left out; the others are aligned with the item word by word, so edited and paraphrased
copies score by what they share. Seeds are not weighed by how many documents hold them: a
leak that has spread makes its own seeds common.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import Words, kept, mix, table
from weekloom.llm.near_dup import text_portions

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
SLACK = 8
ITEMS = 20_000
ITEM_BYTES = 64 << 20
CANDIDATES = 20_000  # weighed at a time
HITS = "doc_id long, item_id long, score double, first_word long, last_word long"


def _seeds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed at each word, and whether it lies within one text."""
    h = words.hashes
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    value, owner = np.zeros(len(h), np.uint64), words.owners()
    last = np.minimum(np.arange(len(h)) + SEED - 1, words.bounds[1:][owner] - 1)
    for k in range(SEED):
        value = mix(value + h[np.minimum(np.arange(len(h)) + k, last)] + np.uint64(k))
    # A text with fewer words than a seed is one seed, the last word repeated.
    short = np.diff(words.bounds)[owner] < SEED
    whole = np.where(short, np.arange(len(h)) == words.bounds[:-1][owner], np.arange(len(h)) + SEED <= words.bounds[1:][owner])
    return value, whole


class Benchmark:
    """The items of one block: word hashes, and their seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = Words(pa.array(texts, pa.string()))
        self.ids, self.hashes, self.bounds = np.array(ids, np.int64), words.hashes, words.bounds
        value, whole = _seeds(words)
        at = np.flatnonzero(whole)
        order = np.argsort(value[at], kind="stable")
        self.seed, at = value[at][order], at[order]
        self.item = words.owners()[at] if len(at) else np.zeros(0, np.int64)
        self.place = at - self.bounds[self.item]
        self.distinct = np.unique(self.seed)
        self.vocabulary, self.word = np.unique(self.hashes, return_inverse=True)

    def present(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of the texts at which a seed begins, and the seed's number."""
        value, whole = _seeds(words)
        if not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.distinct, value), len(self.distinct) - 1)
        at = np.flatnonzero((self.distinct[k] == value) & whole)
        return at, k[at]

    def candidates(self, words: Words, threshold: float) -> np.ndarray:
        """Columns text, item, first and last word of passages that may reach the threshold, one per diagonal band."""
        at, k = self.present(words)
        lo, hi = np.searchsorted(self.seed, self.distinct[k]), np.searchsorted(self.seed, self.distinct[k], "right")
        n = hi - lo
        place = np.repeat(at, n)
        entry = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item, start = self.item[entry], place - self.place[entry]
        text = words.owners()[place] if len(place) else place
        order = np.lexsort((start, item, text))
        text, item, start = (x[order] for x in (text, item, start))
        if not len(text):
            return np.zeros((0, 4), np.int64)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > SLACK)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(text)) - 1
        size = np.diff(self.bounds)[item[head]]
        first = np.maximum(start[head] - SLACK, words.bounds[text[head]])
        last = np.minimum(start[tail] + size + SLACK, words.bounds[text[head] + 1])
        found = np.stack([text[head], item[head], first, last], axis=1)
        held = [self._words_held(words, part) for part in np.array_split(found, -(-len(found) // CANDIDATES))]
        return found[np.concatenate(held) >= threshold * size]

    def _words_held(self, words: Words, found: np.ndarray) -> np.ndarray:
        """For each candidate how many places of its item hold a word that occurs in its passage.

        No alignment has more matches, so none scores more than this as a share of the item.
        """

        def spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = end - begin
            owner = np.repeat(np.arange(len(n)), n)
            return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begin[owner]

        owner, place = spans(found[:, 2], found[:, 3])
        word = np.minimum(np.searchsorted(self.vocabulary, words.hashes[place]), len(self.vocabulary) - 1)
        known = self.vocabulary[word] == words.hashes[place]
        passage = np.unique(owner[known] * len(self.vocabulary) + word[known])
        owner, place = spans(self.bounds[found[:, 1]], self.bounds[found[:, 1] + 1])
        wanted = owner * len(self.vocabulary) + self.word[place]
        hit = passage[np.minimum(np.searchsorted(passage, wanted), len(passage) - 1)] == wanted
        return np.bincount(owner[hit], minlength=len(found))

    def align(self, words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best local alignment of each candidate's passage with its item: score, as a share of
        the item's full score, and the last passage word in it. Candidates of like size go together."""
        score, end = np.zeros(len(found)), np.zeros(len(found), np.int64)
        if not len(found):
            return score, end
        width, height = found[:, 3] - found[:, 2], np.diff(self.bounds)[found[:, 1]]
        order = np.lexsort((height, width))
        for part in np.array_split(order, max(1, int((width * 1).sum()) // 200_000)):
            if not len(part):
                continue
            w, h = int(width[part].max()), int(height[part].max())
            column = np.arange(w)[None, :]
            passage = np.where(column < width[part, None], words.hashes[np.minimum(found[part, 2, None] + column, len(words.hashes) - 1)], np.uint64(0))
            row = np.zeros((len(part), w + 1), np.int32)
            best, best_end = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            drop = (np.arange(w + 1) * -GAP).astype(np.int32)
            for i in range(h):
                live = i < height[part]
                word = self.hashes[np.minimum(self.bounds[found[part, 1]] + i, len(self.hashes) - 1)]
                same = np.where(passage == word[:, None], MATCH, MISMATCH)
                new = np.maximum(row + GAP, 0)
                new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + same)
                new = np.maximum.accumulate(new + drop, axis=1) - drop  # gaps along the passage
                row = np.where(live[:, None], new, row)
                top = row.argmax(1)
                value = row[np.arange(len(part)), top]
                better = live & (value > best)
                best, best_end = np.where(better, value, best), np.where(better, top, best_end)
            score[part] = best / (MATCH * np.maximum(height[part], 1))
            end[part] = found[part, 2] + best_end
        return score, end


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str | None]]]:
    """The benchmark in blocks of at most ITEMS items and about ITEM_BYTES, one at a time."""
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        if ids and (len(ids) >= ITEMS or size + len(r["text"] or "") * 4 > ITEM_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "") * 4
    if ids:
        yield ids, texts


def _folded(text):
    """Lower case without ASCII punctuation, so that case and marks do not hide a copy."""
    return F.regexp_replace(F.lower(text.cast("string")), r"\p{Punct}+", "")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word and last_word of every leak in ``docs(doc_id, text)``.

    ``benchmark(item_id, text)`` is taken in blocks of bounded size, each of which is sent to
    the workers and met by all documents. ``score`` is the alignment score as a share of the
    item's own (1 is a copy, up to case and punctuation); the best passage of a document and item counts. Null or
    blank texts, and items without id, match nothing; an item of fewer words than a seed is
    looked for only as a whole text, for in a longer one it proves nothing. Documents without id give rows with a
    null doc_id. Repeated rows and items give a row each time. An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _folded(F.col("text")).alias("text"))
    parts = []
    for ids, texts in _blocks(benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _folded(F.col("text")).alias("text"))):
        sent = sc.broadcast((uuid.uuid4().hex, ids, texts))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            name, ids, texts = sent.value
            items = kept(("benchmark", name), lambda: Benchmark(ids, texts))
            for batch in (part for b in batches for part in text_portions(b, 1)):
                words = Words(batch.column(1))
                found = items.candidates(words, threshold)
                score, end = items.align(words, found)
                keep = np.flatnonzero(score >= threshold)
                keep = keep[np.lexsort((found[keep, 2], -score[keep], found[keep, 1], found[keep, 0]))]
                pair = found[keep, :2]
                best = np.ones(len(keep), bool)
                best[1:] = (pair[1:] != pair[:-1]).any(1)
                keep = keep[best]
                base = words.bounds[found[keep, 0]]
                columns = [batch.column(0).take(pa.array(found[keep, 0])), pa.array(items.ids[found[keep, 1]]), pa.array(score[keep]), pa.array(found[keep, 2] - base), pa.array(end[keep] - base)]
                yield pa.record_batch(columns, names=["doc_id", "item_id", "score", "first_word", "last_word"])

        parts.append(text.mapInArrow(find, HITS))
    if not parts:
        return docs.sparkSession.createDataFrame([], HITS)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
