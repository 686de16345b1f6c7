"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, hashed into a fixed number of embedding rows; a
passage is the average of its words; a linear softmax over that average gives the class. A
text is as toxic as its worst passage of ``WINDOW`` words, so a long text does not drown a
few insults; training works on the worst passages too. As everything up to the softmax is
an average, a trained model folds into one number per n-gram row, and scoring a text is a
look-up per distinct word and a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import Words, mix, table

SIZES = (3, 4, 5)
ROWS = 1 << 18
WIDTH = 8
WINDOW = 3
EPOCHS = 5
BATCH = 64
LEAST_STEPS = 500
RATE = 0.5
PER_CLASS = 4000
WORDS = 1 << 14
THRESHOLD = 0.7


def word_grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the n-grams of each word, with ``<`` and ``>`` around it, and their bounds."""
    size = end - begin + 2
    stop = np.cumsum(size)
    start = stop - size
    inside = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(start, size)
    marked = data[np.clip(inside - 1 + np.repeat(begin, size), 0, max(len(data) - 1, 0))].astype(np.uint64) if len(data) else np.zeros(0, np.uint64)
    marked[start], marked[stop - 1] = 60, 62
    owners, rows = [], []
    word = np.repeat(np.arange(len(size)), size)
    room = np.repeat(stop, size) - np.arange(len(marked))
    for n in SIZES:
        at = np.flatnonzero(room >= n)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + marked[at + k]
        rows.append((mix(value) % np.uint64(ROWS)).astype(np.int32))
        owners.append(word[at])
    owner, row = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return row[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def _grams_of_many(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_grams`` of many words, a block at a time: its scratch space is tens of times its result."""
    parts = [word_grams(data, begin[i : i + WORDS], end[i : i + WORDS]) for i in range(0, len(begin), WORDS)]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(bounds) for _, bounds in parts)])
    return np.concatenate([np.zeros(0, np.int32), *(rows for rows, _ in parts)]), np.append(0, np.cumsum(sizes))


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the values between neighbouring bounds; 0 where there is none."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    n = np.diff(bounds).astype(float)
    out = total[bounds[1:]] - total[bounds[:-1]]
    return out / np.maximum(n, 1).reshape(-1, *[1] * (values.ndim - 1))


def _passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every passage of WINDOW words (a shorter text is one), and passage bounds by text."""
    words = np.diff(bounds)
    n = np.where(words > 0, np.maximum(1, words - WINDOW + 1), 0)
    ends = np.cumsum(n)
    begin = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(bounds[:-1], n)
    return begin, np.minimum(begin + WINDOW, np.repeat(bounds[1:], n)), np.append(0, ends)


@dataclass
class Model:
    """A trained model folded into one number per n-gram row, and the bias."""

    grams: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability that each text is toxic; an empty or null text gets the bias alone."""
        words = Words(texts)
        _, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        rows, bounds = word_grams(words.data, words.begin[first], words.end[first])
        worth = _means(self.grams[rows], bounds)[place]
        total = np.append(0.0, np.cumsum(worth))
        begin, end, by_text = _passages(words.bounds)
        passage = (total[end] - total[begin]) / np.maximum(end - begin, 1)
        worst = np.zeros(len(by_text) - 1)
        some = np.flatnonzero(np.diff(by_text))
        if len(some):
            worst[some] = np.maximum.reduceat(passage, by_text[some])
        return 1 / (1 + np.exp(-np.clip(worst + self.bias, -500, 500)))


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Train embeddings and softmax together by AdaGrad on the worst passage of each text."""
    rng = np.random.default_rng(seed)
    table_, softmax, bias = rng.normal(0, 0.1, (ROWS, WIDTH)), rng.normal(0, 0.5, (2, WIDTH)), np.zeros(2)
    seen, seen_softmax, seen_bias = np.full(ROWS, 1e-8), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)
    words = Words(texts)
    _, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
    rows, bounds = _grams_of_many(words.data, words.begin[first], words.end[first])
    usable = np.flatnonzero(np.diff(words.bounds))
    per_word = np.diff(bounds)
    batches = max(1, len(usable) // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // batches)) if len(usable) else 0):
        for batch in np.array_split(rng.permutation(usable), batches):
            spans = [np.arange(words.bounds[i], words.bounds[i + 1]) for i in batch]
            at = np.concatenate(spans) if spans else np.zeros(0, int)
            used, local = np.unique(place[at], return_inverse=True)
            n = per_word[used]
            gram_bounds = np.append(0, np.cumsum(n))
            grams = rows[np.arange(gram_bounds[-1]) - np.repeat(gram_bounds[:-1], n) + np.repeat(bounds[used], n)]
            fold = table_ @ (softmax[1] - softmax[0])
            total = np.append(0.0, np.cumsum(_means(fold[grams], gram_bounds)[local]))
            begin, end, by_text = _passages(np.append(0, np.cumsum([len(s) for s in spans])))
            worth = (total[end] - total[begin]) / (end - begin)
            top = np.array([a + int(np.argmax(worth[a:b])) for a, b in zip(by_text, by_text[1:])])
            # The chosen passages' words, and of each its n-grams.
            length = end[top] - begin[top]
            edge = np.append(0, np.cumsum(length))
            who = np.repeat(np.arange(len(top)), length)
            word = local[np.arange(edge[-1]) - edge[:-1][who] + begin[top][who]]
            m = n[word]
            gram_edge = np.append(0, np.cumsum(m))
            owner = np.repeat(np.arange(len(word)), m)
            touched = grams[np.arange(gram_edge[-1]) - gram_edge[:-1][owner] + gram_bounds[word][owner]]
            mean = _means(_means(table_[touched], gram_edge), edge)
            z = mean @ softmax.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = (p - np.eye(2)[labels[batch]]) / len(batch)
            to_mean = slope @ softmax
            g_softmax, g_bias = slope.T @ mean, slope.sum(0)
            seen_softmax += g_softmax**2
            seen_bias += g_bias**2
            softmax -= RATE * g_softmax / np.sqrt(seen_softmax)
            bias -= RATE * g_bias / np.sqrt(seen_bias)
            part = (to_mean[who] / (length[who] * np.maximum(m, 1))[:, None])[owner]
            hit, back = np.unique(touched, return_inverse=True)
            g = np.stack([np.bincount(back, part[:, k], len(hit)) for k in range(WIDTH)], axis=1)
            seen[hit] += (g**2).mean(1)
            table_[hit] -= RATE * g / np.sqrt(seen[hit])[:, None]
    return Model(table_ @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` documents of each class, the first by a hash of doc_id.

    ``labels(doc_id, toxic)`` holds the rows to learn from; a document with several labels
    is toxic if one of them says so; null labels and ids, and labels without a document, do
    not count. The fit runs in one task on that bounded sample. Without rows of either class
    the model has only a bias and says "not toxic".
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.max("toxic").alias("toxic_"))
    order = [F.xxhash64("id_"), F.col("id_")]
    some = one.filter("toxic_ >= 1").orderBy(*order).limit(per_class).unionByName(one.filter("toxic_ < 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("id_"), F.col("text").cast("string").alias("text"))
    # At most 2 * per_class small rows: that is what bounds the broadcast.
    sample = texts.join(F.broadcast(some), "id_").orderBy("id_", "text").limit(4 * per_class)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            rows = pa.Table.from_batches(got)
            y = rows["toxic_"].to_numpy().astype(int).clip(0, 1)
            model = fit(rows["text"].combine_chunks(), y) if 0 < y.sum() < len(y) else Model(np.zeros(ROWS), -3.0)
            yield pa.record_batch([pa.array([model.grams.astype("<f4").tobytes()]), pa.array([model.bias])], names=["grams", "bias"])

    row = sample.select("text", "toxic_").coalesce(1).mapInArrow(learn, "grams binary, bias double").first()
    return Model(np.frombuffer(row["grams"], "<f4").astype(float), row["bias"]) if row else Model(np.zeros(ROWS), -3.0)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``toxicity`` to every row of ``docs``, from the whole ``text`` alone.

    The model is one array of ``ROWS`` numbers, whatever the corpus is. Null and empty texts
    get the score of the bias; an existing column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.grams.astype(np.float32), model.bias))

    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, bias = sent.value
        for texts in columns:
            yield pd.Series(np.concatenate([Model(grams, bias).scores(pa.array(part, pa.string())) for part in _portions(texts)] or [np.zeros(0)]))

    return docs.withColumn("toxicity", F.pandas_udf(score, "double")(F.col("text").cast("string")))


def _portions(texts: pd.Series, chars: int = 1 << 20):
    """Runs of texts of about ``chars`` characters in all, so that memory is bounded."""
    size = np.cumsum([len(t) if t else 0 for t in texts]) // chars
    for k in np.unique(size):
        yield texts[size == k]


def learnable(labels: DataFrame) -> DataFrame:
    """The label rows that may be learned from: crc32 of doc_id as text, modulo 3, is not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs(doc_id, text)``.

    A null doc_id is never held out. Repeated rows are scored as often as they come.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = score_texts(docs.select("doc_id", "text"), train(docs, learnable(labels)))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, as ``labels.toxic`` marks them."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
