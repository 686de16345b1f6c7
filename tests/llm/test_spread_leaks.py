"""Leaks that have spread, and edited copies, against alignment of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weekloom.llm import decontaminate
from weekloom.llm.common import Words
from weekloom.llm.tokens import TextEncoder


def plain_score(item, text):
    """Smith-Waterman over words, as a share of the item's own score."""
    row, best = np.zeros(len(text) + 1), 0.0
    same = {w: np.array([2.0 if w == x else -1.0 for x in text]) for w in set(item)}
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + same[w])
        for j in range(1, len(new)):
            new[j] = max(new[j], new[j - 1] - 1)
        row, best = new, max(best, new.max())
    return best / (2 * len(item))


def edited(rng, words, share):
    return [f"e{rng.randrange(9999)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("share", [0.01, 0.03, 0.6])
def test_widespread_leaks_are_found(spark, share):
    rng = random.Random(11)
    soup = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 25))] for _ in range(12)]
    docs = []
    for i in range(300):
        words = soup(rng.randrange(5, 40))
        if rng.random() < share or i == 0:
            item = items[0] if rng.random() < 0.7 else rng.choice(items)
            kind = rng.randrange(3)
            copy = item if kind == 0 else edited(rng, item, 0.15) if kind == 1 else item[: -(-len(item) * 3 // 4)]
            words = words + copy + soup(5)
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(frame, bench).collect()}
    want = {}
    for i, text in docs:
        for k, item in enumerate(items):
            score = plain_score(item, text.split())
            seeds = {tuple(item[j : j + 3]) for j in range(len(item) - 2)} & {tuple(text.split()[j : j + 3]) for j in range(len(text.split()) - 2)}
            if score >= 0.5 and seeds:
                want[i, k] = score
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_several_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    items = ["one two three four five", "alpha beta gamma delta", "red green blue black white", "la le li lo lu", "ma me mi mo mu"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    long = " ".join(["filler"] * 200_000 + ["red green blue black white"] + ["filler"] * 200_000)
    docs = [(1, "x one two three four five"), (2, long), (3, "ma me mi mo mu " * 50), (4, "nothing here"), (None, "la le li lo lu")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 0), (2, 2), (3, 4), (None, 3)}


def test_bound_is_never_below_the_score():
    rng = random.Random(2)
    item = [f"w{rng.randrange(20)}" for _ in range(12)]
    texts = [" ".join(f"w{rng.randrange(20)}" for _ in range(30)) for _ in range(200)]
    bench, words = decontaminate.Benchmark([1], [" ".join(item)]), Words(pa.array(texts))
    found = np.array([[i, 0, words.bounds[i], words.bounds[i + 1]] for i in range(200)])
    score, _ = bench.align(words, found)
    assert (bench._words_held(words, found) >= score * len(item) - 1e-9).all()


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["Hello world", "don't", ""]
    own = TextEncoder(path)
    assert not own.cut
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
