"""Names by corpus case statistics, and dense text vectors, against plain twins."""

import itertools

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from weekloom.operators import latent, people


def plain_best(words, links):
    """The largest sum over all splits into names of up to three joinable words."""
    totals = []
    for cuts in itertools.product((False, True), repeat=max(len(words) - 1, 0)):
        ends = [i + 1 for i, cut in enumerate(cuts) if cut] + [len(words)]
        begins = [0, *ends[:-1]]
        inner = [i for b, e in zip(begins, ends) for i in range(b, e - 1)]
        if all(e - b <= 3 for b, e in zip(begins, ends)) and all(links[i] for i in inner):
            totals.append(sum(links[i] for i in inner))
    return max(totals)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=9))
def test_split_is_the_best_of_all(links):
    words = [f"w{i}" for i in range(len(links))]
    got = people.best_split(words, links)
    assert " ".join(got).split() == words and all(len(n.split()) <= 3 for n in got)
    inner, at = 0, 0
    for name in got:
        n = len(name.split())
        inner += sum(links[at : at + n - 1])
        assert all(links[at : at + n - 1])
        at += n
    assert inner == plain_best(words, links)


def test_names_of_a_corpus(spark):
    texts = [
        "Yesterday Bukayo Saka met Declan Rice. The fans sang",
        "the fans met Bukayo Saka, the captain! Yesterday all of the fans met Pelé",
        "They said Pelé Bukayo Saka. Declan Rice wrote to the iPhone of Jan van Dijk\nFans sang yesterday",
        None,
        "",
    ]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g int, full_text string")
    want = {
        (0, "bukayo saka"): 2, (0, "declan rice"): 2, (0, "pelé"): 1, (0, "jan"): 1, (0, "dijk"): 1,
        (1, "bukayo saka"): 1, (1, "pelé"): 1,
    }
    for corpus in (None, df):
        got = {(r["g"], r["keyword"]): r["cnt"] for r in people.people_names(df, ["g"], corpus=corpus).collect()}
        assert got == want
    assert people.people_names(df.limit(0), ["g"]).count() == 0


def test_vectors_span_the_strongest_directions(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{k}w{int(w)}" for w in rng.integers(0, 9, 12) for k in [i % 3]) + f" x{i % 7}" for i in range(80)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "article_id long, full_text string")
    model = latent.fit_encoder(df, dim=3, buckets=256, oversample=12, rounds=8)
    lists = df.select(latent.hashed_words(df["full_text"], 256).alias("w")).collect()
    x = np.zeros((len(texts), 256))
    for i, r in enumerate(lists):
        np.add.at(x[i], r["w"], 1.0)
    n = (x > 0).sum(0)
    x = x * np.where(n > 0, np.log((1 + len(texts)) / (1 + n)) + 1, 0)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    _, values, right = np.linalg.svd(x)
    assert np.allclose(model.values, values[:3], atol=1e-6)
    assert np.allclose(model.components @ model.components.T, right[:3].T @ right[:3], atol=1e-4)
    got = np.array([r["embedding"] for r in model.embed(df).orderBy("article_id").collect()])
    assert got.shape == (82, 3) and not got[80:].any() and np.allclose(np.linalg.norm(got[:80], axis=1), 1)
    empty = latent.fit_encoder(df.limit(0), dim=3, buckets=64)
    assert empty.embed(df).count() == 82 and empty.components.shape == (64, 3)
