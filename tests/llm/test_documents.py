"""Near duplicates, leaks, toxicity, licences and pages against brute force and planted cases."""

import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekloom.llm import decontaminate, html_main, licenses, near_dup, toxicity
from weekloom.llm.common import Words, shingles

DOCS = "doc_id long, text string, bucket int, component string, score double"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], DOCS)


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def soup(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_words_and_shingles_match_plain_python():
    rng = random.Random(3)
    texts = ["", None, "One", "Ä b\tC  d", " lead and trail \n", "x" * 3_000_000 + " y", " ".join(soup(rng, 4000))] + ["".join(rng.choice("aB é\n") for _ in range(rng.randrange(40))) for _ in range(200)]
    words = Words(pa.array(texts))
    assert np.diff(words.bounds).tolist() == [len(words_of(t)) for t in texts]
    by_hash = defaultdict(set)
    for h, w in zip(words.hashes.tolist(), (w for t in texts for w in words_of(t))):
        by_hash[h].add(w)
    assert all(len(s) == 1 for s in by_hash.values())
    for size in (2, 5):
        _, bounds = shingles(words, size)
        assert np.diff(bounds).tolist() == [len(shingle_set(t, size)) for t in texts]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    rows, number = [(0, None), (1, ""), (2, " \n"), (3, "lone"), (4, "LONE"), (5, "two words")], 10
    for _ in range(25):
        base = soup(rng, rng.choice([3, 12, 60, 300]))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            rows.append((number, " ".join(copy)))
            number += 1
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, rows), size).collect()}
    want = brute_components(rows, size, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_divided_large_buckets_equal_brute_force(spark, monkeypatch):
    """A group too similar for its buckets to stay apart, and not similar enough to be one."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(11)
    base, rows = soup(rng, 120, 10_000), []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([4, 8, 11])):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "a b c")]
    got = near_dup.near_duplicates(docs(spark, rows), 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert near_dup.near_duplicates(docs(spark, []), 2).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for truth in (0.2, 0.5, 0.8, 0.95):
        n = 2000
        both = int(2 * n * truth / (1 + truth))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        values = np.concatenate([np.sort(pool[:n]), np.sort(np.append(pool[:both], pool[n : 2 * n - both]))])
        s = near_dup.sketch(values, np.array([0, n, 2 * n]))
        found = near_dup.similarity(s[:1], s[1:], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(found - truth) < 0.12


def test_similarity_and_sketches_take_bounded_memory():
    """One cell of a divided bucket may name 262,144 pairs; a batch may hold 10,000 short texts."""
    rng = np.random.default_rng(1)
    left, right = (rng.integers(0, 4, (40_000, near_dup.REGISTERS)).astype(np.int16) for _ in range(2))
    n = rng.integers(1, 99, 40_000).astype(float)
    tracemalloc.start()
    try:
        found = near_dup.similarity(left, right, n, n[::-1])
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    some = np.array([0, 2047, 2048, 39_999])
    assert near_dup.similarity(left[some], right[some], n[some], n[::-1][some]).tolist() == found[some].tolist()
    batch = pa.record_batch({"doc_id": pa.array(range(10_000)), "text": pa.array(["a b"] * 10_000)})
    parts = list(near_dup.text_portions(batch, 1))
    assert max(p.num_rows for p in parts) <= near_dup.ROWS
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10_000))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_leaks_finds_copies_and_edits_only(spark):
    rng = random.Random(5)
    items = [(i, " ".join(soup(rng, 30, 5000))) for i in range(5)] + [(5, None), (6, ""), (7, "tiny item"), (None, "no id")]
    edited = items[1][1].split()
    for k in (4, 13, 22):
        edited[k] = "changed"
    del edited[17]
    fill = lambda n: " ".join(soup(rng, n, 5000))
    rows = [
        (1, f"{fill(50)} {items[0][1]} {fill(9)}"),
        (2, f"{fill(5)} {' '.join(edited)}"),
        (3, items[2][1].upper().replace(" ", "!! ")),
        (4, fill(500)),
        (5, " ".join(items[3][1].split()[:6]) + " " + fill(80)),
        (6, None),
        (7, ""),
        (8, f"{fill(3)} tiny item {fill(3)}"),
        (10, "Tiny item."),
        (9, f"{items[4][1]} {fill(20)} {items[0][1]}"),
        (None, items[0][1]),
    ]
    rows += [(100 + i, f"{items[4][1]} {fill(10)}") for i in range(20)]  # one item in most documents
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    want = {(1, 0), (2, 1), (3, 2), (10, 7), (9, 4), (9, 0), (None, 0)} | {(100 + i, 4) for i in range(20)}
    assert set(got) == want
    assert got[1, 0].score == 1 and 0.6 < got[2, 1].score < 1 and got[3, 2].score == 1
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(9)
    for _ in range(20):
        item = soup(rng, rng.randrange(4, 25), 12)
        text = soup(rng, 10, 12) + item[: rng.randrange(3, len(item) + 1)] + soup(rng, 10, 12)
        bench, words = decontaminate.Benchmark([1], [" ".join(item)]), Words(pa.array([" ".join(text)]))
        score, _ = bench.align(words, np.array([[0, 0, 0, len(text)]]))
        best = np.zeros((len(item) + 1, len(text) + 1), int)
        for i, a in enumerate(item, 1):
            for j, b in enumerate(text, 1):
                best[i, j] = max(0, best[i - 1, j - 1] + (2 if a == b else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
        assert score[0] == best.max() / (2 * len(item))


def test_toxicity_generalises_to_unseen_spellings(spark):
    rng = random.Random(1)
    parts = "an be cor du el fin gar hol im jo ka lun mor ne op pri qua ras sel tor".split()
    spoken = lambda n: ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n)]
    bad = ["grumblax", "grumbley", "grumbloid", "grumbling", "grumbled", "grumbler"]
    rows, labels = [], []
    for i in range(400):
        w = spoken(rng.randrange(5, 80))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = " ".join(spoken(500))
    tests = [(0, f"{clean} grumblish {clean}"), (1, clean), (2, ""), (3, None), (4, "an"), (None, "lun morne")]
    got = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs(spark, tests), model).collect()}
    assert got[0] > 0.7 and max(v for i, v in got.items() if i != 0) < 0.7
    assert got[2] == got[3] and all(0 <= v <= 1 for v in got.values())


def test_toxicity_odd_tables(spark):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.classify(docs(spark, [(1, "a"), (None, "b"), (1, "a")]), no_labels).collect()
    assert len(out) == 3 and {r.predicted for r in out} == {0}
    odd = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs(spark, []), odd).count() == 0


def test_toxicity_held_out_accuracy(spark):
    """AUC on the held-out third of the small check tables' kind of text."""
    sf = "/root/testdata/sf0.1"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    en = read("documents").filter("lang = 'en'")  # there the labels follow the words
    got = toxicity.classify(en, read("labels")).filter("held_out").join(read("labels"), "doc_id").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert np.mean(np.searchsorted(np.sort(neg), pos) / len(neg)) > 0.95


def test_licenses_match_and_inherit(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", mit),
        ("a/b/x", "plain words"),
        ("a/b/c/LICENSE", apache),
        ("a/b/c/y", "plain words"),
        ("a/z", f"plain words of some length that go on and on\n{apache}"),
        ("q/x", None),
        (None, ""),
        ("a/d/both", f"{apache}\n{mit}"),
        ("a/e/about", "We talk of license fees and of much else besides, at length."),
        ("a/b/x", "plain words"),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, license string")
    got = sorted((r.path, r.license, r.origin) for r in licenses.scan_licenses(df).collect())
    assert got == sorted(
        [
            ("a/LICENSE", "MIT", "file"),
            ("a/b/x", "MIT", "inherited"),
            ("a/b/x", "MIT", "inherited"),
            ("a/b/c/LICENSE", "Apache-2.0", "file"),
            ("a/b/c/y", "Apache-2.0", "inherited"),
            ("a/z", "Apache-2.0", "header"),
            ("q/x", None, "none"),
            ("", None, "none"),
            ("a/d/both", "Apache-2.0", "file"),
            ("a/e/about", "MIT", "inherited"),
        ],
        key=lambda r: (r[0], r[1] or "", r[2]),
    )
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_main_text_of_varied_pages(spark):
    def page(i, body):
        return f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='menu'>m {i}</div>{body}<div id='comments'>c {i}</div><footer>f</footer></body></html>"

    own = [page(i, f"<div class='post'><h2>Head {i}</h2><p>First &amp; {i}<p>Two<br>lines<aside>no</aside><form>no</form></div>") for i in range(3)]
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(own)]
    rows += [(10, "http://one.org/", "<p>bare"), (11, None, None), (12, "x", ""), (13, "http://h.org/9", "<article>odd page</article>"), (14, "http://e.org", "<nav>only</nav>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.main_text(df).collect()}
    for i in range(3):
        assert got[i][0] == f"Head {i}\n\nFirst & {i}\n\nTwo lines"
    assert got[10] == ("bare", 4) and got[11] == got[12] == got[14] == ("", 0) and got[13] == ("odd page", 8)
    assert html_main.main_text(df.limit(0)).count() == 0


def test_main_text_deduces_the_template_of_neutral_names(spark):
    def page(i):
        body = f"<div class='c3'><h1>Head {i}</h1><p>All share this line.</p><p>{'word ' * (i + 3)}{i}</p></div>"
        return f"<body class='has-sidebar'><div class='a1'><p>Home</p><p>Contact</p></div>{body}<div class='b2'>Imprint of the house</div></body>"

    rows = [(i, f"http://n.org/{i}", page(i)) for i in range(20)]
    rows += [(100 + i, "http://same.org/", "<div>every page the same</div>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_text(df).collect()}
    for i in range(20):  # a line once on every page of a host cannot be told from its template
        assert got[i] == f"Head {i}\n\n{'word ' * (i + 3)}{i}"
    assert all(got[100 + i] == "every page the same" for i in range(8))


def test_main_text_leaves_out_optional_and_repeated_parts(spark):
    def page(i):
        offer = "<div class='q7'><p>Read our letter</p><p>Sign up now</p></div>" if i % 3 == 0 else ""
        twice = "".join(f"<div class='z1'><h4>Reply to this</h4><p>{i} {j} {'said ' * 9}</p></div>" for j in range(i % 4))
        again = "<p>A line that many share</p>" if i % 2 else ""
        return f"<body><div class='c3'><h1>Head {i}</h1><p>{f'own{i} ' * 80}</p>{again}{offer}{twice}</div></body>"

    rows = [(i, f"http://o.org/{i}", page(i)) for i in range(24)]
    # Copies of an article with elements of its own: what they share is no part of a template.
    copy = "<body><div class='c3'><section id='s{0}'><h1>Copied {0}</h1><div id='t{0}'>" + "text " * 80 + "</div></section><i>{1}</i></div></body>"
    rows += [(100 + 10 * a + i, f"http://o.org/c{a}/{i}", copy.format(a, i)) for a in range(2) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_text(df).collect()}
    for i in range(24):
        assert "Sign up" not in got[i] and "Read our" not in got[i] and "Reply to" not in got[i]
        assert got[i].startswith(f"Head {i}\n\nown{i} ") and ("A line that many share" in got[i]) == bool(i % 2)
        assert got[i].count("said") == 9 * (i % 4)
    for a in range(2):
        assert all(got[100 + 10 * a + i] == f"Copied {a}\n\n{('text ' * 80).strip()}\n\n{i}" for i in range(8))


def test_names_never_drop_an_ancestor_of_the_article():
    for name in ("has-sidebar", "single post-share", "main-menu-open", "page-header-fixed", "no-ads", "comments-open"):
        assert html_main.article(f"<body class='{name}'><main><p>plain</p></main></body>") == "plain"
        assert html_main.article(f"<div class='{name}'><p>plain</p></div><footer>f</footer>") == "plain"
    assert html_main.article("<div class='social'><article><p>long text</p><div class='share'>s</div></article></div><p>i</p>") == "long text"
    assert html_main.article("<form><p>all in a form</p></form>") == "all in a form"
    assert html_main.article("<main><p>a</p></main><div id=comments><article>b c d</article></div>") == "a"
    assert html_main.article("<ul><li><p>a<li>b</ul>a &lt; b < c<p title='>'>q</p><p don't>x</p>") == "a\n\nb\n\na < b < c\n\nq\n\nx"
    assert html_main.article("<head><title>t<p></title><body>a<!-- b") == "a"


@pytest.mark.parametrize("part", ["<a ", "<div>", "</div>", "<div>x", "<p title=\"", "<b c='>'", "<!--", "<script>", "<", "<div></p>", "<li>a", "<a =\"'"])
def test_broken_markup_takes_linear_time(part):
    import time

    begin = time.process_time()
    html_main.article(part * (1_000_000 // len(part)))
    assert time.process_time() - begin < 20  # squared time would be hours


def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    import html as h

    for r in html_main.main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S).group(1)
        parts = (" ".join(h.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pipeline_stages_keep_columns_and_drop_what_they_should(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    kept = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert after.columns == given.columns and after.count() <= kept.count()
        kept = after
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: " ".join(words_of(r.text)) for r in kept.collect()}
    assert not [i for i, t in left.items() if any(b in t for b in items)]
    packed = corpus_pipeline.pack(spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
