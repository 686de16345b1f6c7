"""Vector codes, the source audit and exact duplicates against brute force and planted cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weekloom.llm import exact_dedup, source_audit, vector_codes

NAN, INF = float("nan"), float("inf")


# ---- exact duplicates --------------------------------------------------------------------


@pytest.mark.parametrize("low, high", [(0, 1 << 20), (5000, 1 << 57), (0, 1 << 64)])
def test_golomb_codes_round_trip(low, high):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 3000):
        values = np.unique(rng.integers(low, high, n, np.uint64, endpoint=False))
        code = exact_dedup.golomb_encode(values, low, high)
        assert (exact_dedup.golomb_decode(code, len(values), low, high) == values).all()
    dense = np.arange(10, dtype=np.uint64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(dense, 0, 10), 10, 0, 10) == dense).all()
    sparse = np.unique(rng.integers(0, 1 << 26, 1 << 16, np.uint64))
    assert len(exact_dedup.golomb_encode(sparse, 0, 1 << 26)) * 8 < 12 * len(sparse)  # not 64 bits each


def classes(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return Counter(out), len(groups)


DOCS = "doc_id long, text string, key int, place string, chunk double, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5, 2) for i, t in rows], DOCS)


def dedup_rows():
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(150)}") for i in range(400)] + [(1000 + i, "hot") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " "), (None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (8, "again")]
    rows += [(3000, "long " * 300_000), (3001, "long " * 300_000), (3002, "long " * 300_000 + "!"), (None, "text 3")]
    return rows


@pytest.mark.parametrize("from_files", [True, False])
def test_exact_duplicates_equal_brute_force(spark, tmp_path, from_files, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PIECE", 64)
    monkeypatch.setattr(exact_dedup, "CHUNK_BITS", 6)
    rows = dedup_rows()
    docs = frame(spark, rows).repartition(5)
    if from_files:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    got = exact_dedup.exact_duplicates(docs).collect()
    want, groups = classes(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})  # one row each, of repeated rows too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_with_colliding_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", 0)  # many texts become suspects for nothing
    rows = [(i, f"t{i}") for i in range(200)] + [(500, "t3")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert got.pop(500) == (500, 2) and got.pop(3) == (500, 2) and all(v == (i, 1) for i, v in got.items())


def test_exact_duplicates_of_small_tables(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    one = exact_dedup.exact_duplicates(frame(spark, [(1, None)])).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in one] == [(1, 1, 1, True)]


def test_unfinished_bitmaps_are_passed_over(tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    whole = zlib.compress(np.packbits(np.arange(64) == 3).tobytes())
    (folder / "a").write_bytes(whole[:5])
    (folder / "b").write_bytes(whole)
    assert np.flatnonzero(exact_dedup._bitmap(f"file://{tmp_path}", "c")).tolist() == [3]
    os.remove(folder / "b")
    with pytest.raises(FileNotFoundError):
        exact_dedup._bitmap(f"file://{tmp_path}", "c")


# ---- vector codes ------------------------------------------------------------------------


def test_candidates_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for width in (1, 2, 16, 64):
        book = rng.integers(-60, 60, (20, 3))
        book[7] = book[2]  # equal entries: the lower one counts
        points = rng.integers(-100, 100, (5000, 3))
        entry, distance = vector_codes.Cells(book, width).nearest(points)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_cells_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(vector_codes, "CELLS_HELD", 30)
    rng = np.random.default_rng(4)
    book, wide = rng.integers(-60, 60, (9, 2)), rng.integers(-60, 60, (9, 40))
    cells = vector_codes.Cells(book, 8)
    for _ in range(5):
        points = rng.integers(-100, 100, (300, 2))
        assert (cells.nearest(points)[0] == ((points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)).all()
    points = rng.integers(-100, 100, (50, 40))  # too long for one integer per cell
    assert (vector_codes.Cells(wide, 8).nearest(points)[0] == ((points[:, None] - wide) ** 2).sum(axis=2).argmin(axis=1)).all()


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v], c) for i, v, c in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max(len(v) for _, v, _ in kept) // parts)
    x = np.array([v + [0] * (parts * size - len(v)) for _, v, _ in kept]).reshape(len(kept), parts, size)
    order = sorted((i, v, at) for at, (i, v, _) in enumerate(kept) if i is not None)[:entries]
    books = [[x[at, p].tolist() for *_, at in order] for p in range(parts)]

    def nearest(p, point):
        return min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(point, books[p][e])), e))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(p, x[at, p].tolist()) for at in range(len(x))]
            for e in range(len(books[p])):
                own = x[[f == e for f in found], p]
                if len(own):
                    books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    out, totals = [], Counter()
    for at, (i, _, c) in enumerate(kept):
        found = [nearest(p, x[at, p].tolist()) for p in range(parts)]
        error = sum(sum((a - b) ** 2 for a, b in zip(x[at, p].tolist(), books[p][e])) for p, e in enumerate(found))
        totals[c] += error
        out.append((i, "".join(f"{e:02x}" for e in found), error, c))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((i, code, error, totals[c], digest) for i, code, error, c in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string, salt int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 9) for i, v, c in rows], VECTORS).repartition(3)


def codes(df, **how):
    return Counter(tuple(r) for r in vector_codes.vector_codes(df, **how).collect())


def test_vector_codes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(7)], rng.choice([0, 1, None])) for i in range(80)]
    rows += [(200 + i, [0.25] * 7, 5) for i in range(60)]  # a hot vector and label
    rows += [(3, [0.5] * 7, 1), (None, [0.1] * 7, 1), (300, None, 1), (301, [0.1, None], 1), (302, [NAN, 0.1], 1), (303, [INF], 1), (304, [], 1), (305, [0.2] * 3, None)]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert codes(vectors(spark, rows), parts=4, entries=6, scale=256.0) == brute_codes(rows, 4, 6, 2, 256)
    few = rows[:3]
    assert codes(vectors(spark, few), parts=4) == brute_codes(few, 4, 64, 2, 256)


def test_vector_codes_of_odd_tables(spark):
    assert not codes(vectors(spark, []))
    assert not codes(vectors(spark, [(None, [0.5] * 16, 1), (1, None, 1)]))
    huge = vector_codes.vector_codes(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)])).collect()
    assert len(huge) == 3 and all(r.error >= 0 for r in huge)


# ---- source audit ------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_audit(rows, least, top):
    counts, docs, pool = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        pool.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g for g, _ in pool}:
        terms = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in pool if g == lang)

        def shares(counter):
            total = sum(counter[t] for t in terms)
            return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * len(terms)) for t in terms}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            over = [(f(p[s][t], q[t]), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "aé日Zq" for b in ("", "x", "bcdefg", "bcdefgh", "bcdefghi", "bcdefghijklmno", "bcdefghijklmnop", "y" * 16, "y" * 17, "z" * 40)]
    rows = []
    for i in range(160):
        source = rng.choice(["s1", "s2", "s2", "s2", "s3", None])
        bias = {"s1": 20, "s2": 50, "s3": 35}.get(source, 50)
        rows.append((rng.choice([" ", "-", "1", "\n"]).join(rng.choice(words[:bias]) for _ in range(rng.randrange(12))), rng.choice(["en", "en", "fr", None]), source))
    rows += [("", "de", "s1"), (None, "de", "s2"), ("x" * 400_000 + " aX " * 3, "en", "s1"), ("aX", "en", "long")] + [rows[3]] * 9
    return rows


@pytest.mark.parametrize("cell", [(1024, 128), (7, 2)])
def test_source_audit_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(source_audit, "PORTION", 1500)
    monkeypatch.setattr(source_audit, "TERMS_IN_CELL", cell[0])
    monkeypatch.setattr(source_audit, "SOURCES_IN_CELL", cell[1])
    rows = audit_rows()
    df = spark.createDataFrame([(t, g, s, 1, "x", 2) for t, g, s in rows], "text string, lang string, source string, n int, term string, salt int")
    got = sorted(tuple(r) for r in source_audit.source_audit(df.repartition(4), least_docs=4, top_terms=5).collect())
    assert got == brute_audit(rows, 4, 5)
    assert source_audit.source_audit(df.limit(0)).count() == 0


def test_terms_are_counted_in_order_of_their_words():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 3, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64) >> np.uint64(40)]
    assert (source_audit.radix_order(columns) == np.lexsort(columns[::-1])).all()
    texts = ["", "A a b", "ab" * 9 + " a", "É é 日本 x1y"]
    group, terms, n, docs = source_audit.count_terms(pa.array(texts, pa.large_string()).cast(pa.large_binary()), np.array([5, 5, 5, 6]))
    want = Counter()
    for owner, text in zip([5, 5, 5, 6], texts):
        want.update((owner, t) for t in terms_of(text))
    assert {(g, t): c for g, t, c in zip(group.tolist(), terms.to_pylist(), n.tolist())} == want
    assert dict(zip(zip(group.tolist(), terms.to_pylist()), docs.tolist()))[5, "a"] == 2
