"""Token files, packing, top-k, URL rules and chats against brute force and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weekloom.llm import chat, packing, token_files, topk, url_filter
from weekloom.llm.tokens import TextEncoder

TEXTS = ["", None, "Hello world", "don't  stop\n\nnow", "É à ß ñ Ünï", "x" * 5000, "日本語 and Σίσυφος ΑΣ", "<|endoftext|> in text", "a\u0301 e\u200b\xa0b", "1 22 333 ½ ²", "tab\tand\r\n", "İstanbul", "\x0b\x1c odd"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_ids(name):
    path, rng = public_tokenizers.path(name), random.Random(2)
    plain = "abcXYZ éÉñß ''sS.,!?  \t\n09½"
    texts = TEXTS + ["".join(rng.choice(plain) for _ in range(rng.randrange(60))) for _ in range(500)]
    library, own = Tokenizer.from_file(path), TextEncoder(path)
    for _ in range(2):  # the second time from what is kept
        for text, ids in zip(texts, own.encode(texts)):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def docs(spark):
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(TEXTS)] + [(3, "again", 1, 2, "x"), (None, "no id", 1, 2, "x"), (2, "Hello world", 1, 2, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, length int, rank string")


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    frame = docs(spark)
    manifest = token_files.write_sequences(frame, path, f"file://{tmp_path}", sequence=64)
    got = sorted(token_files.documents_from_files(manifest).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for r, want in zip(got, order, strict=True):
        ids = np.array(library.encode(want.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_documents(frame.limit(0), path, f"file://{tmp_path}/none").count() == 0


def test_packing_places_every_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    frame = docs(spark)
    got = packing.pack_documents(frame, path, capacity=64).toPandas()
    for i, text in enumerate(TEXTS):
        if i in (2, 3):
            continue
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 64].tobytes()) for k in range(0, len(ids), 64)]
        assert own.start.tolist() == list(range(0, len(ids), 64)) and own.length.sum() == len(ids)
    assert len(got[got.doc_id == 2]) == 2 and got.doc_id.isna().sum() == 1
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack_documents(frame.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    n = rng.choice([50, 3000, 60000])
    lengths = np.clip(rng.lognormal(5.5, 1, n), 1, 2048).astype(int)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.pack_plan(dict(zip(values.tolist(), counts.tolist())))
    bound = -(-int(lengths.sum()) // 2048)
    assert bound <= plan.sequences <= bound + max(2, bound // 100)
    used = np.zeros(plan.sequences, int)
    for v, c in zip(values, counts):
        sequence, offset = plan.places(np.full(c, v), np.arange(c))
        np.add.at(used, sequence, v)
        assert (offset + v <= 2048).all()
    assert used.max() <= 2048 and used.sum() == lengths.sum()
    big = [1025] * 7 + [1024] * 3
    assert packing.pack_plan({1025: 7, 1024: 3}).sequences == 9 and len(big) == 10


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS_IN_CELL", 50)
    monkeypatch.setattr(topk, "QUERIES_IN_CELL", 7)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 260)]
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, []), (None, [0.5] * 6), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, query long, rank int")
    vectors = topk.integer_vectors(df)
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect())
    clean = {r.vec_id: list(r.vec) for r in vectors.collect()}
    want = []
    for q, a in clean.items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean.items() if i != q and len(a) == len(b))[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and len(clean) == 261
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0
    few = vectors.filter("vec_id < 5")
    assert topk.top_k(few, few, 20).count() == 20


def test_url_rules(spark):
    urls = {
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "http://EXAMPLE.org/es/1?q=/": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://m.example.org/en/17#f": ("m.example.org", "/en/17", "example.org/en/1", "block"),
        "http://m.example.org/en/27": ("m.example.org", "/en/27", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/en/": ("x.com", "/en/", None, "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://b.org?x://c/": ("b.org", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] * 2, "page_id int, url string, verdict string, host string")
    got = url_filter.filter_urls(df, url_filter.RULES).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url]
    assert url_filter.filter_urls(df, []).filter("rule is not null").count() == 0
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


def test_url_index_tells_colliding_digests_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 1)
    index = url_filter._Index.__new__(url_filter._Index)
    keys = [b"a.org/", b"b.org/", b"c.org/"]
    index.digests, index.offsets = np.ones(3, np.uint64), np.array([0, 6, 12, 18])
    index.strings, index.blocks = np.frombuffer(b"".join(keys), np.uint8), np.zeros(3, np.uint8)
    assert index.find([b"c.org/", b"x.org/", b"a.org/"]).tolist() == [2, -1, 0]


def test_chat_escapes_and_round_trips(spark):
    hard = ["</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "<<SYS>>", "[[INST]]", "a\\", "", None, "line\nbreak", "<s><s>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)]
    rows += [(2, None, "tool", "x"), (2, 5, None, "y"), (2, 5, None, "y"), (None, 0, "user", "alone"), (3, 700, "assistant", "b"), (3, 2, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, part int, slice string")
    segments = chat.format_chats(df)
    texts = [r.text for r in segments.filter("part = 1").collect()]
    assert not [t for t in texts if any(c in t for c in chat.Template().controls)]
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    import hashlib

    one = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(hard)])
    loss = "".join(t or "" for _, _, r, t in rows[: len(hard)] if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256, got[1].loss_chars) == (len(hard), sha(one), sha(loss), len(loss))
    assert got[1].valid and not got[2].valid and got[2].n_turns == 3 and not got[None].valid
    assert got[3].valid and got[3].turns_sha256 == sha("user\na\nassistant\nb\n")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_roles_are_told_by_their_marks_and_null_turns_come_first(spark):
    import hashlib

    odd = ["tool", "function", "", "</s>", "a\nb", "\\", "[INST] ", "x\\\n"]
    rows = [(1, i - 5000, r, f"t{i}") for i, r in enumerate(odd)] + [(1, None, "user", "first")]
    segments = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.read_back(segments.withColumn("role", F.lit("lost"))).collect()[0]
    plain = "user\nfirst\n" + "".join(f"{r}\nt{i}\n" for i, r in enumerate(odd))
    assert got.turns_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    marks = [r.text for r in segments.filter("part = 0").collect()]
    assert len(set(marks)) == len(odd) + 1
