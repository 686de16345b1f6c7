"""Token ids of whole texts with a public tokenizer file, fast enough for a corpus."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weekloom.llm.common import kept

# Letters and digits of Latin-1, the characters that count as plain: fixed values.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What comes before the merges in the two kinds of file that are cut here: fixed values.
BYTE_KIND = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
WORD_KIND = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
CACHE_PIECES = 500_000
JOINED = 400
BREAK, LETTER, DIGIT, SPACE, OTHER = range(5)


def _classes() -> np.ndarray:
    """By Latin-1 character: letter, digit, space or other; the zero byte stands between texts."""
    chars = [chr(i) for i in range(256)]
    out = np.full(256, OTHER, np.uint8)
    for kind, pattern in ((LETTER, LETTERS), (DIGIT, DIGITS), (SPACE, r"\t\n\r ")):
        out[[i for i, c in enumerate(chars) if re.fullmatch(f"[{pattern}]", c)]] = kind
    out[0] = BREAK
    return out


def piece_starts(data: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces begin in plain Latin-1 texts that end with a zero byte each.

    With ``spaced`` a piece takes the one blank before it, and other white space but the last
    character is one piece; without, white space is a piece and each digit is one.
    """
    kind = kept("piece classes", _classes)[data]
    change = kind[1:] != kind[:-1]
    start = np.concatenate([np.ones(min(1, len(data)), bool), change]) | (kind == BREAK)
    if spaced:
        last = np.flatnonzero((kind[:-1] == SPACE) & change & (kind[1:] != BREAK))
        start[last] = True
        start[last[data[last] == 32] + 1] = False
    else:
        start |= kind == DIGIT
    quote = np.flatnonzero((data[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    for ending in CONTRACTIONS:
        hit = one == ord(ending[0])
        if len(ending) == 2:
            hit &= two == ord(ending[1])
        at = quote[hit]
        start[at + 1] = False
        after = at + 1 + len(ending)
        start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start)


class TextEncoder:
    """``encode_batch`` of a tokenizers file without special tokens.

    Both kinds of file known here split a text into pieces and encode each piece by itself.
    Many texts are cut at once, their pieces dictionary-encoded, and each distinct piece
    encoded once per worker (at most ``CACHE_PIECES`` are remembered); ids are then gathered.
    Texts with characters outside ``PLAIN``, or with ``<|``, go to the library whole; so do
    all texts of a file with any other normaliser or pre-tokenizer. The ids are the same.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = {part: spec.get(part) for part in ("normalizer", "pre_tokenizer")}
        self.lower = before == WORD_KIND
        self.cut = self.lower or before == BYTE_KIND
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.edge[i] = token.endswith("</w>") if self.lower else token.startswith("Ġ")
        self.newline = vocab.get("Ċ", -1)
        self.plain = bytes(i for i in range(256) if PLAIN.fullmatch(chr(i)))
        self._forget()

    def _forget(self) -> None:
        """Known pieces by number: ``flat[begin[i] : begin[i + 1]]`` are the ids of piece i."""
        self.number: dict[bytes, int] = {b"\0": 0}
        self.flat, self.begin = np.zeros(0, self.dtype), np.zeros(2, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._library(words)
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.array([len(x) for x in ids], np.int64)

    def _joined(self, words: list[str], glue: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and their numbers for many letter runs, encoded as few texts and cut at the marks between them."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._library([glue.join(g) for g in groups])):
            if glue == "\n":
                marks = np.flatnonzero(ids == self.newline)
                sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                ids = np.delete(ids, marks)
            else:
                marks = np.flatnonzero(self.edge[ids])
                sizes = np.diff(marks, prepend=-1) if self.lower else np.diff(np.append(marks, len(ids)))
            # as many as there are words, unless the file is another one; then the library encodes one by one
            yield (ids, sizes) if len(sizes) == len(group) else self._one_by_one(group)

    def _learn(self, new: list[bytes]) -> None:
        words = [w.decode("latin-1") for w in new]
        bare = [w for w in words if w.isalpha()]
        if self.lower:
            other, glue = [w for w in words if w.isspace()], " "
            parts = [(np.zeros(0, self.dtype), np.zeros(len(other), np.int64))]
        else:
            other, glue = [w for w in words if w[0] == " " and w[1:].isalpha()], "\n"
            parts = [*self._joined(other, "")]
        parts += self._joined(bare, glue)
        rest = list(set(words).difference(other, bare))
        parts.append(self._one_by_one(rest))
        names = (w.encode("latin-1") for part in (other, bare, rest) for w in part)
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(new))))
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.concatenate([sizes for _, sizes in parts])))

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain Latin-1 texts."""
        raw = b"\0".join([*texts, b""])
        data = np.frombuffer(raw, np.uint8)
        starts = piece_starts(data, not self.lower)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        ends = np.frombuffer(pieces.dictionary.buffers()[1], np.int32)[: len(pieces.dictionary) + 1].tolist()
        held = pieces.dictionary.buffers()[2].to_pybytes()
        names = [held[a:b] for a, b in zip(ends, ends[1:])]
        if len(self.number) > CACHE_PIECES:
            self._forget()
        new = [w for w in names if w not in self.number]
        if new:
            self._learn(new)
        piece = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))[pieces.indices.to_numpy()]
        begin = self.begin[piece]
        ends = np.cumsum(self.begin[piece + 1] - begin)
        sizes = np.diff(ends, prepend=0)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)]
        return np.split(ids, ends[data[starts] == 0][:-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text is empty."""
        texts = [t or "" for t in texts]
        plain: list[bytes | None] = []
        for t in texts:
            try:
                raw = (t.lower() if self.lower else t).encode("latin-1") if self.cut and "<|" not in t else None
            except UnicodeEncodeError:
                raw = None
            plain.append(None if raw is None or raw.translate(None, self.plain) else raw)
        cut = [p for p in plain if p is not None]
        own = iter(self._cut(cut) if cut else ())
        odd = iter(self._library([t for t, p in zip(texts, plain) if p is None]))
        return [next(odd) if p is None else next(own) for p in plain]


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker; kept from task to task."""
    return kept(("encoder", path), lambda: TextEncoder(path))


def encoded(path: str, texts: list[str | None], chars: int = 1 << 21) -> Iterator[np.ndarray]:
    """Ids text by text, ``chars`` characters of text in hand at a time."""
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto] or "") <= chars):
            held += len(texts[upto] or "")
            upto += 1
        yield from encoder(path).encode(texts[at:upto])
        at = upto
