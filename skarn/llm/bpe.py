"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_texts

#: Fixed values of the vocabulary's file format: splits of a text, and the sign of a word's end.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"
#: Words whose ids a task keeps, and words that are merged side by side.
KEPT_WORDS, TOGETHER = 400_000, 8192
#: Texts of more characters are split and joined so many words at a time.
LONG, SPAN = 1 << 20, 1 << 18
NONE = np.int64(1) << 40


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where printable in Latin-1, else the next above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def merge(symbols: np.ndarray, lookup) -> np.ndarray:
    """Merge rows of symbol ids (padded with -1) until no pair of neighbours can merge; merged rows, padded with -1.

    Each row is the leaves' level of a segment tree over its adjacent pairs: a leaf holds rank * width + place, every
    inner node the smaller of its two, so the root yields the leftmost pair of the lowest rank. A merge changes three
    leaves, and each change walks up one path of the tree. ``lookup(left, right)`` gives (rank or NONE, merged id).
    All rows take their next merge together.
    """
    n, wide = symbols.shape
    width = max(2, 1 << (wide - 1).bit_length())
    level = [np.full((n, width), NONE * width, np.int64)]
    rank, _ = lookup(symbols[:, :-1], symbols[:, 1:])
    level[0][:, : wide - 1] = np.where(rank < NONE, rank * width + np.arange(wide - 1), NONE * width)
    while level[-1].shape[1] > 1:
        level.append(np.minimum(level[-1][:, ::2], level[-1][:, 1::2]))
    symbols = symbols.copy()
    after = np.minimum(np.arange(1, wide + 1), wide) + np.zeros((n, 1), np.int64)
    before = np.arange(-1, wide - 1) + np.zeros((n, 1), np.int64)

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        level[0][rows, at] = values
        for low, high in zip(level, level[1:], strict=False):
            at = at >> 1
            high[rows, at] = np.minimum(low[rows, 2 * at], low[rows, 2 * at + 1])

    def rated(rows: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        right = np.where(nxt < wide, symbols[rows, np.minimum(nxt, wide - 1)], -1)
        rank, _ = lookup(symbols[rows, at], right)
        return np.where(rank < NONE, rank * width + at, NONE * width)

    rows = np.nonzero(level[-1][:, 0] < NONE * width)[0]
    while len(rows):
        at = level[-1][rows, 0] % width
        gone = after[rows, at]
        symbols[rows, at] = lookup(symbols[rows, at], symbols[rows, gone])[1]
        symbols[rows, gone] = -1
        nxt = after[rows, gone]
        after[rows, at] = nxt
        inside = nxt < wide
        before[rows[inside], nxt[inside]] = at[inside]
        put(rows, gone, np.full(len(rows), NONE * width))
        put(rows, at, rated(rows, at, nxt))
        left = before[rows, at]
        inside = left >= 0
        put(rows[inside], left[inside], rated(rows[inside], left[inside], at[inside]))
        rows = rows[level[-1][rows, 0] < NONE * width]
    return symbols


@dataclass
class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file's JSON text."""

    source: str

    def __post_init__(self) -> None:
        told = json.loads(self.source)
        vocab: dict[str, int] = told["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.base = 1 << max(vocab.values()).bit_length()
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        signs = byte_signs()
        self.inner = np.array([vocab.get(s, -1) for s in signs], np.int64)
        self.last = np.array([vocab.get(s + WORD_END, -1) for s in signs], np.int64)
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, at in [*vocab.items(), *self.added.items()]:
            self.tokens[at] = token

    @cached_property
    def specials(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.merged[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers. Words of like lengths are merged side by side."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        group = np.where(sizes <= 32, (sizes + 3) // 4, 8 + np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        out: list[bytes] = [b""] * len(words)
        for g in np.unique(group):
            rows = np.nonzero(group == g)[0]
            wide = int(sizes[rows].max())
            for some in chunks(rows, max(1, min(TOGETHER, (1 << 20) // wide))):
                flat = np.frombuffer(b"".join(coded[i].ljust(wide, b"\0") for i in some), np.uint8).reshape(len(some), wide)
                place, ends = np.arange(wide), sizes[some][:, None] - 1
                symbols = np.where(place < ends, self.inner[flat], np.where(place == ends, self.last[flat], -1))
                for i, row in zip(some, merge(symbols, self.lookup), strict=True):
                    out[i] = row[row >= 0].astype("<u4").tobytes()
        return out


class Coder:
    """Encodes and decodes texts; remembers the ids of up to ``KEPT_WORDS`` words."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.known = bpe, {}

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list(words)
        self.known.update(zip(new, self.bpe.encode_words(new), strict=True))

    def parts(self, text: str) -> list[str | bytes]:
        """The text as stretches without added tokens, normalised, and the ids of the added tokens between them."""
        added = self.bpe.added
        found = self.bpe.specials.split(text) if any(a in text for a in added) else [text]
        return [np.array(added[p], "<u4").tobytes() if p in added else unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in found]

    def _long(self, text: str) -> bytes:
        """Ids of a stretch of any length, some words at a time."""
        found, out = SPLIT.finditer(text), []
        while some := [m[0] for m in islice(found, SPAN)]:
            self.learn(set(some))
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; strings of added tokens are those tokens."""
        split = [[p if isinstance(p, bytes) or len(p) > LONG else SPLIT.findall(p) for p in self.parts(t)] for t in texts]
        out = [[self._long(p) if isinstance(p, str) else p for p in parts] for parts in split]
        self.learn(set().union(*(p for parts in out for p in parts if isinstance(p, list))))
        get = self.known.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined by spaces, as a vocabulary without a decoder has it."""
        return " ".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_vocabulary(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as file:
        return WordBpe(file.read())


def encode(docs: DataFrame, vocabulary_path: str, together: int = 256) -> DataFrame:
    """(doc_id, ids binary, decoded string) of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers and ``decoded`` is their decoding. A null or empty text has no
    ids. Repeated rows come back repeated, further columns are ignored, and an empty table gives an empty table. The
    vocabulary's tables, a few MB at any input size, travel to the tasks; texts are not shuffled.
    """
    return coded(docs, vocabulary_path, lambda ids, decoded: (ids, decoded), [("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")], together)


def coded(docs: DataFrame, vocabulary_path: str, take, columns: list[tuple[str, pa.DataType, str]], together: int = 256) -> DataFrame:
    """doc_id and what ``take(ids, decoded)`` makes of each text's ids and decoding, as ``columns`` (name, Arrow, SQL type)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    names = ["doc_id", *(c[0] for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, together):
                part = batch.slice(low, together)
                made = [take(ids, coder.decode(ids)) for ids in coder.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, c[1]) for x, c in zip(zip(*made, strict=True), columns, strict=True))], names=names)

    schema = ", ".join(["doc_id long", *(f"{c[0]} {c[2]}" for c in columns)])
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
