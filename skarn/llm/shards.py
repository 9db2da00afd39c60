"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse index, a Bloom filter and a footer.

A shard is, in order: data blocks; the index block; the Bloom filter; the footer. All integers are little-endian.

* Key of a document: one byte 1 and the doc_id as eight big-endian bytes with its sign bit turned, so that byte order
  is doc_id order; the empty key for a null doc_id.
* Entry: length of the prefix shared with the key before (1 byte), length of the rest (1 byte), number of ids
  (8 bytes), rest of the key, ids of ``width`` bytes each.
* Block: zstd of its entries; the first entry shares nothing. A document's ids are never split.
* Index: zstd of, for each block, offset (8), size (8), ids of the shard before it (8), entries (4), width of an id
  (1: 2 or 4 bytes), length of the first key (1), first key.
* Bloom filter: ``HASHES`` bits for each key in a bit array, from the two halves of XXH3-128.
* Footer: offset and size of index and of filter, blocks, entries, ids (7 times 8 bytes), and ``MAGIC``.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh_path, written

MAGIC = b"SKSSTB01"
ENTRY, INDEX, FOOTER = struct.Struct("<BBQ"), struct.Struct("<QQQIBB"), struct.Struct("<7Q8s")
#: Bytes of a block before compression; bits and hashes of the Bloom filter for each key.
BLOCK_BYTES, BLOOM_BITS, HASHES = 1 << 18, 10, 7
#: Fixed value: how the vocabulary's library splits a text before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same split where ``RARE`` finds nothing: there its classes are these ranges, which the standard library scans faster.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1"
COMMON = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
RARE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u02c2-\u200f\u2028-\u202f\u205f-\U0010ffff]")
#: Pieces that the library splits off again wherever they follow one another.
PLAIN = re.compile(rf" [{LETTERS}]+")
#: Pieces whose ids a task keeps; characters above which a text is split piecewise; pieces joined at once.
KEPT, LONG, SPAN = 400_000, 1 << 20, 1 << 18


class Encoder:
    """The library's ids of texts, as little-endian unsigned 32-bit integers.

    The library's merges never cross the pieces that ``SPLIT`` gives, so it is asked once for each distinct piece, for
    many at a time, and texts are put together from the ids of their pieces.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t.content: np.uint32(i).tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = list(map(len, vocab))  # a byte-level token has a sign for each byte
        self.known, self.kept = {}, kept

    def _plain(self, pieces: list[str]) -> None:
        """Learn pieces that stay apart when joined: their ids are told apart by the bytes that they cover."""
        for some in chunks(pieces, 256 * 16):
            rows = list(chunks(some, 256))
            for row, found in zip(rows, self.library.encode_batch_fast(list(map("".join, rows)), add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                ends = np.cumsum(np.fromiter((len(p.encode()) for p in row), np.int64, len(row)))
                cuts = ((np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * 4).tolist()
                held = ids.tobytes()
                self.known.update(zip(row, map(held.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
        self._plain(list(filter(PLAIN.fullmatch, new)))
        for some in chunks(list(filterfalse(PLAIN.fullmatch, new)), 4096):
            found = self.library.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((p, struct.pack(f"<{len(e)}I", *e.ids)) for p, e in zip(some, found, strict=True))

    def _together(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces; the pieces not yet known are learnt for all lists at once."""
        found = [list(map(self.known.get, pieces)) for pieces in lists]
        holes = []
        for pieces, ids in zip(lists, found, strict=True):
            at, i = [], -1
            with suppress(ValueError):
                while True:
                    at.append(i := ids.index(None, i + 1))
            holes.append(at)
        self._learn({pieces[i] for pieces, at in zip(lists, holes, strict=True) for i in at})
        for pieces, ids, at in zip(lists, found, holes, strict=True):
            for i in at:
                ids[i] = self.known[pieces[i]]
        return list(map(b"".join, found))

    def _long(self, text: str) -> bytes:
        found, out = SPLIT.finditer(text), []
        while some := [m[0] for m in islice(found, SPAN)]:
            out += self._together([some])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list] = []
        for text in texts:
            parts = self.specials.split(text) if any(a in text for a in self.added) else [text]
            out.append([self.added.get(p) or (self._long(p) if len(p) > LONG else (SPLIT if RARE.search(p) else COMMON).findall(p)) for p in parts])
        lists = [p for parts in out for p in parts if isinstance(p, list)]
        ids = iter(self._together(lists))
        return [b"".join(p if isinstance(p, bytes) else next(ids) for p in parts) for parts in out]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, with all that it has learnt in earlier tasks."""
    return Encoder(path)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key else None


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a path or URI in the shared folder."""
    path = re.sub(r"^file:/+", "/", path)
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard from entries in key order; holds one block and the keys' hashes in memory."""

    def __init__(self, path: str) -> None:
        fs, path = _filesystem(path)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.at = fs.open_output_stream(path), 0
        self.packer = zstandard.ZstdCompressor(level=3)
        self.index, self.hashes, self.rows, self.held = [], [], [], 0
        self.entries = self.ids = self.block_ids = 0

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        self.rows.append((key, ids))
        self.hashes.append(key)
        self.held += len(ids)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.rows:
            return
        every = np.frombuffer(b"".join([ids for _, ids in self.rows]), "<u4")
        wide = bool(len(every)) and int(every.max()) >= 1 << 16
        held, width = (every if wide else every.astype("<u2")).tobytes(), 4 if wide else 2
        parts, last, at = [], b"", 0
        for key, ids in self.rows:
            n, shared = len(ids) // 4, 0
            while shared < len(key) and shared < len(last) and key[shared] == last[shared]:
                shared += 1
            parts += [ENTRY.pack(shared, len(key) - shared, n), key[shared:], held[at : (at := at + n * width)]]
            last = key
        self.ids += len(every)
        offset, size = self._put(self.packer.compress(b"".join(parts)))
        first = self.rows[0][0]
        self.index.append(INDEX.pack(offset, size, self.block_ids, len(self.rows), width, len(first)) + first)
        self.entries += len(self.rows)
        self.block_ids, self.rows, self.held = self.ids, [], 0

    def close(self) -> None:
        self._flush()
        index = self._put(self.packer.compress(b"".join(self.index)))
        bits = max(64, -(-len(self.hashes) * BLOOM_BITS // 64) * 64)
        bloom = np.zeros(bits, bool)
        for key in self.hashes:
            bloom[_places(key, bits)] = True
        bloom = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(*index, *bloom, len(self.index), self.entries, self.ids, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard: all entries in order, or one key by Bloom filter, binary search of the index and one block."""

    def __init__(self, path: str) -> None:
        fs, path = _filesystem(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < FOOTER.size or (foot := FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size)))[-1] != MAGIC:
            raise ValueError(f"{path} is no complete shard")
        self.bloom = self.file.read_at(foot[3], foot[2])
        self.entries, self.ids = foot[5], foot[6]
        packed, at, self.index = zstandard.decompress(self.file.read_at(foot[1], foot[0])), 0, []
        while at < len(packed):
            *told, length = INDEX.unpack_from(packed, at)
            at += INDEX.size + length
            self.index.append((packed[at - length : at], *told))
        if len(self.index) != foot[4]:
            raise ValueError(f"{path} has {len(self.index)} of {foot[4]} blocks")

    def block(self, i: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before, ids as 32-bit integers) of each entry of a block."""
        _, offset, size, before, entries, width = self.index[i]
        data, at, key = zstandard.decompress(self.file.read_at(size, offset)), 0, b""
        for _ in range(entries):
            shared, rest, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            ids = data[at : at + n * width]
            at += n * width
            yield key, before, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of each document of that doc_id."""
        key, bits = key_of(doc_id), 8 * len(self.bloom)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, bits)):
            return []
        firsts = [x[0] for x in self.index]
        low = max(0, bisect_right(firsts, key) - 1)
        while low and firsts[low] == key:  # equal keys may begin in an earlier block
            low -= 1
        found = []
        for i in range(low, len(firsts)):
            if firsts[i] > key:
                break
            found += [ids for k, _, ids in self.block(i) if k == key]
        return found


def write_shards(docs: DataFrame, vocabulary_path: str, end: int = 0, folder: str | None = None, together: int = 128) -> DataFrame:
    """Encode every whole text, append the id ``end``, and write shards in doc_id order; returns the shards' table.

    The table (shard, path, entries, ids) has one row for each shard; ``shard`` is their order. Documents are dealt by
    range of doc_id and sorted by doc_id and then text, so the files' contents don't depend on which task wrote them;
    each attempt of a task writes a file of its own, and the table names those of the attempts that counted. A null or
    empty text has the end id alone; null doc_ids come first; repeated rows are repeated; further columns are ignored;
    an empty table gives no entries.
    """
    folder = folder or fresh_path(docs.sparkSession, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, encoder = TaskContext.get(), None, None
        for batch in batches:
            for low in range(0, batch.num_rows, together):
                part = batch.slice(low, together)
                if writer is None:
                    path = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}.sst"
                    writer, encoder = Writer(path), encoder_of(vocabulary_path)
                found = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    writer.add(key_of(doc_id), ids + struct.pack("<I", end))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": path, "entries": writer.entries, "ids": writer.ids}], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, "shard long, path string, entries long, ids long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary) from the files: ``start`` is the number of ids of all documents before.

    Each file keeps its own running count; the running total over files is a window over one row for each shard.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = shards.select("path", before.alias("before")).repartition(max(1, shards.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for key, start, ids in Reader(path):
                    rows.append((id_of(key), base + start, ids))
                    held += len(ids)
                    if held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, "doc_id long, start long, ids binary")
