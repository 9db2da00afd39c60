"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, keep_rows, small, written

WORD = re.compile(r"\w+")
#: Words of a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of benchmark text up to which all items travel to the tasks; a larger benchmark is joined by shuffles.
BLOCK_BYTES = 8 << 20
#: Bits of the filter that document shingles must pass before they are shuffled; items that are verified at once, about.
FILTER_BITS, AT_ONCE = 1 << 24, 256
#: Words of a document that are hashed at once.
SPAN = 1 << 18
MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hasher:
    """64-bit values of words and of runs of words; equal runs have equal values."""

    def __init__(self, limit: int = 400_000) -> None:
        self.known: dict[str, int] = {}
        self.limit = limit

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def runs(values: np.ndarray, width: int) -> np.ndarray:
        n = len(values) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total += values[i : i + n] * MIX[i]
        return total ^ total >> np.uint64(29)


def size_class(n: int) -> int:
    """The size partition of an item of ``n`` shingles: ``1 << class`` is its upper bound, half of that its lower one."""
    return (n - 1).bit_length()


def sketch(words: list[str], hasher: Hasher, threshold: float, shingle: int) -> tuple[int, int, np.ndarray]:
    """(width, number of shingles, least MinHash values) of an item.

    A document that holds a share ``threshold`` of an item's n shingles lacks at most (1 - threshold) n of them, so it
    holds at least one of the item's (1 - threshold) n + 1 smallest; a size partition takes that from its upper bound.
    """
    width = min(shingle, len(words))
    values = np.unique(hasher.runs(hasher.words(words), width))
    return width, len(values), values[: floor((1 - threshold) * (1 << size_class(len(values))) + 1e-9) + 1]


def runs_of(words: list[str], width: int) -> set[tuple[str, ...]]:
    return {*zip(*(words[i:] for i in range(width)), strict=False)}


class Sketches:
    """Benchmark items partitioned by size, each with the least MinHash values of its shingles.

    A partition is searched only for documents long enough to hold the share of its smallest item. A hit on a sketch
    makes the candidate, whose containment is then counted over the shingles themselves.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, shingle: int = SHINGLE) -> None:
        self.threshold, hasher = threshold, Hasher()
        self.shingles: list[tuple[int, int, set[tuple[str, ...]]]] = []
        parts: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            width, n, values = sketch(words, hasher, threshold, shingle)
            at, owner = parts.setdefault(width, {}).setdefault(size_class(n), ([], []))
            at += values.tolist()
            owner += [len(self.shingles)] * len(values)
            self.shingles.append((item_id, width, runs_of(words, width)))
        #: By width: a filter of all keys, and for each partition its least size, sorted keys and their items.
        self.parts = {}
        for width, classes in parts.items():
            bits, found = np.zeros(1 << 20, bool), []
            for part, (at, owner) in sorted(classes.items()):
                order = np.argsort(np.array(at, np.uint64), kind="stable")
                keys = np.array(at, np.uint64)[order]
                bits[(keys >> np.uint64(44)).astype(np.int64)] = True
                found.append(((1 << part) // 2 + 1 if part else 1, keys, np.array(owner)[order]))
            self.parts[width] = bits, found

    def candidates(self, words: list[str], hasher: Hasher) -> set[int]:
        found: set[int] = set()
        for low in range(0, max(1, len(words)), SPAN):
            values = hasher.words(words[low : low + SPAN + SHINGLE - 1])
            for width, (bits, parts) in self.parts.items():
                runs = hasher.runs(values, width)
                runs = np.unique(runs[bits[(runs >> np.uint64(44)).astype(np.int64)]])
                if not len(runs):
                    continue
                for least, keys, owner in parts:
                    if len(words) - width + 1 < self.threshold * least - 1e-9:
                        break
                    left, right = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
                    for i in np.nonzero(right > left)[0]:
                        found.update(owner[left[i] : right[i]].tolist())
        return found

    def contained(self, text: str | None, hasher: Hasher) -> list[tuple[int, float]]:
        """(item_id, containment) of the items that ``text`` holds."""
        words = words_of(text)
        found = []
        if words and (candidates := self.candidates(words, hasher)):
            here = {w: runs_of(words, w) for w in {self.shingles[c][1] for c in candidates}}
            for c in sorted(candidates):
                item_id, width, shingles = self.shingles[c]
                share = len(shingles & here[width]) / len(shingles)
                if share >= self.threshold - 1e-9:
                    found.append((item_id, share))
        return found


def _search(docs: DataFrame, items: list[tuple[int, str]], threshold: float, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, hasher = Sketches(items, threshold, shingle), Hasher()
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                doc_id = batch.column(0)[i].as_py()
                out += [(doc_id, *hit) for hit in sketches.contained(batch.column(1)[i].as_py(), hasher)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "containment"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, containment double")


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, containment) of each benchmark item of which a document holds ``threshold`` of the word shingles.

    Words are lower-cased runs of letters, digits and underscores; an item of fewer words than a shingle is one shingle
    of all its words. Items of up to ``BLOCK_BYTES`` of text travel to the tasks: documents are not shuffled then, and no
    candidate leaves its task. A larger benchmark stays distributed: sketches, and the document shingles that pass a
    filter of a fixed size, are joined by shuffles, and the driver holds no item. Both ways give the same rows. Null and
    empty texts of either side match nothing; repeated rows of either side give repeated results; further columns are
    ignored; empty tables give an empty table.
    """
    items = _items(benchmark)
    if (block := _one_block(items)) is not None:
        return _search(docs, block, threshold, shingle)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = _hits(rows.select("text"), items, threshold, shingle)
    named = items.select("item_id", _key("text").alias("ikey"))
    found = rows.select("doc_id", _key("text").alias("dkey")).join(hits, "dkey").join(named, "ikey")
    return found.select("doc_id", "item_id", "containment")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they were.

    Every other row stays, as often as it was there: null and empty texts, null and repeated doc_ids. Empty tables of
    either side take nothing out.
    """
    items = _items(benchmark)
    if (block := _one_block(items)) is not None:

        def judge_of():
            sketches, hasher = Sketches(block, threshold, shingle), Hasher()
            return lambda texts: [not sketches.contained(t, hasher) for t in texts]

        return keep_rows(docs, judge_of)
    hits = written(_hits(docs.select(F.col("text").cast("string").alias("text")), items, threshold, shingle).select("dkey").distinct(), "leaks")
    name = fresh_name(docs, "key_")
    rows = docs.withColumn(name, _key("text"))
    return rows.join(small(hits), rows[name] == hits["dkey"], "left_anti").select(*(rows[c] for c in docs.columns))


def _key(text: str) -> Column:
    """Equal texts have equal keys."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")


def _one_block(items: DataFrame) -> list[tuple[int, str]] | None:
    """The items, if their texts are small enough to travel to the tasks."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    return [(r.item_id, r.text) for r in items.toLocalIterator()] if total <= BLOCK_BYTES else None


def _hits(texts: DataFrame, items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(dkey, ikey, containment) by keys of texts and items, for a benchmark of any size."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            made = [(k, *sketch(w, hasher, threshold, shingle)) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (w := words_of(t))]
            columns = zip(*made, strict=True) if made else [[]] * 4
            types = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = [[v.view(np.int64) for v in c] if i == 3 else c for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["ikey", "width", "n", "values"])

    distinct = written(items.select(_key("text").alias("ikey"), "text").dropDuplicates(["ikey"]), "items")
    sketches = distinct.mapInArrow(sketched, "ikey binary, width long, n long, values array<long>")
    sketches = written(sketches.select("ikey", "width", "n", F.explode("values").alias("value")), "sketches")
    shift = 64 - FILTER_BITS.bit_length() + 1
    place = F.shiftrightunsigned("value", shift)
    words = sketches.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(value, {shift}) & 63 as int))")).alias("bits"))
    table = np.zeros(FILTER_BITS >> 6, np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    widths = [r[0] for r in sketches.select("width").distinct().collect()]
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), shared.value
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for low in range(0, len(words), SPAN):
                    coded = hasher.words(words[low : low + SPAN + SHINGLE - 1])
                    for width in widths:
                        runs = hasher.runs(coded, width)
                        at = runs >> np.uint64(shift)
                        runs = np.unique(runs[(table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)])
                        if len(runs):
                            columns = [pa.array([key], pa.binary()), pa.array([width], pa.int64()), pa.array([len(words) - width + 1], pa.int64()), pa.array([runs.view(np.int64)], pa.list_(pa.int64()))]
                            yield pa.RecordBatch.from_arrays(columns, names=["dkey", "width", "m", "values"])

    keyed = texts.filter("text is not null").select(_key("text").alias("dkey"), "text")
    runs = keyed.mapInArrow(shingled, "dkey binary, width long, m long, values array<long>").select("dkey", "width", "m", F.explode("values").alias("value"))
    pairs = runs.join(sketches, ["width", "value"]).filter(F.col("m") >= threshold * F.col("n") - 1e-9).select("dkey", "ikey").distinct()
    pairs = written(pairs, "pairs")
    many = pairs.groupBy("dkey").agg(F.ceil(F.count("*") / AT_ONCE).alias("parts"))
    pairs = pairs.join(many, "dkey").withColumn("part", F.pmod(F.xxhash64("ikey"), F.col("parts")))
    groups = pairs.join(distinct, "ikey").groupBy("dkey", "part").agg(F.collect_list("ikey").alias("ikeys"), F.collect_list("text").alias("items"))
    wanted = keyed.join(small(written(many.select("dkey"), "wanted")), "dkey", "left_semi").dropDuplicates(["dkey"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, keys, items = (c[i].as_py() for c in batch.columns)
                words, here, out = words_of(text), {}, []
                for k, item in zip(keys, items, strict=True):
                    told = words_of(item)
                    width = min(shingle, len(told))
                    if width not in here:
                        here[width] = runs_of(words, width)
                    mine = runs_of(told, width)
                    if (share := len(mine & here[width]) / len(mine)) >= threshold - 1e-9:
                        out.append((k, share))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.binary()), pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.float64())], names=["dkey", "ikey", "containment"])

    return wanted.join(groups, "dkey").select("dkey", "text", "ikeys", "items").mapInArrow(verified, "dkey binary, ikey binary, containment double")
