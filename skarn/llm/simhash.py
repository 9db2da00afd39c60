"""SimHash near-duplicate removal by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import balls, similar
from .common import discard, keep_one, small, written
from .components import connected_components

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: The three blocks of bits; a distance of three leaves at most two in some two of them.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints that share a variant above which they meet in smaller balls.
CROWD = 4096


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased, words split at ASCII white space.

    A bit is one if more than half the shingles' XXH64 values (seed 42, repeats counted) have it. A text of fewer than
    ``words`` words is one shingle; a null text or one without words has fingerprint zero.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.fromiter(map(len, found), np.int64, len(found))
    np.add.accumulate(ends + 1, out=ends)
    starts = [0, *ends[:-1].tolist()]
    hashes = (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=False))
    n, ones = len(found) - words + 1, np.zeros(64, np.int64)
    for _ in range(0, n, BLOCK):
        block = np.fromiter(islice(hashes, BLOCK), np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every document; only these two columns leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t, words)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def _variants(masks: list[int], keep: int = -1) -> F.Column:
    array = ",".join(f"{_signed(m)}L" if m >> 63 == 0 else f"({_signed(m) + 1}L-1L)" for m in masks)
    return F.expr(f"explode(transform(array({array}), m -> (fp & {keep}L) ^ m))")


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) at up to two differing bits: every fingerprint emits all variants within one bit.

    Two fingerprints within two bits share a variant, and all that share one are within two bits of each other, so each
    is linked to the smallest of its variant: as many links as members, never all pairs. At most 65 share a variant.
    """
    out = fps.select("fp", _variants([0, *(1 << i for i in range(64))]).alias("v"))
    least = F.min("fp").over(Window.partitionBy("v"))
    return out.select("fp", least.alias("least")).filter("least < fp").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def far_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between classes (fp, cls) that have members at exactly three differing bits.

    Three differing bits leave at most two in some two of three blocks. On each two blocks every fingerprint emits all
    variants within one bit, half of that radius; whoever meets there is checked against the exact distance. Variants
    of a single class go first, told by partial aggregates. Up to ``CROWD`` fingerprints of a variant are compared with
    each other; those of a larger one meet in balls of all 64 bits instead, of one bit and of two, where at most 65 and
    2,081 can share a variant, so that no crowd makes all its pairs.
    """
    rows = None
    for low, high in BLOCKS:
        drop = ((1 << high) - 1) ^ ((1 << low) - 1)
        masks = [0, *(1 << i for i in range(64) if not drop >> i & 1)]
        part = fps.select("fp", "cls", _variants(masks, _signed(~drop & (1 << 64) - 1)).alias("v"))
        rows = part if rows is None else rows.union(part)
    shared = rows.groupBy("v").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("n")).filter("low < high")
    shared = written(shared.select("v", "n"), "shared")
    met = written(rows.join(small(shared), "v"), "met")
    there = lambda df: df.withColumnsRenamed({"fp": "fp2", "cls": "cls2"})
    few = met.filter(F.col("n") <= CROWD)
    pairs = few.select("v", "fp", "cls").join(there(few.select("v", "fp", "cls")), "v").filter("cls < cls2 and bit_count(fp ^ fp2) = 3")
    crowd = written(met.filter(F.col("n") > CROWD).select("fp", "cls").distinct(), "crowd")
    if not crowd.isEmpty():
        one = [0, *(1 << i for i in range(64))]
        two = [*one, *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
        near, wide = (crowd.select("fp", "cls", _variants(m).alias("v")) for m in (one, two))
        pairs = pairs.unionByName(near.join(there(wide), "v").filter("cls < cls2 and bit_count(fp ^ fp2) = 3"))
    found = written(pairs.select(F.col("cls2").alias("a"), F.col("cls").alias("b")).distinct(), "far_links")
    discard(shared, met, crowd)
    return found


def _classes(marks: DataFrame) -> DataFrame:
    """(fp, first, cls): each fingerprint, its smallest doc_id and its component."""
    nodes = written(marks.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "nodes")
    close = written(connected_components(close_links(nodes.select("fp"))), "close")
    classes = nodes.join(close, nodes.fp == close.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("cls"))
    classes = written(classes, "classes")
    links = far_links(classes.select("fp", "cls"))
    far = written(connected_components(links), "far")
    joined = classes.join(far, classes.cls == far.node, "left").select("fp", "first", F.coalesce("root", "cls").alias("cls"))
    joined = written(joined, "joined")
    discard(nodes, close, classes, links, far)
    return joined


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, fingerprint, component_id), one row for each row.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest doc_id that can be reached.
    Equal fingerprints are one node, so thousands of copies cost one row in the search. Nulls and texts without words
    have fingerprint zero and link like any other; repeated rows come back repeated; a null doc_id stays null and never
    names a component unless all its members are null; further columns are ignored; an empty table gives an empty table.
    """
    marks = written(fingerprints(docs, words), "fingerprints")
    classes = _classes(marks)
    firsts = classes.groupBy("cls").agg(F.min("first").alias("component_id"))
    named = written(classes.select("fp", "cls").join(firsts, "cls").select("fp", "component_id"), "named")
    discard(classes)
    return marks.join(named, marks.fingerprint == named.fp).select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, least: float = similar.LEAST) -> DataFrame:
    """``docs`` with one row of each group of near copies, the smallest doc_id, then text key; all columns as they were.

    Near copies have a five-word similarity of ``least`` or more, exactly told. At 0.8 that is about ten differing bits
    of 64 and up to twenty, which no ball of affordable size spans; so fingerprints are wider, and balls are those of
    their blocks (``balls``). What these miss is found by MinHash bands (``similar``). Texts of equal words are copies; null texts and those without words are copies
    of each other. A null doc_id comes after all others; rows of one doc_id and different texts are different documents;
    of repeated rows one stays. Further columns stay; an empty table gives an empty table.
    """
    how = balls.plan(docs.count(), least)
    marks = written(similar.marks_of(docs, how), "marks")
    roots = similar.components_of(docs, marks, how, least)
    kept = keep_one(docs, marks, roots)
    discard(marks, roots)
    return kept
