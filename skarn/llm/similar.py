"""Links of exact five-word similarity 0.8 or more for operator 10: SimHash balls, and MinHash bands for what they miss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import balls
from .common import discard, map_texts, small, text_key, written
from .components import connected_components

SEED = 42
#: Words of a shingle, and the similarity from which documents are near copies.
SHINGLE, LEAST = 5, 0.8
#: Bands and the MinHash values of each: of pairs at similarity 0.8, 1 - (1 - 0.8^4)^24 share a band, all but 3 in a million.
BANDS, ROWS = 24, 4
#: Nodes of a band that are all compared with each other; bytes of two signatures that differ at most: of pairs at
#: similarity 0.8 one in a million has more.
CROWD, MOST_UNLIKE = 4, 38
#: Nodes of a shingle that one task compares with the others, and tasks that share the work of a shingle at most.
PART, SPREAD = 256, 64
#: Shingles that are hashed at once; texts of a batch that are worked on at once.
BLOCK, TOGETHER = 2048, 512
MIX = np.array([pow(0xD6E8FEB86659FD93, 2 * i + 1, 1 << 64) for i in range(BANDS * ROWS)], np.uint64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, split at ASCII white space."""
    return (text or b"").lower().split()


def node(text: bytes | None) -> int:
    """Number of a text's words; texts without words share one."""
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words_of(text)), SEED))


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit values of the runs of ``width`` words; fewer words are one run, none are no run."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SEED)], np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w, SEED) for w in set(words)}
    values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total ^ values[k : k + n]) * MIX[k]
        total ^= total >> np.uint64(29)
    return np.unique(total)


def least_values(values: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each hash."""
    least = np.full(len(MIX), ~np.uint64(0))
    for i in range(0, len(values), BLOCK):
        mixed = values[i : i + BLOCK, None] * MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """A number for each band of least values."""
    return [_signed(xxhash.xxh3_64_intdigest(row.tobytes(), b)) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def signature(least: np.ndarray) -> np.ndarray:
    """A byte of each least value, eight to a number."""
    return (least >> np.uint64(17)).astype(np.uint8).view(np.int64)


def _unlike(a: str, b: str) -> Column:
    """How many bytes of two signatures differ."""
    total = F.lit(0)
    for i in range(BANDS * ROWS // 8):
        bits = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        total = total + F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes whose shingle sets are similar; ``sets`` (node, shingles), an array of distinct numbers."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.filter(F.col("n") >= least * (F.col("na") + F.col("nb") - F.col("n")) - 1e-9).select("a", "b")


def marks_of(docs: DataFrame, how: balls.Plan) -> DataFrame:
    """(key, doc_id, node, size, print, bands, signature) of every row.

    That is its text key, number of shingles, SimHash fingerprint in the blocks of ``how``, and MinHash values.
    """
    id_type = docs.schema["doc_id"].dataType
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                sizes, prints, banded, signed = [], [], [], []
                for t in texts:
                    values = shingles(t)
                    least = least_values(values) if len(values) else None
                    sizes.append(len(values))
                    prints.append([] if least is None else balls.fingerprint(values, how))
                    banded.append([] if least is None else bands(least))
                    signed.append([] if least is None else signature(least))
                columns = [pa.array([node(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, longs), pa.array(banded, longs), pa.array(signed, longs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["key", "doc_id", "node", "size", "print", "bands", "signature"])

    many = T.ArrayType(T.LongType())
    fields = [("key", T.LongType()), ("doc_id", id_type), ("node", T.LongType()), ("size", T.LongType()), ("print", many), ("bands", many), ("signature", many)]
    text = F.col("text").cast("string")
    return map_texts(docs.select(text_key(F.col("text")).alias("key"), "doc_id", text.alias("text")), run, T.StructType([T.StructField(*f) for f in fields]))


def _able(least: float) -> Column:
    """Whether sizes and signatures of both sides, their columns led by a and b, allow the similarity."""
    return (F.least("asize", "bsize") >= least * F.greatest("asize", "bsize")) & (_unlike("as", "bs") <= MOST_UNLIKE)


def _side(nodes: DataFrame, c: str) -> DataFrame:
    return nodes.select(*(F.col(x).alias(f"{c}{x}") for x in nodes.columns))


def _nodes(marks: DataFrame, how: balls.Plan) -> DataFrame:
    """(node, size, f0, f1, ..., s0, s1, ...) of each node with words: fingerprint and signature."""
    prints = [F.min(F.col("print")[i]).alias(f"f{i}") for i in range(1 + how.blocks)]
    signs = [F.min(F.col("signature")[i]).alias(f"s{i}") for i in range(BANDS * ROWS // 8)]
    return marks.filter("size > 0").groupBy("node").agg(F.min("size").alias("size"), *prints, *signs)


def _possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    found = pairs.join(_side(nodes, "a"), F.col("a") == F.col("anode")).join(_side(nodes, "b"), F.col("b") == F.col("bnode"))
    return found.filter(_able(least)).select("a", "b")


def _candidates(marks: DataFrame, nodes: DataFrame, stars: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), ``stars`` and nodes that share a band, whose sizes and signatures allow the similarity.

    Up to ``CROWD`` nodes of a band are compared with each other. In a larger crowd all are compared with its centre, the
    node that meets most others, and with its smallest node, so pairs grow with nodes and not with their square; these
    crowds (band, node) come second.
    """
    rows = written(marks.select("node", F.explode("bands").alias("band")).distinct(), "rows")
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1")
    met = written(rows.join(small(written(shared, "shared")), "band"), "met")
    few, many = met.filter(F.col("n") <= CROWD), met.filter(F.col("n") > CROWD)
    pairs = few.select("band", F.col("node").alias("a")).join(few.select("band", F.col("node").alias("b")), "band").filter("a < b").select("a", "b")
    degree = met.groupBy("node").agg((F.sum("n") * (1 << 24) + F.min(F.pmod("node", F.lit(1 << 24)))).alias("degree"))
    centres = many.join(degree, "node").groupBy("band").agg(F.max_by("node", "degree").alias("centre"))
    centres = small(written(centres, "centres"))
    spokes = many.join(centres, "band").select(F.col("node").alias("a"), F.explode(F.array("low", "centre")).alias("b")).filter("a <> b")
    spokes = spokes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.union(spokes).union(stars).distinct(), "pairs")
    found = written(_possible(pairs, nodes, least), "candidates")
    crowds = written(many.select("band", "node"), "crowds")
    discard(rows, met, pairs)
    return found, crowds


def _divided(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, cls) of the crowds whose nodes are not yet all of one class."""
    members = crowds.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("cls"))
    mixed = members.groupBy("band").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high").select("band")
    return members.join(mixed, "band", "left_semi").select("node", "cls").distinct()


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """(node, cls, at, shingle) of the rarest shingles of each set, ``at`` from 1: two similar sets have one of these in common.

    Similar sets share ``least`` of their shingles or more, so of n only n - ceil(least n) + 1 in any order that all
    sets follow need be looked at. Rarest first, a passage that many texts share comes last and seldom counts.
    """
    each = sets.select("node", "cls", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    ordered = each.join(often, "shingle", "left").groupBy("node", "cls").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "shingle"))).alias("all"))
    n = F.size("all")
    first = F.slice("all", 1, (n - F.ceil(least * n - 1e-9) + 1).cast("int"))
    return ordered.select("node", "cls", F.posexplode(first).alias("at", "one")).select("node", "cls", F.expr("at + 1").alias("at"), F.col("one.shingle").alias("shingle"))


def _across(divided: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that share one of their rarest shingles; exact, without a cap.

    Of a shingle's nodes those of its largest class aren't compared with each other, so a cluster of near copies costs
    as many comparisons as it has nodes for each stranger. Places, sizes and signatures are compared within the join, and
    only pairs that pass leave it: from the first shingle in common on, each side must have enough shingles left for the
    similarity, which texts with a common passage and much of their own don't. Nodes of a shingle are dealt over
    ``SPREAD`` tasks if there are many.
    """
    rows = written(_rarest(sets.join(small(divided), "node"), least), "rarest")
    counts = rows.groupBy("shingle", "cls").agg(F.count("*").alias("n"))
    groups = counts.groupBy("shingle").agg(F.max_by("cls", F.struct("n", "cls")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("classes"))
    groups = groups.filter("classes > 1").withColumn("parts", F.least(F.lit(SPREAD), F.ceil(F.col("n") / PART)).cast("int")).select("shingle", "main", "parts")
    met = written(rows.join(groups, "shingle").join(nodes, "node"), "met")
    one = _side(met.filter("cls <> main").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "a")
    all_ = _side(met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    same = (F.col("ashingle") == F.col("bshingle")) & (F.col("apart") == F.col("bpart")) & (F.col("acls") != F.col("bcls"))
    enough = 1 + F.least(F.expr("asize - aat"), F.expr("bsize - bat")) >= least / (1 + least) * F.expr("asize + bsize") - 1e-9
    pairs = one.join(all_, same & enough & _able(least)).select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"))
    found = written(pairs.distinct(), "across")
    discard(rows, met)
    return found


def _sets_of(docs: DataFrame, marks: DataFrame, near: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes ``near``, from one text of each."""
    ids = marks.groupBy("node", F.col("key").alias("k")).agg(F.min("doc_id").alias("d")).join(near, "node")
    wanted = written(ids.groupBy("node").agg(F.min("k").alias("k"), F.min_by("d", "k").alias("d")), "wanted")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                sets = [shingles(t).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small(wanted), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")))
    sets = written(map_texts(texts.groupBy("node").agg(F.min("text").alias("text")), keep, "node long, shingles array<long>"), "sets")
    discard(wanted)
    return sets


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def components_of(docs: DataFrame, marks: DataFrame, how: balls.Plan, least: float = LEAST) -> DataFrame:
    """(node, root) of the texts that have a near copy of other words; links are exact similarities of ``least`` or more.

    Equal words are one node. Candidates meet in blocks of SimHash fingerprints, first in whole ones, then, where that
    leaves different classes, in balls; of pairs at ``least`` some two in a hundred are missed. So candidates share a
    MinHash band too, which three in a million don't. Each is verified by the shingles themselves, so no link is made
    without its similarity. Crowds of a ball, and of a band that their centres leave in several classes, are searched
    again, by their rarest shingles, which miss no pair. ``marks`` is the written table of ``marks_of``, ``how`` its plan of blocks.
    """
    nodes = written(_nodes(marks, how), "nodes")
    prints = [f"f{i}" for i in range(1 + how.blocks)]
    marked, signed = nodes.select("node", *prints), nodes.drop(*prints)
    pairs, crowds = _candidates(marks, signed, balls.block_stars(marked, how), least)
    sets = _sets_of(docs, marks, _ends(pairs).distinct())
    links = written(_verified(pairs, sets, least), "links")
    found = written(connected_components(links), "similar")
    discard(pairs, sets)
    met = written(balls.ball_pairs(marked, found, how), "balls")
    more = written(_possible(met.filter("a < b"), signed, least), "able")
    crowded = met.filter("a = b").select(F.col("a").alias("node")).join(found, "node", "left").select("node", F.coalesce("root", "node").alias("cls"))
    divided = written(_divided(crowds, found).union(crowded).distinct(), "divided")
    wanted = written(_ends(more).union(divided.select("node")).distinct(), "again")
    if not wanted.isEmpty():
        sets = _sets_of(docs, marks, wanted)
        every = [more] if divided.isEmpty() else [more, _across(divided, signed, sets, least)]
        both = every[0] if len(every) == 1 else every[0].union(every[1]).distinct()
        fresh = written(_verified(both, sets, least), "fresh")
        if not fresh.isEmpty():
            discard(found)
            found = written(connected_components(links.unionByName(fresh)), "similar")
        discard(sets, fresh, *every[1:])
    discard(links, crowds, nodes, met, more, divided, wanted)
    return found
