"""Wide SimHash fingerprints and ball hashing of their blocks: operator 10's method at the radius of near copies."""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of pairs at the least similarity, the part that may meet in no block; fingerprints of a variant that are all compared.
MISS, CROWD = 1e-2, 24
#: Bits of a block that a ball may turn, the least certain ones, and how many of these at once.
UNSURE, RADIUS = 4, 2
#: Shingles whose bits are counted at once; pairs drawn to estimate how many meet in a block.
BLOCK, DRAWN = 2048, 20_000


class Plan(NamedTuple):
    """Bits of a block, number of blocks, and the most bits of the first number at which two fingerprints are compared."""

    bits: int
    blocks: int
    most: int

    @property
    def per(self) -> int:
        """Blocks of a number."""
        return 64 // self.bits

    @property
    def numbers(self) -> int:
        """Numbers of a fingerprint: one to compare, the others in blocks."""
        return 1 + -(-self.blocks // self.per)


def _meeting(bits: int, least: float) -> float:
    """The part of pairs of sets at similarity ``least`` whose balls meet in a block of ``bits`` bits, from drawn pairs.

    How many more shingles have a bit than not is the sum of a normal share of those in common and one of each side's own.
    """
    rng = np.random.default_rng(0)
    shared = rng.normal(0, math.sqrt(2 * least), (DRAWN, bits))
    a, b = (shared + rng.normal(0, math.sqrt(1 - least), (DRAWN, bits)) for _ in range(2))
    first, second = (np.argsort(np.argsort(np.abs(x), axis=1), axis=1) < UNSURE for x in (a, b))
    differ = (a > 0) != (b > 0)
    one, other, both = ((differ & x).sum(axis=1) for x in (first & ~second, second & ~first, first & second))
    met = (one <= RADIUS) & (other <= RADIUS) & (one + other + both <= 2 * RADIUS) & (one + other + both == differ.sum(axis=1))
    return float(met.mean())


@cache
def plan(rows: int, least: float) -> Plan:
    """Blocks for a table of ``rows`` texts and sets of shingles at similarity ``least``.

    Two sets at that similarity have a cosine of 2 least / (1 + least) or more, and differ in a bit with the chance of its
    angle. A block has one bit more than count the rows, so that a variant is shared by about five strangers at most at any
    size, and there are as many blocks as leave ``MISS`` of the pairs without one in which their balls meet.
    About as many again differ by more than ``most``.
    """
    bits = min(32, max(10, (rows - 1).bit_length() + 1))
    apart = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    most = 64 * apart + 2.5 * math.sqrt(64 * apart * (1 - apart))
    return Plan(bits, math.ceil(math.log(MISS) / math.log(max(1 - _meeting(bits, least), MISS))), int(most))


@cache
def _turns(numbers: int) -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(numbers)], np.uint64)


@cache
def _places(how: Plan) -> np.ndarray:
    """Where the bits of each block are among those of all numbers."""
    starts = [64 * (1 + b // how.per) + b % how.per * how.bits for b in range(how.blocks)]
    return np.array(starts)[:, None] + np.arange(how.bits)


def fingerprint(values: np.ndarray, how: Plan) -> np.ndarray:
    """SimHash of distinct shingle values: a bit is one if more than half the shingles have it.

    The first number is one of 64 bits to compare, the others are a block each: its bits, and from bit 32 on the places,
    five bits each, of the ``UNSURE`` bits at which the shingles are most evenly divided. A near copy differs there first.
    """
    ones = np.zeros(64 * how.numbers, np.int64)
    for i in range(0, len(values), BLOCK):
        mixed = values[i : i + BLOCK, None] * _turns(how.numbers)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    more = 2 * ones - len(values)
    of_blocks = more[_places(how)]
    unsure = np.argsort(np.abs(of_blocks), axis=1, kind="stable")[:, :UNSURE]
    blocks = ((of_blocks > 0) << np.arange(how.bits)).sum(axis=1) | (unsure << (32 + 5 * np.arange(UNSURE))).sum(axis=1)
    return np.concatenate([np.packbits(more[:64] > 0, bitorder="little").view(np.int64), blocks])


def _blocks(prints: DataFrame, how: Plan, *more: str) -> DataFrame:
    """(node, f0, value, places) of every block of every fingerprint, the block's number above its bits."""
    each = [F.struct((F.col(f"f{1 + b}").bitwiseAND(F.lit((1 << how.bits) - 1)) + F.lit(b << 32)).alias("value"), F.shiftrightunsigned(f"f{1 + b}", 32).alias("places")) for b in range(how.blocks)]
    return prints.select("node", "f0", *more, F.explode(F.array(*each)).alias("block")).select("node", "f0", *more, "block.*")


def _alike(how: Plan) -> str:
    return f"bit_count(f0 ^ g0) <= {how.most}"


def block_stars(prints: DataFrame, how: Plan) -> DataFrame:
    """Pairs (a, b) of each node and the smallest that has one of its blocks bit by bit: as many as blocks, however many share one."""
    rows = _blocks(prints, how)
    least = rows.groupBy("value").agg(F.min(F.struct("node", "f0")).alias("low"), F.count("*").alias("n")).filter("n > 1")
    met = rows.join(least, "value").select("node", "f0", F.col("low.node").alias("low"), F.col("low.f0").alias("g0"))
    return met.filter(F.expr(f"node <> low and {_alike(how)}")).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()


def ball_pairs(prints: DataFrame, roots: DataFrame, how: Plan) -> DataFrame:
    """Pairs (a, b) of nodes of different classes whose balls meet in a block, and that differ little in ``f0``.

    A ball has the variants of a block within ``RADIUS`` turns of its ``UNSURE`` least certain bits, and whoever meets in
    one is compared; ``roots`` (node, root) has the class of each node that isn't one by itself, so a cluster of near
    copies costs no pairs. Up to ``CROWD`` nodes of a variant are all compared. Of a larger crowd with several classes each
    node comes with itself, (a, a), and is left to an exact search, for the crowd's pairs grow with its square.
    """
    named = prints.join(roots, "node", "left").withColumn("cls", F.coalesce("root", "node"))
    turned = [f"shiftleft(1L, cast(shiftright(places, {5 * i}) & 31 as int))" for i in range(UNSURE)]
    masks = [" ^ ".join(["0L", *some]) for n in range(RADIUS + 1) for some in combinations(turned, n)]
    rows = _blocks(named, how, "cls").select(F.expr(f"explode(array({', '.join(f'value ^ {m}' for m in masks)}))").alias("v"), "node", "f0", "cls")
    ball = Window.partitionBy("v")
    over = {"n": F.count("*"), "cls1": F.min("cls"), "cls9": F.max("cls")}
    met = rows.select("*", *(f.over(ball).alias(c) for c, f in over.items())).filter("cls1 < cls9")
    few = met.filter(F.col("n") <= CROWD).select("v", "node", "f0", "cls")
    there = few.withColumnsRenamed({"node": "node2", "f0": "g0", "cls": "cls2"})
    pairs = few.join(there, "v").filter(F.expr(f"node < node2 and cls <> cls2 and {_alike(how)}"))
    # min(f0) is asked for so that the crowds read the same columns, and Spark the same shuffle, as the pairs.
    crowds = met.filter(F.col("n") > CROWD).groupBy("node").agg(F.min("f0").alias("f0")).filter("f0 is not null")
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().union(crowds.select("node", "node"))
