"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _least(pairs: DataFrame, node: str, other: str) -> DataFrame:
    return pairs.groupBy(node).agg(F.min(other).alias("least")).select(F.col(node), F.least(node, "least").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = _least(down, "a", "b")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b")
    return moved.union(least.filter("a > least").select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, no order, no nulls) -> (node, root), root the smallest node that can be reached.

    Nodes without an edge to another node are absent. Every round is a few joins and partial aggregates on the link
    table alone, written to the shared folder; no neighbour list is ever gathered in one task. The number of rounds
    grows with the logarithm of the longest chain. An empty table gives an empty table.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, before = now, state
        half = written(_large_star(last).distinct(), "large")
        now = written(_small_star(half).distinct(), "small")
        discard(half)
        discard(last)
