"""Property graphs as edge tables (src, dst, edge_type, seq): neighbours, traversals, shortest paths and lineage.

A search is a loop of joins, one for each level, whose state is cut by a checkpoint; all that the driver sees of a
level is whether it is empty. Ties go to the edge that was appended first, as a queue would have it: the order of
discovery within a level is the order of the edges' ``seq`` along the paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.tables import cut


def of_type(edges: DataFrame, via: str | None) -> DataFrame:
    """Edges of a type, whatever its case; blank and ``*`` are all types."""
    return edges if via is None or via.strip() in ("", "*") else edges.filter(F.lower("edge_type") == via.strip().lower())


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """Outgoing edges of a node in order of appending."""
    return edges.filter(F.col("src") == node).orderBy("seq")


#: Levels of a search after which what was reached is one table again, so that plans don't grow with depth.
FOLD = 16


def reached(edges: DataFrame, start: str, depth: int | None = None, via: str | None = None, goal: str | None = None, paths: bool = False) -> DataFrame:
    """(node, depth): nodes within ``depth``; with ``paths`` also the ``seq`` of the edges on the first shortest path to each."""
    edges = of_type(edges, via).select("src", "dst", "seq")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0, [])], "node string, depth int, path array<bigint>")
    seen = seen if paths else seen.drop("path")
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        steps = front.join(edges, front["node"] == edges["src"])
        if paths:
            first = steps.select(F.col("dst").alias("node"), F.concat("path", F.array(F.col("seq").cast("bigint"))).alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        else:
            first = steps.select(F.col("dst").alias("node")).distinct()
        first = first.withColumn("depth", F.lit(level)).select(*seen.columns)
        front = cut(first.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % FOLD == 0:
            seen = cut(seen)
        if goal is not None and not front.filter(F.col("node") == goal).isEmpty():
            break
    return seen


def chain(links: DataFrame, start: str) -> DataFrame:
    """(node, depth) from ``start`` along ``links`` (src, dst) of which each node has at most one.

    Every round joins the links with themselves, so that they lead twice as far: a chain of n links takes log n rounds, and so
    does a cycle, whose nodes have their least depth.
    """
    spark = links.sparkSession
    first = links.groupBy("src").agg(F.min("dst").alias("at")).filter("src <> at")
    begin = spark.createDataFrame([(start, 0)], "at string, depth bigint").withColumn("src", F.lit(None).cast("string"))
    state, far = cut(first.withColumn("depth", F.lit(None).cast("bigint")).unionByName(begin)), 1
    most = state.count()
    while True:
        jumps = state.filter("src is not null").select(F.col("src").alias("at"), F.col("at").alias("next"))
        found = state.filter("src is null")
        moved = state.join(jumps, "at").select("src", F.col("next").alias("at"), (F.col("depth") + far).alias("depth"))
        state = moved.unionByName(found)
        state = cut(state.filter("src is not null and src <> at").unionByName(state.filter("src is null").groupBy("src", "at").agg(F.min("depth").alias("depth"))))
        far *= 2
        if far > most or state.filter("src is not null").isEmpty():
            return state.filter("src is null").select(F.col("at").alias("node"), "depth")


def traverse(edges: DataFrame, start: str, depth: int, via: str | None = None) -> DataFrame:
    """(src, dst, edge_type, seq, depth): every matching edge out of nodes nearer than ``depth``, also to seen nodes."""
    near = reached(edges, start, depth - 1, via) if depth > 0 else reached(edges, start, 0, via).limit(0)
    found = of_type(edges, via)
    return found.join(near, found["src"] == near["node"]).select("src", "dst", "edge_type", "seq", (F.col("depth") + 1).alias("depth"))


def path(edges: DataFrame, start: str, goal: str, via: str | None = None) -> DataFrame:
    """(step, node, seq) along the first shortest path; the start alone if it is the goal, no rows if there is none."""
    spark = edges.sparkSession
    first = spark.createDataFrame([(0, start, None)], "step int, node string, seq bigint")
    if start == goal:
        return first
    found = reached(edges, start, None, via, goal, paths=True).filter(F.col("node") == goal).select(F.posexplode("path").alias("i", "seq"))
    steps = found.join(edges.select("seq", "dst"), "seq").select((F.col("i") + 1).alias("step"), F.col("dst").alias("node"), "seq")
    start_row = found.filter("i = 0").select(F.lit(0).alias("step"), F.lit(start).alias("node"), F.lit(None).cast("bigint").alias("seq"))
    return start_row.unionByName(steps)


def without_retracted(edges: DataFrame, retractions: DataFrame) -> DataFrame:
    """Edges whose id no retraction names."""
    return edges.join(retractions.select("edge_id").distinct(), "edge_id", "left_anti")


def touching(edges: DataFrame, node: str, via: str | None = None) -> DataFrame:
    """Edges with a node at either end."""
    return of_type(edges, via).filter((F.col("src") == node) | (F.col("dst") == node)).orderBy("seq")


def from_research(rows: DataFrame) -> DataFrame:
    """Research-graph rows as edges: hexadecimal node names, and predicate names as types."""
    name = lambda c: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 16, "0")))
    from skarn.schema import GRAPH_PREDICATES

    kind = F.lit("related_to")
    for number, text in GRAPH_PREDICATES.items():
        kind = F.when(F.col("predicate_id") == number, text).otherwise(kind)
    return rows.select(name("subject_hash").alias("src"), name("object_hash").alias("dst"), kind.alias("edge_type"), "seq")


def commit_edges(commits: DataFrame) -> DataFrame:
    """(seal, parent, place) of each parent of each commit."""
    return commits.select("seal", F.posexplode("parents").alias("place", "parent"))


def leaves(commits: DataFrame) -> DataFrame:
    """Commits that are no commit's parent."""
    parents = commit_edges(commits).select(F.col("parent").alias("seal")).distinct()
    return commits.join(parents, "seal", "left_anti")


def children(commits: DataFrame, seal: str) -> DataFrame:
    return commits.filter(F.array_contains("parents", seal))


def lineage(commits: DataFrame, seal: str, first_parent: bool = False) -> DataFrame:
    """(node, depth) of a commit and all its ancestors, or of its first parents only."""
    links = commit_edges(commits)
    if first_parent:
        return chain(links.filter("place = 0").select(F.col("seal").alias("src"), F.col("parent").alias("dst")), seal).select("node", F.col("depth").cast("int").alias("depth"))
    edges = links.select(F.col("seal").alias("src"), F.col("parent").alias("dst"), F.lit("parent").alias("edge_type"), F.col("place").cast("bigint").alias("seq"))
    return reached(edges, seal).select("node", "depth")


def log(commits: DataFrame, refs: DataFrame | None = None, ref: str | None = None) -> DataFrame:
    """First parents from a ref or seal, else from ``main``, else from the last commit, newest first."""
    start = None
    if refs is not None:
        row = refs.filter(F.col("name") == (ref or "main")).select("seal").first()
        start = row.seal if row else None
    if start is None and ref is not None:
        start = ref
    if start is None:
        start = commits.orderBy(F.desc("seq")).select("seal").first().seal
    return lineage(commits, start, first_parent=True).orderBy("depth")


def subsumed(concepts: DataFrame, concept_id: int) -> DataFrame:
    """(node, depth) of all concepts below one, by ``parent_id``."""
    edges = concepts.select(F.col("parent_id").cast("string").alias("src"), F.col("concept_id").cast("string").alias("dst"), F.lit("subclass_of").alias("edge_type"), F.col("seq"))
    return reached(edges, str(concept_id)).select("node", "depth")
