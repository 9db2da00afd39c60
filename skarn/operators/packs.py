"""Domain packs: motion, survey points, commitments, wearables, papers, research graph, concepts and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import spatial as S


def _limited(rows: DataFrame, limit: int | None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def kinematics(rows: DataFrame, low: list[float], high: list[float], start: int = 0, end: int = 2**63 - 1, limit: int | None = None) -> DataFrame:
    """Positions (px, py, pz) in an inclusive box and time range, in scan order."""
    return _limited(rows.filter(S.in_box(low, high, "px", "py", "pz") & F.col("timestamp_us").between(start, end)), limit)


def survey_points(rows: DataFrame, latitude: tuple[float, float] = (-90, 90), longitude: tuple[float, float] = (-180, 180), elevation: tuple[float, float] = (-10_000, 50_000), limit: int | None = None) -> DataFrame:
    """Points in an inclusive box of degrees and metres; tested on the stored integers, so the tests reach the scan."""
    micro = lambda c, r: F.col(c).between(*(round(x * 1_000_000) for x in r))
    return _limited(rows.filter(micro("lat_micro", latitude) & micro("lon_micro", longitude) & F.col("elevation_mm").between(*(round(x * 1000) for x in elevation))), limit)


def commitments(rows: DataFrame, low: int = 0, high: int = 2**63 - 1, limit: int | None = None) -> DataFrame:
    return _limited(rows.filter(F.col("block_height").between(low, high)), limit)


def wearables(rows: DataFrame, start: int = 0, end: int = 2**63 - 1, sensor_id: int | None = None, metric_id: int | None = None) -> DataFrame:
    tests = [F.col("timestamp_sec").between(start, end)]
    tests += [F.col("sensor_id") == sensor_id] if sensor_id is not None else []
    tests += [F.col("metric_id") == metric_id] if metric_id is not None else []
    return reduce(DataFrame.filter, tests, rows).withColumn("value", F.col("quantized") / 256.0)


def papers(rows: DataFrame, low: list[float], high: list[float], first_year: int, last_year: int) -> DataFrame:
    """Papers in a topic box and a range of years, tombstones included."""
    return rows.filter(S.in_box(low, high, "topic_x", "topic_y", "topic_z") & F.col("year").between(first_year, last_year))


def papers_by_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.sum("citation_count").alias("citations"))


def library_search(rows: DataFrame, edges: DataFrame, first_year: int, last_year: int, limit: int = 25) -> DataFrame:
    """The first papers of a range of years, with the numbers of papers in it and of edges at all."""
    found = rows.filter(F.col("year").between(first_year, last_year))
    return found.orderBy("seq").limit(limit).withColumns({"n_papers": F.lit(found.count()).cast("bigint"), "n_edges": F.lit(edges.count()).cast("bigint")})


def research_edges(rows: DataFrame, subject: int | None = None, predicate: int | None = None) -> DataFrame:
    tests = [F.col("subject_hash") == subject] if subject is not None else []
    tests += [F.col("predicate_id") == predicate] if predicate is not None else []
    return reduce(DataFrame.filter, tests, rows)


def concept(rows: DataFrame, concept_id: int) -> DataFrame:
    """The first live concept of an id."""
    return rows.filter((F.col("concept_id") == concept_id) & (F.col("flags").bitwiseAND(1) == 0)).orderBy("seq").limit(1)


def axioms(rows: DataFrame, subject_id: int, predicate: int | None = None) -> DataFrame:
    """Axioms of a subject; predicate 2 are its approved analogies."""
    found = rows.filter(F.col("subject_id") == subject_id)
    return found if predicate is None else found.filter(F.col("predicate") == predicate)


def array_slice(chunks: DataFrame, ranges: list[tuple[int, int]], fill: int) -> DataFrame:
    """(c0, c1, ..., value) of each cell of half-open ranges; cells of missing chunks have the fill value.

    ``chunks`` (chunk_coords, shape, data): the first cell of each chunk, its extent, and its cells in row order. An
    empty range gives no rows. Only chunks that overlap the ranges are opened.
    """
    names = [f"c{i}" for i in range(len(ranges))]
    spark = chunks.sparkSession
    if any(b <= a for a, b in ranges):
        return spark.createDataFrame([], ", ".join([*(f"{n} bigint" for n in names), "value bigint"]))
    overlap = reduce(lambda x, y: x & y, ((F.col("chunk_coords")[i] < b) & (F.col("chunk_coords")[i] + F.col("shape")[i] > a) for i, (a, b) in enumerate(ranges)))
    cells = chunks.filter(overlap).select("chunk_coords", "shape", F.posexplode("data").alias("at", "value"))
    rest: Column = F.col("at").cast("bigint")
    places: list[Column] = []
    for i in reversed(range(len(ranges))):
        places.insert(0, F.col("chunk_coords")[i] + rest % F.col("shape")[i])
        rest = F.floor(rest / F.col("shape")[i])
    cells = cells.select(*(p.alias(n) for p, n in zip(places, names, strict=True)), F.col("value").cast("bigint").alias("value"))
    grid = spark.range(ranges[0][0], ranges[0][1]).toDF(names[0])
    for n, (a, b) in zip(names[1:], ranges[1:], strict=True):
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(a).cast("bigint"), F.lit(b - 1).cast("bigint"))))
    return grid.join(cells, names, "left").withColumn("value", F.coalesce("value", F.lit(fill).cast("bigint")))


def jumps(rows: DataFrame, order: str, axes: tuple[str, ...], by: str) -> DataFrame:
    """Average and largest distance between neighbours along a curve, within each partition ``by`` of it."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    squares = sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes), F.lit(0.0))
    return rows.withColumn("jump", F.sqrt(squares)).agg(F.avg("jump").alias("avg_jump"), F.max("jump").alias("max_jump"))


def active_agents(rows: DataFrame, agent_id: int | None = None) -> DataFrame:
    """Agents whose flags say active (1) and not disabled (2)."""
    found = rows.filter((F.col("flags").bitwiseAND(1) != 0) & (F.col("flags").bitwiseAND(2) == 0))
    return found if agent_id is None else found.filter(F.col("agent_id") == agent_id)


def first_manifest(rows: DataFrame) -> DataFrame:
    return rows.orderBy("seq").limit(1)


def hulls(rows: DataFrame, axes: tuple[str, ...] = ("px", "py", "pz"), by: str = "tile_id") -> DataFrame:
    """Smallest box around each tile's positions."""
    return rows.groupBy(by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n"))


def meeting(boxes: DataFrame, low: list[float], high: list[float], axes: tuple[str, ...] = ("px", "py", "pz")) -> DataFrame:
    """Tiles whose box meets a query box; all others can be skipped."""
    test = F.lit(True)
    for a, x, y in zip(axes, low, high, strict=True):
        test = test & (F.col(f"max_{a}") >= x) & (F.col(f"min_{a}") <= y)
    return boxes.filter(test)


def topic_coordinates(title: str | Column, doi: str | Column, salts: tuple[str, str, str] = ("x", "y", "z")) -> list[Column]:
    """Three coordinates in [0, 1): the means of the hashes of a title's words, else the hash of the DOI."""
    from skarn.functions.text import words

    unit = lambda salt, w: F.conv(F.substring(F.md5(F.concat(F.lit(salt + "\x1f"), w)), 1, 8), 16, 10).cast("double") / 4294967296.0
    tokens = words(title)
    doi = F.col(doi) if isinstance(doi, str) else doi
    mean = lambda salt: F.aggregate(F.transform(tokens, lambda w: unit(salt, w)), F.lit(0.0), lambda a, x: a + x) / F.size(tokens)
    return [F.when(F.size(tokens) > 0, mean(s)).otherwise(unit(s, doi)) for s in salts]


def edge_readings(rows: DataFrame) -> DataFrame:
    """Device records (min_ts_ms, delta_ms, code, base, step, seal_ok, ...) as readings; a broken seal is an error."""
    good = F.when(F.col("seal_ok"), F.col("code")).otherwise(F.raise_error(F.lit("a device seal does not verify")).cast("int"))
    return rows.withColumns({"timestamp": F.col("min_ts_ms") + F.col("delta_ms"), "value": F.col("base") + good * F.col("step")}).drop("min_ts_ms", "delta_ms", "code", "base", "step", "seal_ok")
