"""Versioned telemetry: point reads, filtered reads of the latest versions, fusion, compaction and changes.

Records are keyed by (sensor_id, metric_id, timestamp); ``seq`` is the order of appending. A record whose ``flags`` has
bit 1 is a tombstone. "Latest" is always an aggregate (``max_by``) with partial results on the map side, so one hot
sensor never gathers in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("sensor_id", "metric_id", "timestamp")
COLUMNS = ("timestamp", "sensor_id", "metric_id", "value", "flags", "seq")


def is_tombstone(flags: str | Column = "flags") -> Column:
    return F.col(flags).bitwiseAND(1) != 0 if isinstance(flags, str) else flags.bitwiseAND(1) != 0


def fetch(records: DataFrame, tile_id: int, record_offset: int) -> DataFrame:
    """The raw record at a coordinate, whatever its marks or versions; both filters reach the Parquet scan."""
    return records.filter((F.col("tile_id") == tile_id) & (F.col("record_offset") == record_offset)).limit(1)


def coordinate(level: Column | int = 0) -> Column:
    """``L0:T<tile_id>:R<record_offset>``."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.lit("L"), level, F.lit(":T"), F.col("tile_id"), F.lit(":R"), F.col("record_offset"))


def latest(records: DataFrame, key: tuple[str, ...] = KEY, order: str = "seq") -> DataFrame:
    """The last version of each key in order of ``order``; later versions win, whatever they hold."""
    rest = [c for c in records.columns if c not in key]
    found = records.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return found.select(*key, "_last.*").select(*records.columns)


def live(records: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The last version of each key, without keys whose last version is a tombstone."""
    return latest(records, key).filter(~is_tombstone())


def in_range(records: DataFrame, start: int | None = None, end: int | None = None, sensor_id: int | None = None, metric_id: int | None = None) -> DataFrame:
    """Inclusive time range and equal ids. All are parts of the key, so filtering before the versions are resolved is exact."""
    tests = [F.col("timestamp") >= start if start is not None else None, F.col("timestamp") <= end if end is not None else None, F.col("sensor_id") == sensor_id if sensor_id is not None else None, F.col("metric_id") == metric_id if metric_id is not None else None]
    return reduce(DataFrame.filter, [t for t in tests if t is not None], records)


def sift(records: DataFrame, start: int | None = None, end: int | None = None, sensor_id: int | None = None, metric_id: int | None = None, limit: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """Latest live record of each key in a range, in order of (sensor_id, metric_id, timestamp).

    ``hidden`` (tile_id, record_offset) is left out before versions are resolved: hiding the newest version shows the
    older one again.
    """
    found = in_range(records, start, end, sensor_id, metric_id)
    if hidden is not None:
        found = found.join(hidden, ["tile_id", "record_offset"], "left_anti")
    found = live(found).orderBy(*KEY)
    return found if limit is None else found.limit(limit)


def fuse(*archives: DataFrame) -> DataFrame:
    """Latest live records over several archives; an archive named later is newer. In order of time."""
    tagged = [a.withColumn("_archive", F.lit(i)) for i, a in enumerate(archives)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    both = both.withColumn("_order", F.struct("_archive", "seq"))
    return latest(both, order="_order").filter(~is_tombstone()).drop("_archive", "_order").orderBy("timestamp", "sensor_id", "metric_id")


def compact(records: DataFrame, erased: DataFrame | None = None, held: bool = False) -> DataFrame:
    """Every record that no later tombstone or erasure of its key removes; different versions of a key all stay.

    ``erased`` holds hashes (``record_hash``) of erased records: such a record goes, with all earlier ones of its key.
    Under a legal hold (``held``) tombstones stay as records, and an erased record is an error.
    """
    dead = is_tombstone()
    marked = records.withColumn("_erased", F.lit(False))
    if erased is not None:
        hashes = erased.select(F.col("erased_record_hash").alias("_hash")).distinct().withColumn("_found", F.lit(True))
        marked = records.withColumn("_hash", record_hash()).join(hashes, "_hash", "left").withColumn("_erased", F.coalesce("_found", F.lit(False))).drop("_hash", "_found")
        if held:
            marked = marked.withColumn("_erased", F.when(F.col("_erased"), F.raise_error(F.lit("an erased record is under legal hold")).cast("boolean")).otherwise(F.lit(False)))
    ends = marked.filter(dead | F.col("_erased")).groupBy(*KEY).agg(F.max("seq").alias("_end"))
    kept = marked.join(ends, list(KEY), "left").filter(F.col("_end").isNull() | (F.col("seq") > F.col("_end")) | (F.lit(held) & dead))
    return kept.select(*records.columns)


def record_hash() -> Column:
    """SHA-256 of a record's values, the identity that erasures name."""
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("timestamp", "sensor_id", "metric_id", "value", "flags"))), 256)


def inserted(records: DataFrame, rows: DataFrame) -> DataFrame:
    """``records`` with ``rows`` (timestamp, sensor_id, metric_id, value) appended; a later row gets a later ``seq``, not always the next one."""
    last = records.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    new = rows.withColumns({"flags": F.lit(0).cast("bigint"), "seq": F.lit(last + 1) + F.monotonically_increasing_id()})
    return records.unionByName(new, allowMissingColumns=True)


def tombstones(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Tombstones for those ``keys`` (sensor_id, metric_id, timestamp) that have a live record; others are no-ops."""
    keys = keys.select(*KEY).distinct()
    alive = live(records.join(keys, list(KEY), "left_semi"))
    last = records.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    dead = alive.withColumns({"value": F.lit(0.0), "flags": F.lit(1).cast("bigint"), "seq": F.lit(last + 1) + F.monotonically_increasing_id()})
    return dead.select(*(c for c in records.columns if c in COLUMNS))


def deleted(records: DataFrame, keys: DataFrame) -> DataFrame:
    return records.unionByName(tombstones(records, keys), allowMissingColumns=True)


def updated(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Delete then insert, for keys that have a live record."""
    gone = tombstones(records, rows)
    new = rows.select(*KEY, "value").join(gone.select(*KEY), list(KEY), "left_semi")
    return inserted(records.unionByName(gone, allowMissingColumns=True), new)


def purged(records: DataFrame, keys: DataFrame, held_subjects: DataFrame | None = None) -> DataFrame:
    """Delete ``keys``; an error if a key's sensor is a subject under legal hold."""
    if held_subjects is not None:
        held = held_subjects.select(F.col("subject_id").cast("bigint").alias("sensor_id")).distinct().withColumn("_held", F.lit(True))
        keys = keys.join(held, "sensor_id", "left").withColumn("sensor_id", F.when(F.col("_held"), F.raise_error(F.lit("subject is under legal hold")).cast("bigint")).otherwise(F.col("sensor_id"))).drop("_held")
    return deleted(records, keys)


def live_counts(records: DataFrame) -> DataFrame:
    """(n, checksum) of the live set: equal before and after a rewrite that conserves it."""
    return live(records).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*COLUMNS[:5])), F.lit(0)).alias("checksum"))


def tile_stats(records: DataFrame) -> DataFrame:
    """Time range, rows and distinct sensors of each tile, what a footer would hold."""
    return records.groupBy("tile_id").agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"), F.count("*").alias("n"), F.countDistinct("sensor_id").alias("sensors"))


def prunable(stats: DataFrame, start: int, end: int) -> DataFrame:
    """Tiles whose time range misses [start, end]; skipping them never changes a result."""
    return stats.filter((F.col("max_ts") < start) | (F.col("min_ts") > end))


def stats_tree(stats: DataFrame, branch: int = 8) -> DataFrame:
    """Levels above the tiles, each node the range of ``branch`` nodes below it; (depth, node, min_ts, max_ts, n)."""
    level = stats.select(F.lit(0).alias("depth"), F.col("tile_id").alias("node"), "min_ts", "max_ts", "n")
    top = stats.agg(F.max("tile_id")).first()[0] or 0
    levels, depth = [level], 0
    while top > 0:
        depth, top = depth + 1, top // branch
        level = level.groupBy(F.floor(F.col("node") / branch).alias("node")).agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("n").alias("n")).select(F.lit(depth).alias("depth"), "node", "min_ts", "max_ts", "n")
        levels.append(level)
    return reduce(DataFrame.unionAll, levels)
