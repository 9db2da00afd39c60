"""Archives as folders of Parquet tables, and imports and exports of other formats."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skarn.functions import text as T
from skarn.schema import MARKS, REGISTRY, require_pack

#: Names under which the columns of readings are known.
ALIASES = {"timestamp": ("timestamp", "time", "ts"), "sensor_id": ("sensor_id", "sensor"), "metric_id": ("metric_id", "metric"), "value": ("value", "val")}
KEYS = ("id", "key", "name")
TILE_ROWS = 1 << 16
ROW = (1 << 33) - 1


class Archive:
    """A folder with one Parquet table for each record type; appended rows get ``seq`` and a coordinate."""

    def __init__(self, spark: SparkSession, path: str, addon_mask: int = 255) -> None:
        self.spark, self.path, self.mask = spark, path.rstrip("/"), addon_mask

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """A record type's table; its schema is known, never inferred from data."""
        kind = REGISTRY.get(name)
        if kind:
            require_pack(kind.pack, self.mask)
            schema = StructType.fromDDL(f"{kind.ddl}, seq bigint, tile_id bigint, record_offset bigint")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self._at(name))

    def append(self, name: str, rows: DataFrame, bloom: str | None = None, sort: list[str] | None = None) -> DataFrame:
        """Append rows in their order; ``bloom`` names a column whose files get a Bloom filter, ``sort`` a clustering.

        Rows are numbered without a global sort: those of each partition are counted, and a partition's rows follow
        those of the partitions before it. Only one count for each partition reaches the driver. Every append stages
        its rows in a folder of its own, which the returned frame reads. One writer at a time appends to a table.
        """
        if name in REGISTRY:
            require_pack(REGISTRY[name].pack, self.mask)
        rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else rows
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}/{name}"
        numbered = rows.withColumn("_id", F.monotonically_increasing_id())
        numbered.write.parquet(staged)
        kept = self.spark.read.schema(numbered.schema).parquet(staged)
        counts = kept.groupBy(F.shiftright("_id", 33).alias("p")).count().orderBy("p").collect()
        start = self._next_seq(name)
        offsets, at = [], start
        for r in counts:
            offsets.append((r.p, at))
            at += r["count"]
        table = F.broadcast(self.spark.createDataFrame(offsets, "_p bigint, _start bigint"))
        seq = F.col("_start") + F.col("_id").bitwiseAND(ROW)
        out = kept.withColumn("_p", F.shiftright("_id", 33)).join(table, "_p").withColumn("seq", seq)
        out = out.withColumns({"tile_id": F.floor(F.col("seq") / TILE_ROWS), "record_offset": F.col("seq") % TILE_ROWS}).drop("_id", "_p", "_start")
        writer = out.write.mode("append")
        if bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
        writer.parquet(self._at(name))
        return out

    def _next_seq(self, name: str) -> int:
        try:
            last = self.spark.read.parquet(self._at(name)).agg(F.max("seq")).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            last = None
        return 0 if last is None else last + 1

    def replace(self, name: str, rows: DataFrame, to: str) -> str:
        """Write a rewritten table (a compaction, a fusion) to another archive; readers of this one see no change."""
        rows.write.mode("overwrite").parquet(f"{to.rstrip('/')}/{name}")
        return to

    def copy(self, names: list[str], to: str) -> None:
        """Copy tables as they are, known types or not."""
        for name in names:
            self.spark.read.parquet(self._at(name)).write.mode("overwrite").parquet(f"{to.rstrip('/')}/{name}")

    def cold(self, name: str, tier: Column, least: int, to: str) -> int:
        """Copy records of tiers at or above ``least`` to a colder place, a folder for each tier; how many."""
        rows = self.read(name).withColumn("tier", tier).filter(F.col("tier") >= least)
        rows.write.mode("overwrite").partitionBy("tier").parquet(to)
        return self.spark.read.parquet(to).count()


def snapshot(tables: dict[str, DataFrame], marks: DataFrame) -> dict[str, DataFrame]:
    """All tables with their hidden rows as they stand, and of the marks only quarantine, withdrawal and legal hold.

    Whoever takes a snapshot in appends its tables, which gives their rows new coordinates, and lets the marks follow
    through the map of old to new (``remapped``).
    """
    kinds = (MARKS["quarantine"], MARKS["consent_withdrawn"], MARKS["legal_hold"])
    return {**tables, "marks": marks.filter(F.col("mark_kind").isin(*kinds))}


def remapped(marks: DataFrame, places: DataFrame) -> DataFrame:
    """Marks at the new coordinates of their targets; ``places`` (target..., new_tile_id, new_index)."""
    key = ["target_tile_type", "target_tile_id", "record_index"]
    moved = marks.join(places, key).withColumns({"target_tile_id": F.col("new_tile_id"), "record_index": F.col("new_index")})
    return moved.select(*marks.columns)


def delta_violations(entries: DataFrame) -> DataFrame:
    """(seq, why) of a delta's entries that may not be applied: a delta with any is refused as a whole.

    Marks may only set review (2) and withdrawal (3), and clear review; the agent registry (18) is closed.
    """
    why = F.when(F.col("tile_type") == 18, "forbidden").when(~F.col("tile_type").isin(10, 11, 12, 13, 14, 19, 20), "unknown").when((F.col("tile_type") == 19) & (F.col("set_or_clear") == 1) & ~F.col("mark_kind").isin(2, 3), "unauthorised").when((F.col("tile_type") == 19) & (F.col("set_or_clear") == 0) & F.col("mark_kind").isin(1, 3, 4), "unauthorised")
    return entries.select("seq", why.alias("why")).filter("why is not null")


def delta_outcome(delta_seq: int, last_applied: int, entries: DataFrame) -> str:
    """replay (nothing to do), gap, refused, or apply."""
    if delta_seq <= last_applied:
        return "replay"
    if delta_seq > last_applied + 1:
        return "gap"
    return "apply" if delta_violations(entries).isEmpty() else "refused"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names trimmed and lower-cased."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.toDF(*(c.strip().lower() for c in raw.columns))


def readings_from_csv(raw: DataFrame, now: int) -> DataFrame:
    """Readings from text columns: bad numbers are 0, bad times are ``now``."""
    names = {k: next((a for a in v if a in raw.columns), None) for k, v in ALIASES.items()}
    if None in names.values():
        raise ValueError("no readings: " + ", ".join(k for k, v in names.items() if v is None))
    num = lambda k, kind, other: F.coalesce(F.trim(F.col(names[k])).try_cast(kind), F.lit(other).cast(kind)).alias(k)
    return raw.select(num("timestamp", "bigint", now), num("sensor_id", "bigint", 0), num("metric_id", "bigint", 0), num("value", "double", 0.0))


def typed_cell(c: str | Column) -> Column:
    """JSON text of a cell: an integer, else a number, else a string; an absent cell is an empty string."""
    v = F.coalesce(F.trim(c if isinstance(c, Column) else F.col(c)), F.lit(""))
    text = F.to_json(F.struct(v.alias("v")))
    number = v.rlike("^-?\\d+\\.\\d+$") & v.try_cast("double").isNotNull()
    return F.when(v.rlike("^-?(0|[1-9]\\d{0,17})$"), v).when(number, v.try_cast("double").cast("string")).otherwise(text.substr(F.lit(6), F.length(text) - 6))


def documents_from_csv(raw: DataFrame, stem: str) -> DataFrame:
    """(key, content): one JSON document for each row, by its id, key or name column, else ``stem:row``."""
    key = next((F.col(k) for k in KEYS if k in raw.columns), None)
    row = F.concat(F.lit(stem + ":"), F.monotonically_increasing_id())
    cells = [F.concat(F.lit(f'"{c}":'), typed_cell(c)) for c in raw.columns]
    return raw.select((row if key is None else F.coalesce(key, row)).alias("key"), F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("content"))


def documents_from_json(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(key, content) from JSON files that hold an array of objects, or an object of key to value."""
    raw = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    pairs = F.map_entries(F.from_json("value", "map<string,string>"))
    arrays = raw.filter(F.ltrim("value").startswith("[")).select(F.posexplode(items).alias("i", "content"))
    arrays = arrays.select(F.coalesce(F.get_json_object("content", "$.id"), F.get_json_object("content", "$.key"), F.concat(F.lit(stem + ":"), F.col("i"))).alias("key"), "content")
    objects = raw.filter(F.ltrim("value").startswith("{")).select(F.inline(pairs)).toDF("key", "content")
    return arrays.unionByName(objects)


def read_ndjson(spark: SparkSession, path: str, record_type: str) -> DataFrame:
    """Typed NDJSON of a record type."""
    return spark.read.schema(REGISTRY[record_type].schema).json(path)


def union_of_keys(documents: DataFrame) -> DataFrame:
    """Documents (key, content) as one table with a column for each top-level name, in order of first appearance."""
    names = documents.select("seq", F.posexplode(F.json_object_keys("content")).alias("i", "name"))
    order = names.groupBy("name").agg(F.min(F.struct("seq", "i")).alias("f")).orderBy("f").select("name").collect()
    return documents.select("key", *(F.get_json_object("content", f"$['{r.name}']").alias(r.name) for r in order))


def csv_lines(table: DataFrame) -> DataFrame:
    """(part, line): a header and the rows as CSV text."""
    head = table.sparkSession.createDataFrame([(0, ",".join(table.columns))], "part int, line string")
    return head.unionByName(table.select(F.lit(1).alias("part"), F.concat_ws(",", *(T.csv_cell(c) for c in table.columns)).alias("line")))


#: Fixed value: what trajectories say to the model first.
SYSTEM = "You review research step by step and cite what you rely on."


def chatml(turns: DataFrame, permitted: DataFrame | None = None) -> DataFrame:
    """(conv_id, json) in ChatML: messages (role, content) in order of turn; only permitted conversations, where given."""
    rows = turns if permitted is None else turns.join(permitted.select("conv_id"), "conv_id", "left_semi")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return lists.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), messages.alias("messages"))).alias("json"))


def sharegpt(turns: DataFrame, permitted: DataFrame | None = None) -> DataFrame:
    """(conv_id, json) in ShareGPT form: (from, value) with human, gpt and system."""
    rows = turns if permitted is None else turns.join(permitted.select("conv_id"), "conv_id", "left_semi")
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value")))).alias("m"))
    said = F.transform("m", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    return lists.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), said.alias("conversations"))).alias("json"))


def iceberg_schema(table: DataFrame, name: str) -> dict:
    """Schema part of a table's Iceberg metadata, from the table itself."""
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "binary": "binary"}
    return {"format-version": 2, "table": name, "schema": {"type": "struct", "fields": [{"id": i, "name": c, "required": False, "type": kinds.get(t, t)} for i, (c, t) in enumerate(table.dtypes, 1)]}}


def delta_commit(table: DataFrame, name: str, files: list[str]) -> list[dict]:
    """Entries of a first Delta commit for existing files: protocol, schema and the files."""
    return [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": name, "format": {"provider": "parquet"}, "schemaString": table.schema.json(), "partitionColumns": []}}, *({"add": {"path": f, "dataChange": True}} for f in files)]


def answered(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Batch requests (row, query) answered by coordinate (``L0:T<tile>:R<row>``), else an error, one row for each."""
    where = {"_tile": F.regexp_extract("query", "^L\\d+:T(\\d+):R\\d+$", 1).try_cast("bigint"), "_row": F.regexp_extract("query", "^L\\d+:T\\d+:R(\\d+)$", 1).try_cast("bigint")}
    asked = requests.withColumns(where)
    found = records.select(F.col("tile_id").alias("_tile"), F.col("record_offset").alias("_row"), "value")
    joined = asked.join(found, ["_tile", "_row"], "left")
    return joined.select("row", "value", F.when(F.col("_tile").isNull(), "malformed").when(F.col("value").isNull(), "not_found").alias("error"))


def unioned(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
