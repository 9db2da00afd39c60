"""Streams drained over a table's files; each must equal its batch counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.plans.queries import EPOCH, METRIC
from skarn.sources import adapters as A
from skarn.streaming import ingest
from skarn.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.table_source(spark, sf_dir, "events")


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives until its source is drained, from the folder that its batches went to."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    ingest.run(stream, ingest.to_parquet(f"{folder}/out"), f"{folder}/state", mode=mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")


@query(f"select event_id as seq, user_id as sensor_id, {METRIC} as metric_id, value from events")
def k2_drained_ingest(spark, sf_dir):
    """Every event reaches the archive once."""
    return _drained(spark, _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("sensor_id"), A._code(A.METRICS, "event_type").alias("metric_id"), "value"))


@query(f"select make_timestamp(({EPOCH} // 86400) * 86400000000) as start, user_id as sensor_id, count(*) as n, round(sum(value), 4) as total from events group by all having ({EPOCH} // 86400) * 86400 + 86400 <= (select floor(max(epoch(ts)))::BIGINT - 600 from events)".replace(" group by all having", " group by ({0} // 86400), user_id having".format(EPOCH)))
def k6_windows(spark, sf_dir):
    """Daily counts of each user, of the days that the watermark has closed."""
    rows = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("sensor_id"), "value")
    found = _drained(spark, ingest.windowed(rows, size="1 day"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "sensor_id", "n", F.round("total", 4).alias("total"))


@query(f"with t as (select event_id as seq, user_id as sensor_id, {METRIC} as metric_id, ({EPOCH} // 86400) * 86400 as timestamp, value, json_extract_string(props, '$.k')::BIGINT % 10 = 0 as dead from events), r as (select *, row_number() over (partition by sensor_id, metric_id, timestamp order by seq desc) as rn from t) select sensor_id, metric_id, timestamp, value from r where rn = 1 and not dead")
def k3_latest_live(spark, sf_dir):
    """The last versions after the drained stream equal the batch read."""
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("sensor_id"), A._code(A.METRICS, "event_type").alias("metric_id"), (F.floor(A.epoch() / A.DAY) * A.DAY).alias("timestamp"), "value", F.when(A._k() % 10 == 0, 1).otherwise(0).cast("bigint").alias("flags"))
    return _drained(spark, ingest.latest_live(rows), "complete").select("sensor_id", "metric_id", "timestamp", "value")


@query("select user_id % 20 as session, row_number() over (partition by user_id % 20 order by event_id) as delta_seq, 'applied' as outcome from events")
def k7_in_sequence(spark, sf_dir):
    """Deltas numbered by their session, arriving mixed over four micro-batches: all are applied in the end, none is lost."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).cast("string").alias("session"), F.row_number().over(Window.partitionBy(F.col("user_id") % 20).orderBy("event_id")).cast("bigint").alias("delta_seq"), F.xxhash64("event_id").alias("mixed"))
    folder = f"{shared_folder(spark)}/deltas/{uuid.uuid4().hex}"
    rows.repartition(4, "mixed").sortWithinPartitions("mixed").drop("mixed").write.parquet(folder)
    return _drained(spark, ingest.in_sequence(ingest.source(spark, folder, rows.drop("mixed").schema, 1), hold=True)).select(F.col("session").cast("bigint").alias("session"), "delta_seq", "outcome")


@query("with recursive r as (select (user_id % 20)::VARCHAR as device, event_id as seq, event_type as payload, row_number() over (partition by user_id % 20 order by event_id) as i from events), c as (select device, i, seq, '' as prev_seal, sha256('|' || seq || '|' || payload) as seal from r where i = 1 union all select r.device, r.i, r.seq, c.seal, sha256(c.seal || '|' || r.seq || '|' || r.payload) from c join r on r.device = c.device and r.i = c.i + 1) select device, seq, prev_seal, seal from c")
def k5_sealed(spark, sf_dir):
    """Each record's seal covers the one before it on its device."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 20).cast("string").alias("device"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return _drained(spark, ingest.sealed(rows))
