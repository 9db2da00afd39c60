"""Sessions of people and agents: bundles, pointers, and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators.governance import consent_gate


def human_lrs(rows: DataFrame, session: str | None = None, actor_hash: int | None = None, start: int = 0, end: int = 2**63 - 1) -> DataFrame:
    """Human decisions in time, of a session and of an actor; tombstones are left out."""
    found = rows.filter(F.col("timestamp_sec").between(start, end) & (F.col("flags").bitwiseAND(1) == 0))
    found = found if session is None else found.filter(F.col("session_uuid") == session)
    return found if actor_hash is None else found.filter(F.col("actor_hash") == actor_hash)


def ai_traces(rows: DataFrame, session: str | None = None, agent_id: int | None = None, start: int = 0, end: int = 2**63 - 1) -> DataFrame:
    found = rows.filter(F.col("timestamp_sec").between(start, end) & (F.col("flags").bitwiseAND(1) == 0))
    found = found if session is None else found.filter(F.col("session_uuid") == session)
    return found if agent_id is None else found.filter(F.col("agent_id") == agent_id)


def learning_activities(rows: DataFrame, start: int = 0, end: int = 2**63 - 1, actor_id: int | None = None, verb_id: int | None = None, consents: DataFrame | None = None, purpose: int | None = None, now: int = 0) -> DataFrame:
    """Activities in time, of an actor and of a verb; with a purpose only those of actors who consent to it now."""
    found = rows.filter(F.col("timestamp_sec").between(start, end) & (F.col("flags").bitwiseAND(1) == 0))
    found = found if actor_id is None else found.filter(F.col("actor_id") == actor_id)
    found = found if verb_id is None else found.filter(F.col("verb_id") == verb_id)
    return found if consents is None else consent_gate(found, consents, "actor_id", purpose, now)


def bundle(humans: DataFrame, traces: DataFrame) -> DataFrame:
    """(session_uuid, side, timestamp_sec, who, score): both sides of each session as tagged rows.

    A union, not a join: a session of m decisions and n traces gives m + n rows.
    """
    side = lambda rows, name, who, score: rows.select("session_uuid", F.lit(name).alias("side"), "timestamp_sec", F.col(who).alias("who"), F.col(score).alias("score"))
    return side(humans, "human", "actor_hash", "decision_score").unionByName(side(traces, "ai", "agent_id", "confidence"))


def dereference(rows: DataFrame, pointer: str, targets: DataFrame) -> DataFrame:
    """``rows`` joined to the records that a stored coordinate (``L0:T<tile>:R<row>``) points at."""
    tile = F.regexp_extract(pointer, "T(\\d+)", 1).cast("bigint")
    row = F.regexp_extract(pointer, "R(\\d+)", 1).cast("bigint")
    return rows.withColumns({"_tile": tile, "_row": row}).join(targets, (F.col("_tile") == targets["tile_id"]) & (F.col("_row") == targets["record_offset"])).drop("_tile", "_row")


def aggregate(humans: DataFrame, traces: DataFrame) -> DataFrame:
    """One row for each session of either side; a time of 0 is no first time, and a side without rows has no mean."""
    rows = bundle(humans, traces)
    human, ai = F.col("side") == "human", F.col("side") == "ai"
    first = F.coalesce(F.min(F.when(F.col("timestamp_sec") != 0, F.col("timestamp_sec"))), F.lit(0))
    return rows.groupBy("session_uuid").agg(
        first.alias("first_ts"),
        F.max("timestamp_sec").alias("last_ts"),
        (F.max("timestamp_sec") - first).alias("duration"),
        F.count_if(human).alias("n_humans"),
        F.count_if(ai).alias("n_ais"),
        F.countDistinct(F.when(human, F.col("who"))).alias("n_actors"),
        F.countDistinct(F.when(ai, F.col("who"))).alias("n_agents"),
        F.round(F.avg(F.when(human, F.col("score"))), 4).alias("mean_score"),
        F.round(F.avg(F.when(ai, F.col("score"))), 4).alias("mean_confidence"),
    )


def tab_lines(table: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(part, line) of a tab-separated export: three header lines (names, kinds, roles), then the rows."""
    spark = table.sparkSession
    heads = ["\t".join(table.columns), "\t".join(kinds.get(c, "continuous") for c in table.columns), "\t".join("meta" if kinds.get(c) == "string" else "" for c in table.columns)]
    head = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "part int, line string")
    return head.unionByName(table.select(F.lit(3).alias("part"), F.concat_ws("\t", *(T.tsv_cell(c) for c in table.columns)).alias("line")))
