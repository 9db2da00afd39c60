"""Marks, consent, legal hold, erasure and hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skarn.schema import MARKS, WHOLE_TILE

TARGET = ("target_tile_type", "target_tile_id", "record_index")
HIDING = (MARKS["quarantine"], MARKS["consent_withdrawn"], MARKS["retention_expired"])


def mark_states(marks: DataFrame) -> DataFrame:
    """The last mark of each target and kind in order of ``seq``: (target..., mark_kind, is_set, timestamp, seq)."""
    last = F.max_by(F.struct((F.col("set_or_clear") == 1).alias("is_set"), "timestamp", "seq"), "seq")
    return marks.groupBy(*TARGET, "mark_kind").agg(last.alias("m")).select(*TARGET, "mark_kind", "m.*")


def active_marks(marks: DataFrame) -> DataFrame:
    """Marks that are set, by target and kind."""
    return mark_states(marks).filter("is_set").select(*TARGET, "mark_kind", "timestamp", "seq").orderBy(*TARGET, "mark_kind")


def with_marks(records: DataFrame, marks: DataFrame, tile_type: int, kinds: tuple[int, ...]) -> DataFrame:
    """``records`` (tile_id, record_offset) with ``marked``: whether any of ``kinds`` holds.

    A record's own state of a kind goes before its tile's; without either the kind is not set.
    """
    states = mark_states(marks.filter((F.col("target_tile_type") == tile_type) & F.col("mark_kind").isin(list(kinds))))
    state = lambda where: states.filter(where).groupBy("target_tile_id", "record_index")
    wide = [F.max(F.when(F.col("mark_kind") == k, F.col("is_set"))).alias(f"m{k}") for k in kinds]
    own = state(F.col("record_index") != WHOLE_TILE).agg(*wide).select(F.col("target_tile_id").alias("tile_id"), F.col("record_index").alias("record_offset"), *(F.col(f"m{k}").alias(f"_own{k}") for k in kinds))
    tile = state(F.col("record_index") == WHOLE_TILE).agg(*wide).select(F.col("target_tile_id").alias("tile_id"), *(F.col(f"m{k}").alias(f"_tile{k}") for k in kinds))
    joined = records.join(own, ["tile_id", "record_offset"], "left").join(tile, "tile_id", "left")
    marked = F.lit(False)
    for k in kinds:
        marked = marked | F.coalesce(f"_own{k}", f"_tile{k}", F.lit(False))
    return joined.withColumn("marked", marked).select(*records.columns, "marked")


def visible(records: DataFrame, marks: DataFrame, tile_type: int, erased: DataFrame | None = None, record_hash: Column | None = None, include_hidden: bool = False) -> DataFrame:
    """Records that are neither withdrawn, quarantined, retention-expired nor erased."""
    if include_hidden:
        return records
    found = with_marks(records, marks, tile_type, HIDING).filter(~F.col("marked")).drop("marked")
    if erased is not None and record_hash is not None:
        hashes = erased.select(F.col("erased_record_hash").alias("_hash")).distinct()
        found = found.withColumn("_hash", record_hash).join(hashes, "_hash", "left_anti").drop("_hash")
    return found


def consent_states(consents: DataFrame, by_study: bool = False) -> DataFrame:
    """The last consent record of each subject and purpose (and study)."""
    key = ["subject_id", "purpose", *(["study_id"] if by_study else [])]
    rest = [c for c in consents.columns if c not in key]
    return consents.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("c")).select(*key, "c.*")


def consented(consents: DataFrame, purpose: int, now: int, study_id: int | None = None) -> DataFrame:
    """Subjects whose last record for a purpose is neither withdrawn nor expired."""
    rows = consents.filter(F.col("purpose") == purpose)
    if study_id is not None:
        rows = rows.filter(F.col("study_id") == study_id)
    alive = (F.col("withdrawn_at") == 0) & ((F.col("expires_at") == 0) | (F.col("expires_at") >= now))
    return consent_states(rows).filter(alive).select("subject_id")


def consent_gate(records: DataFrame, consents: DataFrame, subject: str, purpose: int | None, now: int) -> DataFrame:
    """Records of consenting subjects; without a purpose nothing is asked, with one an absent consent hides."""
    if purpose is None:
        return records
    allowed = consented(consents, purpose, now)
    return records.join(allowed, records[subject].cast("string") == allowed["subject_id"], "left_semi")


def legal_holds(consents: DataFrame) -> DataFrame:
    """Subjects with a hold in the last record of any study and purpose."""
    return consent_states(consents, by_study=True).filter("legal_hold <> 0").select("subject_id").distinct()


def grant(subject_id: str, study_id: int, purpose: int, scope: int, granted_at: int, expires_at: int = 0, legal_hold: bool = False, granted_by: int = 0) -> dict:
    return {"subject_id": subject_id, "study_id": study_id, "purpose": purpose, "scope": scope, "granted_at": granted_at, "expires_at": expires_at, "withdrawn_at": 0, "legal_hold": int(legal_hold), "granted_by": granted_by}


def erasures(requests: DataFrame, marks: DataFrame, holds: DataFrame, by_agent: bool = False) -> DataFrame:
    """Requests (erased_record_hash, target..., subject_id, seq) that may be carried out: once for each target, not held.

    A target under a legal-hold mark or a subject under legal hold blocks its request; agents may not erase at all.
    """
    if by_agent:
        raise PermissionError("agents may not erase")
    held = mark_states(marks.filter(F.col("mark_kind") == MARKS["legal_hold"])).filter("is_set").select(*TARGET)
    once = requests.groupBy(*TARGET).agg(F.min_by(F.struct(*[c for c in requests.columns if c not in TARGET]), "seq").alias("r")).select(*TARGET, "r.*")
    return once.join(held, list(TARGET), "left_anti").join(holds, "subject_id", "left_anti")


def chained(rows: DataFrame, by: list[str], order: str, body: Column) -> DataFrame:
    """``rows`` whose hash covers the body and the hash before it, as a fold over each chain.

    A link depends on the one before, so a chain is made in order: rows come sorted to a task by chain and ``order``,
    and the task keeps one hash, however long a chain is.
    """
    staged = rows.withColumn("_body", body).repartition(*by).sortWithinPartitions(*by, order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before = None, ""
        for pdf in batches:
            prev, made = [], []
            for key, text in zip(pdf[by].itertuples(index=False, name=None), pdf["_body"], strict=True):
                if key != now:
                    now, before = key, ""
                prev.append(before)
                before = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
                made.append(before)
            yield pdf.drop(columns="_body").assign(prev_hash=prev, hash=made)

    schema = StructType([*rows.schema.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())])
    return staged.mapInPandas(fold, schema)


def broken_links(rows: DataFrame, by: list[str], order: str, body: Column) -> DataFrame:
    """Rows whose ``prev_hash`` is not the hash before them, or whose ``hash`` is not that of their body."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(*by).orderBy(order)), F.lit(""))
    good = F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), body), 256)
    return rows.withColumns({"_before": before, "_good": good}).filter((F.col("prev_hash") != F.col("_before")) | (F.col("hash") != F.col("_good"))).drop("_before", "_good")


def agent_verdict(verb_bits: Column, tool_bits: Column, human_cleared: Column) -> Column:
    """Why an agent may not act, or ``allowed``: disabled, then human gate, denied tool, tool list, verb list.

    Columns of the agent: ``enabled`` and ``needs_human`` (boolean), ``denied_tool_mask``, ``allowed_tool_mask`` and
    ``allowed_verb_mask``. A null request asks nothing; of a list, all bits asked for must be there.
    """
    return (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("needs_human") & ~human_cleared, "human_gate")
        .when(F.col("denied_tool_mask").bitwiseAND(tool_bits) != 0, "tool_denied")
        .when(F.col("allowed_tool_mask").bitwiseAND(tool_bits) != tool_bits, "tool_not_allowed")
        .when(F.col("allowed_verb_mask").bitwiseAND(verb_bits) != verb_bits, "verb_not_allowed")
        .otherwise("allowed")
    )
