"""Record types of an archive: number, owner pack, the pack's permission bit, and the columns as Spark DDL.

Unsigned 64-bit numbers are BIGINT bit patterns, hashes and UUIDs lower-case hexadecimal STRING, vectors ARRAY<FLOAT>.
Every stored table also has ``seq`` (append order), ``tile_id`` and ``record_offset`` (its coordinate).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

#: Permission bits of the packs.
PACK_BITS = {"core": 0, "scholar": 1, "fintech": 2, "robotics": 4, "wearable": 8, "gis": 16, "da": 32, "ontology": 64, "spatial": 128}


@dataclass(frozen=True)
class RecordType:
    number: int
    name: str
    pack: str
    ddl: str

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def bit(self) -> int:
        return PACK_BITS[self.pack]


#: Numbers, names and fields of the record types.
_TYPES = (
    (0, "telemetry", "core", "timestamp bigint, sensor_id bigint, metric_id bigint, value double, flags bigint"),
    (1, "embedding", "core", "id bigint, timestamp bigint, vector array<float>"),
    (3, "wearable_micro", "wearable", "timestamp_sec bigint, sensor_id int, metric_id int, quantized int, quality int"),
    (4, "robotics_kinematic", "robotics", "timestamp_us bigint, robot_id bigint, joint_mask bigint, px float, py float, pz float, orientation array<float>, linear_velocity array<float>, angular_velocity array<float>"),
    (5, "gis_survey_mesh", "gis", "lat_micro int, lon_micro int, elevation_mm int, point_class int, intensity int, rgb int, timestamp_sec bigint"),
    (6, "data_availability", "da", "block_height bigint, state_root string, timestamp_sec bigint, quorum_bitmask bigint, tx_count bigint"),
    (7, "quantized_int8", "core", "id bigint, timestamp bigint, scale float, offset float, flags bigint, vector array<tinyint>"),
    (8, "quantized_4bit", "core", "id bigint, timestamp bigint, scale float, offset float, flags bigint, packed binary"),
    (9, "learning_activity", "core", "actor_id bigint, timestamp_sec bigint, verb_id int, object_id bigint, result_score double, duration_ms bigint, success_flag int, flags bigint"),
    (10, "human_lrs", "scholar", "session_uuid string, timestamp_sec bigint, actor_hash bigint, verb_id int, decision_score double, ai_trace_coord string, object_hash bigint, flags bigint"),
    (11, "ai_trace_log", "scholar", "session_uuid string, timestamp_sec bigint, agent_id bigint, step_type int, confidence double, human_coord string, hilbert_index bigint, flags bigint"),
    (12, "academic_papers", "scholar", "paper_id bigint, timestamp_sec bigint, hilbert_index bigint, topic_x double, topic_y double, topic_z double, citation_count bigint, year int, venue_id bigint, open_access int, warning_count int, doi_prefix_hash bigint, flags bigint"),
    (13, "research_graph", "scholar", "subject_hash bigint, object_hash bigint, timestamp_sec bigint, hilbert_index bigint, predicate_id int, weight double, flags bigint"),
    (14, "srs_workspace", "scholar", "project_uuid string, snapshot_uuid string, created_at bigint, flags bigint"),
    (15, "srs_manifest", "scholar", "project_uuid string, parent_uuid string, record_count bigint, checksum string"),
    (16, "ontology_concept", "ontology", "concept_id bigint, parent_id bigint, kind int, hilbert_index bigint, flags bigint"),
    (17, "ontology_axiom", "ontology", "subject_id bigint, object_id bigint, predicate int, weight double, flags bigint"),
    (18, "agent_registry", "scholar", "agent_id bigint, allowed_verb_mask bigint, allowed_tool_mask bigint, denied_tool_mask bigint, flags bigint"),
    (19, "marks", "core", "target_tile_type int, target_tile_id bigint, record_index bigint, mark_kind int, set_or_clear int, timestamp bigint, actor_hash bigint"),
    (20, "note_claims", "scholar", "claim_id bigint, session_uuid string, author_hash bigint, confidence double, kind int, text string, citation_fingerprint_id bigint, verification_uuid string, flags bigint"),
    (21, "statements", "core", "id string, stored_ms bigint, timestamp_ms bigint, actor string, verb string, object_id string, registration string, raw_json string"),
    (23, "documents", "core", "doc_kind int, key string, content string, is_json boolean, etag string, timestamp_ms bigint, flags bigint"),
    (24, "attachments", "core", "sha2 string, content binary"),
    (32, "citation_fingerprint", "scholar", "paper_id bigint, doi_hash string, content_sha256 string, kind int, crossref_version bigint, fetched_at bigint, url_hash string, flags bigint"),
    (33, "geopose", "spatial", "lat double, lon double, h double, quaternion array<double>, source_id string, content_id string"),
    (65, "columnar", "core", "name string, type string, min double, max double, null_count bigint"),
    (66, "array_chunk", "core", "chunk_coords array<bigint>, shape array<bigint>, data array<int>"),
    (71, "consent", "core", "subject_id string, study_id bigint, purpose int, scope int, granted_at bigint, expires_at bigint, withdrawn_at bigint, legal_hold int, granted_by bigint, prev_hash string, hash string"),
    (73, "erasure", "core", "erased_record_hash string, target_tile_type int, target_tile_id bigint, record_index bigint, reason int, authority bigint, requested_at bigint, executed_at bigint, prev_hash string, hash string"),
    (80, "vcs_commit", "core", "seal string, parents array<string>, author string, timestamp bigint, signature string, message string"),
    (87, "graph_edge", "core", "from string, to string, edge_type string, properties string, signer string, timestamp bigint"),
    (96, "committee_decision", "scholar", "reviewer string, submission string, verdict int, timestamp bigint, prev_hash string, hash string"),
)

REGISTRY = {t.name: t for t in (RecordType(*x) for x in _TYPES)}
BY_NUMBER = {t.number: t for t in REGISTRY.values()}

#: Codes of marks, consents, erasures and graph predicates.
MARKS = {"quarantine": 1, "needs_review": 2, "consent_withdrawn": 3, "legal_hold": 4, "access_heat": 5, "retention_expired": 6}
PURPOSES = {"research": 1, "analytics": 2, "model_training": 3, "sharing": 4}
ERASURE_REASONS = {"withdrawal": 1, "retention_expiry": 2, "legal_request": 3, "correction": 4}
GRAPH_PREDICATES = {1: "cites", 2: "authored_by", 3: "references", 4: "derives_from"}
ONTOLOGY_PREDICATES = {1: "subclass_of", 2: "has_approved_analogy", 3: "requires_competency", 4: "domain", 5: "range", 6: "disjoint_with", 7: "explains"}
WHOLE_TILE = 4294967295
TOMBSTONE = 1


class PackRequired(ValueError):
    """No pack of that name is known."""


class AddonRequired(ValueError):
    """The archive does not permit the pack."""


def require_pack(pack: str, addon_mask: int) -> None:
    """The gate before a pack's queries: the pack must exist, and the archive's mask must hold its bit."""
    if pack not in PACK_BITS:
        raise PackRequired(pack)
    if PACK_BITS[pack] & ~addon_mask:
        raise AddonRequired(f"{pack} needs bit {PACK_BITS[pack]:#06x}")
