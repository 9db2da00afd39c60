"""One query for each operator over the star schema, with the SQL that another engine answers it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import spatial as S
from skarn.functions import text as T
from skarn.functions import vectors as V
from skarn.operators import cleaning, embeddings, evidence, governance, graph, lrs, merge, packs, sessions, telemetry
from skarn.sources import adapters as A
from skarn.sources import files
from skarn.tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# The adapters in SQL.
EPOCH = "floor(epoch(ts))::BIGINT"
K = "json_extract_string(props, '$.k')::BIGINT"
METRIC = "case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 when 'view' then 5 else 0 end::BIGINT"
TELEMETRY = f"""telemetry as (select event_id as seq, ({EPOCH} // 86400) * 86400 as timestamp, user_id as sensor_id, {METRIC} as metric_id, value,
  case when {K} % 10 = 0 then 1 else 0 end::BIGINT as flags, event_id // 1000 as tile_id, event_id % 1000 as record_offset from events)"""
LATEST = f"""with {TELEMETRY}, ranked as (select *, row_number() over (partition by sensor_id, metric_id, timestamp order by seq desc) as rn from telemetry),
  live as (select * exclude (rn) from ranked where rn = 1 and flags & 1 = 0)"""
MARKS = """marks as (
  select 12 as target_tile_type, doc_id // 1000 as target_tile_id, doc_id % 1000 as record_index, case when toxic = 1 then 1 when quality = 0 then 2 end as mark_kind,
    1 as set_or_clear, doc_id as timestamp, doc_id * 2 as seq from labels where toxic = 1 or quality = 0
  union all
  select 12, doc_id // 1000, doc_id % 1000, case when toxic = 1 then 1 when quality = 0 then 2 end, 0, doc_id, doc_id * 2 + 1 from labels where (toxic = 1 or quality = 0) and doc_id % 7 = 0),
  states as (select *, row_number() over (partition by target_tile_type, target_tile_id, record_index, mark_kind order by seq desc) as rn from marks),
  active as (select target_tile_type, target_tile_id, record_index, mark_kind, timestamp, seq from states where rn = 1 and set_or_clear = 1)"""
CONSENTS = """consents as (
  select c_custkey::VARCHAR as subject_id, c_custkey % 3 as study_id, 1 as purpose, 100 as granted_at, 0 as expires_at, 0 as withdrawn_at, 0 as legal_hold, c_custkey * 2 as seq from customer
  union all
  select c_custkey::VARCHAR, c_custkey % 3, 1, 100, case when c_custkey % 5 = 0 then 500 else 0 end, case when c_custkey % 2 = 0 then 200 else 0 end, case when c_custkey % 9 = 0 then 1 else 0 end, c_custkey * 2 + 1 from customer)"""
EDGES = """edges as (
  select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'contains' as edge_type, n_nationkey::BIGINT as seq from nation
  union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 1000 + c_custkey from customer
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'placed', 10000000 + o_orderkey from orders)"""


def uuid_sql(of: str) -> str:
    h = f"md5(({of})::VARCHAR)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def identity_sql(*parts: str) -> str:
    h = "sha256(" + " || chr(31) || ".join(parts) + ")"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


STATEMENTS = f"""statements as (select {uuid_sql('e.event_id')} as id, floor(epoch(e.ts))::BIGINT * 1000 as stored_ms, 'mailto:u' || e.user_id || '@example.org' as actor,
    'http://example.org/verbs/' || case e.event_type when 'click' then 'completed' when 'error' then 'voided' when 'purchase' then 'mastered' when 'signup' then 'registered' when 'view' then 'attempted' end as verb,
    'http://example.org/items/' || json_extract_string(e.props, '$.k') as object_id, {uuid_sql('e.user_id % 50')} as registration,
    case when e.event_type = 'error' and x.event_id is null and e.event_id >= 7 then {uuid_sql('(e.event_id - 7)')} end as voids,
    case json_extract_string(e.props, '$.k')::BIGINT % 3 when 0 then true when 1 then false end as success, (json_extract_string(e.props, '$.k')::BIGINT % 100) / 100 as scaled, e.props as raw_json, e.event_id as seq
  from events e left join (select event_id + 7 as event_id from events where event_type = 'error') x on x.event_id = e.event_id)"""

# Telemetry.


@query(f"with {TELEMETRY} select seq, timestamp, sensor_id, metric_id, value, flags from telemetry where tile_id = 0 and record_offset = 442")
def s3_fetch_record(spark, d):
    return telemetry.fetch(A.telemetry(spark, d), 0, 442).select("seq", "timestamp", "sensor_id", "metric_id", "value", "flags")


@query(f"{LATEST} select seq, timestamp, sensor_id, metric_id, value from live")
def d1_sift_telemetry(spark, d):
    return telemetry.sift(A.telemetry(spark, d)).select("seq", "timestamp", "sensor_id", "metric_id", "value")


@query(f"{LATEST} select seq, timestamp, sensor_id, metric_id, value from live where metric_id = 3 and sensor_id = 13 order by sensor_id, metric_id, timestamp limit 5")
def d1_sift_filtered(spark, d):
    return telemetry.sift(A.telemetry(spark, d), sensor_id=13, metric_id=3, limit=5).select("seq", "timestamp", "sensor_id", "metric_id", "value")


@query(f"with {TELEMETRY}, r as (select *, row_number() over (partition by sensor_id, metric_id, timestamp order by seq % 2 desc, seq desc) as rn from telemetry) select timestamp, sensor_id, metric_id, value from r where rn = 1 and flags & 1 = 0")
def w2_fuse_archives(spark, d):
    """Two archives with versions and tombstones of the same keys; the second wins whatever its numbers are."""
    rows = A.telemetry(spark, d)
    return telemetry.fuse(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("timestamp", "sensor_id", "metric_id", "value")


@query(f"{LATEST} select seq, timestamp, sensor_id, metric_id, value from live where timestamp between 1704153600 and 1706745600 and metric_id in (1, 3)")
def f1_time_range(spark, d):
    rows = A.telemetry(spark, d)
    found = [telemetry.sift(rows, start=1_704_153_600, end=1_706_745_600, metric_id=m) for m in (1, 3)]
    return found[0].unionByName(found[1]).select("seq", "timestamp", "sensor_id", "metric_id", "value")


@query(f"with {TELEMETRY}, ends as (select sensor_id, metric_id, timestamp, max(seq) as e from telemetry where flags & 1 = 1 group by all) select t.seq, t.timestamp, t.sensor_id, t.metric_id, t.value from telemetry t left join ends using (sensor_id, metric_id, timestamp) where e is null or t.seq > e")
def w5_compact(spark, d):
    return telemetry.compact(A.telemetry(spark, d)).select("seq", "timestamp", "sensor_id", "metric_id", "value")


@query(f"""with {TELEMETRY}, hashed as (select *, seq % 50 = 0 as erased from telemetry), ends as (select sensor_id, metric_id, timestamp, max(seq) as e from hashed where flags & 1 = 1 or erased group by all)
  select t.seq, t.sensor_id from telemetry t left join ends using (sensor_id, metric_id, timestamp) where e is null or t.seq > e""")
def g9_compact_erased(spark, d):
    rows = A.telemetry(spark, d).withColumn("flags", F.col("flags") + F.col("seq") * 2)
    erased = rows.filter("seq % 50 = 0").select(telemetry.record_hash().alias("erased_record_hash"))
    return telemetry.compact(rows, erased).select("seq", "sensor_id")


@query(f"{LATEST} select seq, sensor_id, metric_id, timestamp from live where not (sensor_id = 13 and metric_id = 3)")
def g7_delete(spark, d):
    rows = A.telemetry(spark, d)
    return telemetry.live(telemetry.deleted(rows, rows.filter("sensor_id = 13 and metric_id = 3"))).select("seq", "sensor_id", "metric_id", "timestamp")


@query(f"{LATEST} select sensor_id, metric_id, timestamp, case when sensor_id = 13 then -1.0 else value end as value from live")
def g8_update(spark, d):
    rows = A.telemetry(spark, d)
    new = rows.filter("sensor_id = 13").select("sensor_id", "metric_id", "timestamp").distinct().withColumn("value", F.lit(-1.0))
    return telemetry.live(telemetry.updated(rows, new)).select("sensor_id", "metric_id", "timestamp", "value")


@query(f"with {TELEMETRY} select count(*) + 2 as n, max(seq) + 2 as last_seq from telemetry")
def s6_insert(spark, d):
    rows = A.telemetry(spark, d)
    new = spark.range(0, 2, 1, 1).select((F.col("id") + 100).alias("timestamp"), F.lit(1).cast("bigint").alias("sensor_id"), F.lit(1).cast("bigint").alias("metric_id"), F.lit(1.5).alias("value"))
    return telemetry.inserted(rows, new).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("select true as conserved")
def a9_conservation(spark, d):
    rows = A.telemetry(spark, d)
    before, after = telemetry.live_counts(rows).withColumn("side", F.lit("before")), telemetry.live_counts(telemetry.compact(rows)).withColumn("side", F.lit("after"))
    return before.unionByName(after).agg((F.countDistinct("n", "checksum") == 1).alias("conserved"))


@query(f"{LATEST} select (select count(*) from live) as live, (select count(*) from telemetry) as stored")
def a3_counts(spark, d):
    rows = A.telemetry(spark, d)
    both = telemetry.live(rows).select(F.lit(1).alias("live")).unionAll(rows.select(F.lit(0).alias("live")))
    return both.agg(F.count_if(F.col("live") == 1).alias("live"), F.count_if(F.col("live") == 0).alias("stored"))


@query(f"with {TELEMETRY} select tile_id, min(timestamp) as min_ts, max(timestamp) as max_ts, count(*) as n, count(distinct sensor_id) as sensors from telemetry group by tile_id")
def a4_tile_stats(spark, d):
    return telemetry.tile_stats(A.telemetry(spark, d))


@query(f"""with recursive {TELEMETRY}, stats as (select tile_id, min(timestamp) as min_ts, max(timestamp) as max_ts, count(*) as n from telemetry group by tile_id),
  l0 as (select 0 as depth, tile_id as node, min_ts, max_ts, n from stats), l1 as (select 1, node // 4, min(min_ts), max(max_ts), sum(n)::BIGINT from l0 group by node // 4),
  l2 as (select 2, node // 16, min(min_ts), max(max_ts), sum(n)::BIGINT from l0 group by node // 16), l3 as (select 3, node // 64, min(min_ts), max(max_ts), sum(n)::BIGINT from l0 group by node // 64), l4 as (select 4, node // 256, min(min_ts), max(max_ts), sum(n)::BIGINT from l0 group by node // 256),
  top as (select max(node) as t from l0)
  select * from l0 union all select l1.* from l1, top where t > 0 union all select l2.* from l2, top where t >= 4 union all select l3.* from l3, top where t >= 16 union all select l4.* from l4, top where t >= 64""")
def a5_stats_tree(spark, d):
    return telemetry.stats_tree(telemetry.tile_stats(A.telemetry(spark, d)), 4)


# Governance.


@query(f"with {MARKS} select target_tile_id, record_index, mark_kind, timestamp from active")
def g3_active_marks(spark, d):
    return governance.active_marks(A.marks(spark, d)).select("target_tile_id", "record_index", "mark_kind", "timestamp")


@query(f"with {MARKS} select doc_id as paper_id from documents where not exists (select 1 from active a where a.mark_kind = 1 and a.target_tile_id = doc_id // 1000 and a.record_index = doc_id % 1000)")
def g2_visible_papers(spark, d):
    rows = A.papers(spark, d).withColumns({"tile_id": F.floor(F.col("seq") / 1000), "record_offset": F.col("seq") % 1000})
    return governance.visible(rows, A.marks(spark, d), 12).select("paper_id")


@query(f"with {MARKS} select doc_id as paper_id, exists (select 1 from active a where a.mark_kind = 2 and a.target_tile_id = doc_id // 1000 and a.record_index = doc_id % 1000) or (doc_id < 1000 and not exists (select 1 from states s where s.mark_kind = 2 and s.target_tile_id = doc_id // 1000 and s.record_index = doc_id % 1000)) as marked from documents")
def g1_tile_marks(spark, d):
    """A mark on all of tile 0: a record's own state goes before it."""
    rows = A.papers(spark, d).withColumns({"tile_id": F.floor(F.col("seq") / 1000), "record_offset": F.col("seq") % 1000})
    marks = A.marks(spark, d)
    whole = spark.range(1).select(F.lit(12).alias("target_tile_type"), F.lit(0).cast("bigint").alias("target_tile_id"), F.lit(4294967295).alias("record_index"), F.lit(2).alias("mark_kind"), F.lit(1).alias("set_or_clear"), F.lit(0).cast("bigint").alias("timestamp"), F.lit(10**12).alias("seq"))
    return governance.with_marks(rows, marks.unionByName(whole), 12, (2,)).select("paper_id", "marked")


@query(f"with {CONSENTS}, last as (select *, row_number() over (partition by subject_id, purpose order by seq desc) as rn from consents) select subject_id from last where rn = 1 and withdrawn_at = 0 and (expires_at = 0 or expires_at >= 600)")
def g4_consented(spark, d):
    return governance.consented(A.consents(spark, d), 1, 600)


@query(f"with {CONSENTS}, last as (select *, row_number() over (partition by subject_id, purpose order by seq desc) as rn from consents), ok as (select subject_id from last where rn = 1 and withdrawn_at = 0 and (expires_at = 0 or expires_at >= 600)) select o_orderkey from orders where o_custkey::VARCHAR in (select subject_id from ok)")
def g4_consent_gate(spark, d):
    return governance.consent_gate(A.table(spark, d, "orders"), A.consents(spark, d), "o_custkey", 1, 600).select("o_orderkey")


@query(f"with {CONSENTS}, last as (select *, row_number() over (partition by subject_id, purpose, study_id order by seq desc) as rn from consents) select distinct subject_id from last where rn = 1 and legal_hold <> 0")
def g5_legal_holds(spark, d):
    return governance.legal_holds(A.consents(spark, d))


@query("select l.doc_id as record_index, l.doc_id::VARCHAR as subject_id from labels l where doc_id % 3 = 0 and doc_id % 9 <> 0")
def g6_erasures(spark, d):
    rows = A.table(spark, d, "labels").filter("doc_id % 3 = 0")
    request = lambda n: rows.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("erased_record_hash"), F.lit(12).alias("target_tile_type"), F.lit(0).cast("bigint").alias("target_tile_id"), F.col("doc_id").alias("record_index"), F.col("doc_id").cast("string").alias("subject_id"), (F.col("doc_id") * 2 + n).alias("seq"))
    holds = rows.filter("doc_id % 9 = 0").select(F.col("doc_id").cast("string").alias("subject_id"))
    return governance.erasures(request(0).unionByName(request(1)), A.marks(spark, d), holds).select("record_index", "subject_id")


@query("select o_custkey % 50 as subject_id, count(*) as links from orders where o_orderkey % 97 = 0 and o_orderstatus <> 'X' group by 1")
def w7_broken_links(spark, d):
    """Chains of which some rows' bodies were changed after they were hashed."""
    rows = A.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("subject_id"), "o_orderkey", "o_orderstatus")
    chain = governance.chained(rows, ["subject_id"], "o_orderkey", F.col("o_orderstatus"))
    tampered = chain.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    return governance.broken_links(tampered, ["subject_id"], "o_orderkey", F.col("o_orderstatus")).groupBy("subject_id").agg(F.count("*").alias("links"))


@query("with recursive r as (select o_custkey % 50 as subject_id, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey % 50 order by o_orderkey) as i from orders), c as (select subject_id, i, sha256('' || '|' || o_orderstatus) as hash from r where i = 1 union all select r.subject_id, r.i, sha256(c.hash || '|' || r.o_orderstatus) from c join r on r.subject_id = c.subject_id and r.i = c.i + 1) select subject_id, arg_max(hash, i) as head from c group by subject_id")
def w7_chain_heads(spark, d):
    rows = A.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("subject_id"), "o_orderkey", "o_orderstatus")
    chain = governance.chained(rows, ["subject_id"], "o_orderkey", F.col("o_orderstatus"))
    return chain.groupBy("subject_id").agg(F.max_by("hash", "o_orderkey").alias("head"))


@query("select c_custkey, case when c_custkey % 11 = 0 then 'disabled' when c_custkey % 4 = 0 and c_custkey % 3 <> 0 then 'human_gate' when (c_custkey & 2) <> 0 then 'tool_denied' when ((c_custkey % 8) & 2) <> 2 then 'tool_not_allowed' else 'allowed' end as verdict from customer")
def g15_agent_verdict(spark, d):
    key = F.col("c_custkey")
    agents = A.table(spark, d, "customer").withColumns({"enabled": key % 11 != 0, "needs_human": key % 4 == 0, "denied_tool_mask": key, "allowed_tool_mask": key % 8, "allowed_verb_mask": F.lit(0)})
    return agents.select("c_custkey", governance.agent_verdict(F.lit(None).cast("bigint"), F.lit(2), key % 3 == 0).alias("verdict"))


# Vectors.

LIKE = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
LIKE_SQL = "[" + ", ".join(map(str, LIKE)) + "]::DOUBLE[]"


@query(f"select vec_id as id, round(list_cosine_similarity(embedding::DOUBLE[], {LIKE_SQL}), 6) as score from embeddings where list_cosine_similarity(embedding::DOUBLE[], {LIKE_SQL}) >= 0.05 order by vec_id limit 20")
def d2_sift_embeddings(spark, d):
    return embeddings.sift(A.embeddings(spark, d), LIKE, "cosine", 0.05, 20).select("id", F.round("score", 6).alias("score"))


@query(f"select vec_id as id, round(list_inner_product(embedding::DOUBLE[], {LIKE_SQL}), 6) as score from embeddings order by list_inner_product(embedding::DOUBLE[], {LIKE_SQL}) desc, vec_id limit 10")
def l2_top_dot(spark, d):
    return embeddings.top(A.embeddings(spark, d), LIKE, 10, "dot").select("id", F.round("score", 6).alias("score"))


COMPOSED = f"0.6 * list_cosine_similarity(embedding::DOUBLE[], {LIKE_SQL}) + 0.3 / (1 + list_distance(embedding[1:3]::DOUBLE[], [0.1, 0.0, -0.1]::DOUBLE[])) + 0.1 * exp(-ln(2.0) / 3600 * (1700030000 - (1700000000 + 60 * vec_id)))"


@query(f"select vec_id as id, round({COMPOSED}, 6) as score from embeddings order by {COMPOSED} desc, vec_id limit 10")
def d3_compose(spark, d):
    found = embeddings.compose(A.embeddings(spark, d), 10, like=LIKE, weight=0.6, near=[0.1, 0.0, -0.1], near_weight=0.3, newest=1_700_030_000, half_life=3600, decay_weight=0.1)
    return found.select("id", F.round("score", 6).alias("score"))


@query("select vec_id as id, round(list_distance(embedding::DOUBLE[], embedding[2:64]::DOUBLE[] || [0.0]::DOUBLE[]) ** 2, 6) as distance, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) as own from embeddings")
def v3_distances(spark, d):
    turned = F.concat(F.slice("vector", 2, 63), F.array(F.lit(0.0).cast("float")))
    return A.embeddings(spark, d).select("id", F.round(V.squared_distance("vector", turned), 6).alias("distance"), F.round(V.dot("vector", "vector"), 6).alias("own"))


@query("with r as (select vec_id as id, list_min(embedding)::DOUBLE as lo, list_max(embedding)::DOUBLE as hi, embedding from embeddings) select id, round((hi - lo) / 254, 6) as scale, round(lo, 6) as low, list_sum(list_transform(embedding, lambda x: trunc((x::DOUBLE - lo) / ((hi - lo) / 254) - 127)::BIGINT))::BIGINT as total from r")
def v4_quantize_int8(spark, d):
    q = A.embeddings(spark, d).select("id", V.quantize_int8("vector").alias("q"))
    return q.select("id", F.round("q.scale", 6).alias("scale"), F.round("q.offset", 6).alias("low"), F.aggregate("q.vector", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("select count(*) as n, true as close from embeddings")
def v4_roundtrip(spark, d):
    q = A.embeddings(spark, d).select("vector", V.quantize_int8("vector").alias("q")).select("vector", "q", V.dequantize_int8("q").alias("back"))
    worst = F.array_max(F.zip_with("vector", "back", lambda a, b: F.abs(a.cast("double") - b)))
    return q.agg(F.count("*").alias("n"), F.every(worst <= F.col("q.scale") * 1.0001).alias("close"))


@query("with r as (select vec_id as id, list_min(embedding)::DOUBLE as lo, list_max(embedding)::DOUBLE as hi, embedding from embeddings) select id, list_sum(list_transform(embedding, lambda x: greatest(0, least(15, floor((x::DOUBLE - lo) / ((hi - lo) / 15))))::BIGINT))::BIGINT as total, 64 as codes from r")
def v5_quantize_4bit(spark, d):
    q = A.embeddings(spark, d).select("id", V.quantize_4bit("vector").alias("q")).select("id", V.unpack_nibbles(V.pack_nibbles("q.codes")).alias("c"))
    return q.select("id", F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.size("c").alias("codes"))


@query("with r as (select vec_id as id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) as big, embedding from embeddings) select id, round(big / 127, 6) as scale, list_sum(list_transform(embedding, lambda x: trunc(x::DOUBLE / (big / 127))::BIGINT))::BIGINT as total from r")
def v6_quantize_max(spark, d):
    q = A.embeddings(spark, d).select("id", V.quantize_max("vector").alias("q"))
    return q.select("id", F.round("q.scale", 6).alias("scale"), F.aggregate("q.vector", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


SHARE = "((contains(lower(text), 'nation')::INT + contains(lower(text), 'licensed')::INT + contains(lower(text), 'those')::INT) / 3)"


@query(f"select doc_id as claim_id, round({SHARE}, 6) as score from documents where {SHARE} > 0 order by {SHARE} desc, doc_id limit 25")
def l3_claims_text(spark, d):
    return embeddings.search_text(A.claims(spark, d), "nation licensed those", 25).select("claim_id", F.round("score", 6).alias("score"))


HYBRID = f"0.4 * {SHARE} + coalesce(0.6 * list_cosine_similarity(embedding::DOUBLE[], {LIKE_SQL}), 0)"


@query(f"select doc_id as claim_id, round({HYBRID}, 6) as score from documents left join embeddings on vec_id = doc_id where {HYBRID} > 0 order by {HYBRID} desc, doc_id limit 25")
def v8_claims_hybrid(spark, d):
    return embeddings.search_hybrid(A.claims(spark, d), "nation licensed those", LIKE, 0.4, 0.6, 25).select("claim_id", F.round("score", 6).alias("score"))


@query("select doc_id as claim_id from documents where list_has_all(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['licensed', 'the'])")
def f12_keyword_claims(spark, d):
    return embeddings.keyword_claims(A.claims(spark, d), "Licensed the").select("claim_id")


# Packs.


@query("select count(*) as n, round(sum(l_quantity), 2) as total from lineitem where l_quantity between 10 and 20 and round(100 * l_discount, 2) between 2 and 6 and round(100 * l_tax, 2) between 0 and 4 and floor(epoch(l_shipdate))::BIGINT between 800000000 and 900000000")
def d4_kinematics(spark, d):
    found = packs.kinematics(A.kinematics(spark, d), [10, 2, 0], [20, 6, 4], 800_000_000_000_000, 900_000_000_000_000)
    return found.agg(F.count("*").alias("n"), F.round(F.sum("px"), 2).alias("total"))


GIS = "(select c_custkey as seq, (c_custkey * 7919 % 180000001 - 90000000)::INT as lat, (c_custkey * 104729 % 360000001 - 180000000)::INT as lon, (c_custkey * 31 % 5000000)::INT as elev from customer)"


@query(f"select seq, lat / 1e6 as latitude, lon / 1e6 as longitude from {GIS} where lat between -89990000 and -80000000 and lon between -179900000 and 100000000 and elev between 0 and 40000")
def d5_survey_points(spark, d):
    found = packs.survey_points(A.survey_points(spark, d), (-89.99, -80), (-179.9, 100), (0, 40))
    return found.select("seq", S.from_micro("lat_micro").alias("latitude"), S.from_micro("lon_micro").alias("longitude"))


@query("select o_orderkey as block_height, coalesce(n, 0) as tx_count from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderkey between 100 and 400")
def d6_commitments(spark, d):
    return packs.commitments(A.commitments(spark, d), 100, 400).select("block_height", "tx_count")


@query(f"select event_id as seq, greatest(-32768, least(32767, trunc(value * 256)))::INT / 256.0::DOUBLE as value from (select *, {METRIC} as m from events) where user_id % 8 = 3 and m = 5")
def f17_wearables(spark, d):
    return packs.wearables(A.wearables(spark, d), sensor_id=3, metric_id=5).select("seq", "value")


@query("select doc_id as paper_id from documents where doc_id * 7 % 1000 / 1000 between 0.1 and 0.8 and doc_id * 11 % 1000 / 1000 between 0.2 and 0.9 and doc_id * 13 % 1000 / 1000 between 0 and 0.7 and 1990 + doc_id % 35 between 1995 and 2015")
def f13_papers(spark, d):
    return packs.papers(A.papers(spark, d), [0.1, 0.2, 0.0], [0.8, 0.9, 0.7], 1995, 2015).select("paper_id")


@query("select (1990 + doc_id % 35)::INT as year, count(*) as n, sum(n_chars % 100)::BIGINT as citations from documents group by 1")
def a14_papers_by_year(spark, d):
    return packs.papers_by_year(A.papers(spark, d))


@query(f"with {EDGES}, p as (select doc_id as paper_id from documents where 1990 + doc_id % 35 between 2000 and 2010) select paper_id, (select count(*) from p) as n_papers, (select count(*) from edges) as n_edges from p order by paper_id limit 25")
def a14_library_search(spark, d):
    return packs.library_search(A.papers(spark, d), A.edges(spark, d), 2000, 2010).select("paper_id", "n_papers", "n_edges")


@query("select '0x' || lpad(lower(to_hex(p_partkey)), 16, '0') as src, '0x' || lpad(lower(to_hex(p_size)), 16, '0') as dst, case p_size % 5 when 1 then 'cites' when 2 then 'authored_by' when 3 then 'references' when 4 then 'derives_from' else 'related_to' end as edge_type from part where p_size % 5 = 2")
def f14_research_edges(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("subject_hash"), F.col("p_size").cast("bigint").alias("object_hash"), (F.col("p_size") % 5).alias("predicate_id"), F.col("p_partkey").alias("seq"))
    return graph.from_research(packs.research_edges(rows, predicate=2)).select("src", "dst", "edge_type")


@query("select p_partkey as concept_id from part where p_size = 7 and p_partkey % 2 = 0 order by p_partkey limit 1")
def f16_concept(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("concept_id"), (F.col("p_partkey") % 2).alias("flags"))
    return packs.concept(rows, 7).select(F.col("seq").alias("concept_id"))


@query("select p_partkey as object_id from part where p_size = 7 and p_partkey % 7 = 2")
def f16_analogies(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_size").alias("subject_id"), F.col("p_partkey").alias("object_id"), (F.col("p_partkey") % 7).alias("predicate"))
    return packs.axioms(rows, 7, 2).select("object_id")


@query("""with cells as (select o_orderkey // 8 * 8 + (o_orderkey % 8) as c0, i.i as c1, (o_orderkey * 4 + i.i) as value from orders, range(4) i(i) where o_orderkey // 8 % 3 <> 0),
  grid as (select r.r as c0, c.c as c1 from range(5, 70) r(r), range(1, 6) c(c)) select c0::BIGINT as c0, c1::BIGINT as c1, coalesce(value, -1)::BIGINT as value from grid left join cells using (c0, c1)""")
def f18_array_slice(spark, d):
    """Chunks of 8 rows and 4 columns, every third one missing."""
    rows = A.table(spark, d, "orders").filter("o_orderkey div 8 % 3 <> 0").groupBy(F.floor(F.col("o_orderkey") / 8).alias("c")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    cell = F.flatten(F.transform(F.sequence(F.col("c") * 8, F.col("c") * 8 + 7), lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(F.array_contains("k", k), k * 4 + i))))
    chunks = rows.select(F.array(F.col("c") * 8, F.lit(0).cast("bigint")).alias("chunk_coords"), F.array(F.lit(8).cast("bigint"), F.lit(4).cast("bigint")).alias("shape"), cell.alias("data"))
    return packs.array_slice(chunks, [(5, 70), (1, 6)], -1)


@query("select c_custkey, (c_custkey % 360 >= 350 or c_custkey % 360 <= 20) as inside, round(sqrt(2 * pow(least(c_custkey % 360, 360 - c_custkey % 360), 2)), 6) as distance from customer")
def f19_wrapped_axes(spark, d):
    angle = (F.col("c_custkey") % 360).cast("double")
    return A.table(spark, d, "customer").select("c_custkey", S.wrapped_contains(350, 380, angle, 360).alias("inside"), F.round(S.wrapped_distance([angle, angle], [F.lit(0.0), F.lit(0.0)], 360), 6).alias("distance"))


MORTON = " | ".join(f"((({v} >> {b}) & 1) << {3 * b + a})" for a, v in enumerate(("l_linenumber::BIGINT", "(l_partkey % 64)", "(l_suppkey % 64)")) for b in range(6))


@query(f"select l_orderkey, l_linenumber, {MORTON} as morton from lineitem")
def h1_morton(spark, d):
    rows = A.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", S.morton_3d("l_linenumber", F.col("l_partkey") % 64, F.col("l_suppkey") % 64, 6).alias("morton"))


@query("select 512 as cells, 511 as highest, 1.0::DOUBLE as max_jump")
def h1_hilbert(spark, d):
    """All cells of a cube of 8: the curve visits each once, one step at a time."""
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    curve = cells.withColumn("h", S.hilbert_3d("x", "y", "z", 3)).withColumn("one", F.lit(1))
    jump = packs.jumps(curve, "h", ("x", "y", "z"), "one").first().max_jump
    return curve.agg(F.countDistinct("h").cast("int").alias("cells"), F.max("h").cast("int").alias("highest"), F.lit(jump).alias("max_jump"))


@query("select c_custkey, round(x + y + z, 6) as d4, round(x + y - z, 6) as d5, round(x - y + z, 6) as d6, round(x - y - z, 6) as d7 from (select c_custkey, c_acctbal as x, c_nationkey::DOUBLE as y, (c_custkey % 17)::DOUBLE as z from customer)")
def h2_hull_axes(spark, d):
    axes = S.dop14("c_acctbal", F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 17).cast("double"))
    return A.table(spark, d, "customer").select("c_custkey", *(F.round(a, 6).alias(f"d{i}") for i, a in enumerate(axes, 1) if i > 3))


@query("select event_id, (case when value >= 1 then floor((value - 1) / 0.25 + 0.5) else ceil((value - 1) / 0.25 - 0.5) end)::INT as code, ((event_id % 7 - 3) << 1 if false else case when event_id % 7 - 3 >= 0 then 2 * (event_id % 7 - 3) else -2 * (event_id % 7 - 3) - 1 end)::BIGINT as zigzag from events".replace("(event_id % 7 - 3) << 1 if false else ", ""))
def h3_codes(spark, d):
    return A.table(spark, d, "events").select("event_id", S.frame_code("value", 1.0, 0.25).alias("code"), S.zigzag(F.col("event_id") % 7 - 3).alias("zigzag"))


@query("select s_suppkey as agent_id from supplier where s_suppkey % 4 = 1")
def f15_active_agents(spark, d):
    return packs.active_agents(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("agent_id"), (F.col("s_suppkey") % 4).alias("flags"))).select("agent_id")


@query("select min(s_suppkey) as seq from supplier")
def f15_first_manifest(spark, d):
    return packs.first_manifest(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq")))


@query("with b as (select l_suppkey as tile_id, min(l_quantity) as a, max(l_quantity) as b, min(100 * l_discount) as c, max(100 * l_discount) as d, count(*) as n from lineitem group by 1) select tile_id, n from b where b >= 49 and a <= 50 and round(d, 2) >= 9 and round(c, 2) <= 10")
def f20_meeting_hulls(spark, d):
    rows = A.kinematics(spark, d).withColumnRenamed("robot_id", "tile_id")
    return packs.meeting(packs.hulls(rows), [49, 9, -1], [50, 10, 99]).select("tile_id", "n")


UNIT = "('0x' || substr(md5('{s}' || chr(31) || {w}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("select p_partkey, " + ", ".join(f"round(list_avg(list_transform(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {UNIT.format(s=s, w='w')})), 6) as topic_{s}" for s in "xyz") + " from part")
def a8_topic_coordinates(spark, d):
    axes = packs.topic_coordinates("p_name", F.lit("10.1/x"))
    return A.table(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(f"topic_{s}") for c, s in zip(axes, "xyz", strict=True)))


@query("select c_custkey, case when c_custkey % 3 <> 0 and c_custkey % 200 <= 90 then (c_custkey % 200)::DOUBLE end as lat from customer")
def t11_geopose(spark, d):
    key = F.col("c_custkey")
    w = F.when(key % 3 == 0, 0.9).otherwise(1.0)
    text = S.geopose_json((key % 200).cast("double"), F.lit(10.0), F.lit(5.0), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), w))
    return A.table(spark, d, "customer").select("c_custkey", S.geopose(text)["position"]["lat"].alias("lat"))


@query(f"select event_id, {EPOCH} * 1000 + event_id % 50 as timestamp, 10 + (event_id % 9) * 0.5::DOUBLE as value from events")
def s21_edge_readings(spark, d):
    rows = A.table(spark, d, "events").select("event_id", (A.epoch() * 1000).alias("min_ts_ms"), (F.col("event_id") % 50).alias("delta_ms"), (F.col("event_id") % 9).cast("int").alias("code"), F.lit(10.0).alias("base"), F.lit(0.5).alias("step"), F.lit(True).alias("seal_ok"))
    return packs.edge_readings(rows)


@query("select doc_id as paper_id, source as venue, (1990 + doc_id % 35)::INT as year from documents")
def d9_papers(spark, d):
    return A.papers(spark, d).select("paper_id", "venue", "year")


# Sessions.


@query("select conv_id::VARCHAR as session_uuid, case role when 'user' then 'human' else 'ai' end as side, turn as timestamp_sec from conversations where role in ('user', 'assistant')")
def j1_session_bundle(spark, d):
    return sessions.bundle(A.humans(spark, d), A.traces(spark, d)).select("session_uuid", "side", "timestamp_sec")


@query("select h.conv_id::VARCHAR as session_uuid, h.turn as asked, a.turn as answered from conversations h join conversations a on a.conv_id = h.conv_id and a.turn = h.turn + 1 where h.role = 'user' and a.role = 'assistant'")
def j2_dereference(spark, d):
    targets = A.traces(spark, d).select("tile_id", "record_offset", F.col("timestamp_sec").alias("answered"))
    return sessions.dereference(A.humans(spark, d), "ai_trace_coord", targets).select("session_uuid", F.col("timestamp_sec").alias("asked"), "answered")


@query("""select conv_id::VARCHAR as session_uuid, coalesce(min(case when turn <> 0 then turn end), 0) as first_ts, max(turn) as last_ts, max(turn) - coalesce(min(case when turn <> 0 then turn end), 0) as duration,
  count(*) filter (role = 'user') as n_humans, count(*) filter (role = 'assistant') as n_ais, count(distinct case when role = 'user' then conv_id % 97 end) as n_actors, count(distinct case when role = 'assistant' then conv_id % 7 end) as n_agents,
  round(avg(case when role = 'user' then length(text) % 100 / 100 end), 4) as mean_score, round(avg(case when role = 'assistant' then length(text) % 50 / 50 end), 4) as mean_confidence
  from conversations where role in ('user', 'assistant') group by 1""")
def a1_session_aggregate(spark, d):
    return sessions.aggregate(A.humans(spark, d), A.traces(spark, d))


@query("select conv_id::VARCHAR as session_uuid, turn as timestamp_sec, round(length(text) % 100 / 100, 6) as score from conversations where role = 'user' and conv_id % 97 = 5 and turn between 0 and 4")
def d7_human_lrs(spark, d):
    return sessions.human_lrs(A.humans(spark, d), actor_hash=5, start=0, end=4).select("session_uuid", "timestamp_sec", F.round("decision_score", 6).alias("score"))


@query(f"with {CONSENTS}, last as (select *, row_number() over (partition by subject_id, purpose order by seq desc) as rn from consents), ok as (select subject_id from last where rn = 1 and withdrawn_at = 0 and (expires_at = 0 or expires_at >= 600)) select event_id as seq from events where {METRIC} = 5 and {K} % 10 <> 0 and user_id::VARCHAR in (select subject_id from ok)")
def f4_learning_activities(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), A.epoch().alias("timestamp_sec"), F.col("user_id").alias("actor_id"), A._code(A.METRICS, "event_type").alias("verb_id"), F.when(A._k() % 10 == 0, 1).otherwise(0).alias("flags"))
    return sessions.learning_activities(rows, verb_id=5, consents=A.consents(spark, d), purpose=1, now=600).select("seq")


@query("select conv_id::VARCHAR as session_uuid, turn as timestamp_sec from conversations where role = 'assistant' and conv_id % 7 = 3")
def d8_ai_traces(spark, d):
    return sessions.ai_traces(A.traces(spark, d), agent_id=3).select("session_uuid", "timestamp_sec")


@query("select 3 as part, conv_id || chr(9) || count(*) as line from conversations group by conv_id union all select 0, 'session' || chr(9) || 'n' union all select 1, 'string' || chr(9) || 'continuous' union all select 2, 'meta' || chr(9)")
def s17_tab_export(spark, d):
    rows = A.turns(spark, d).groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("n"))
    return sessions.tab_lines(rows, {"session": "string"})


# Graph.


@query(f"with {EDGES} select dst, edge_type, seq from edges where src = 'nation:3'")
def r1_neighbors(spark, d):
    return graph.neighbors(A.edges(spark, d), "nation:3").select("dst", "edge_type", "seq")


@query(f"with recursive {EDGES}, near as (select 'region:1' as node, 0 as depth union select e.dst, n.depth + 1 from near n join edges e on e.src = n.node where n.depth < 2), best as (select node, min(depth) as depth from near group by node) select src, dst, seq, depth + 1 as depth from best join edges on src = node")
def r2_traverse(spark, d):
    return graph.traverse(A.edges(spark, d), "region:1", 3).select("src", "dst", "seq", "depth")


@query(f"with recursive {EDGES}, near as (select 'region:1' as node, 0 as depth union select e.dst, n.depth + 1 from near n join edges e on e.src = n.node where n.depth < 1 and e.edge_type = 'contains') select src, dst, depth + 1 as depth from near join edges on src = node where edge_type = 'contains'")
def r2_traverse_via(spark, d):
    return graph.traverse(A.edges(spark, d), "region:1", 2, "CONTAINS").select("src", "dst", "depth")


@query("select 0 as step, 'region:' || n_regionkey as node, null::BIGINT as seq from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderkey = 77 union all select 1, 'nation:' || n_nationkey, n_nationkey from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderkey = 77 union all select 2, 'customer:' || c_custkey, 1000 + c_custkey from orders join customer on c_custkey = o_custkey where o_orderkey = 77 union all select 3, 'order:77', 10000077")
def r3_path(spark, d):
    rows = A.table(spark, d, "orders").filter("o_orderkey = 77").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    start = "region:" + str(rows.first().n_regionkey)
    return graph.path(A.edges(spark, d), start, "order:77")


@query(f"with {EDGES} select src, dst, seq from edges where (src = 'customer:7' or dst = 'customer:7') and seq % 3 <> 0")
def r5_touching(spark, d):
    rows = A.edges(spark, d)
    kept = graph.without_retracted(rows, rows.filter("seq % 3 = 0").select("edge_id"))
    return graph.touching(kept, "customer:7").select("src", "dst", "seq")


def _commits(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "supplier")
    parent = lambda n: F.when(F.col("s_suppkey") >= n, F.concat(F.lit("c"), F.col("s_suppkey") - n))
    return rows.select(F.concat(F.lit("c"), "s_suppkey").alias("seal"), F.array_compact(F.array(parent(3), parent(5))).alias("parents"), F.col("s_suppkey").alias("seq"))


@query("select printf('0x%016x', doc_id) as src, printf('0x%016x', doc_id * 7 + 1) as dst, 'related_to' as edge_type, doc_id as seq from labels")
def r4_research_edges(spark, d):
    key = F.col("doc_id")
    return graph.from_research(A.table(spark, d, "labels").select(key.alias("subject_hash"), (key * 7 + 1).alias("object_hash"), F.lit(-1).alias("predicate_id"), key.alias("seq")))


@query("select 'c' || s_suppkey as seal from supplier where s_suppkey + 3 > (select max(s_suppkey) from supplier)")
def r6_leaves(spark, d):
    return graph.leaves(_commits(spark, d)).select("seal")


@query("with recursive l as (select 9 as k, 0 as depth union select l.k - p.p, depth + 1 from l, (values (3), (5)) p(p) where l.k >= p.p) select 'c' || k as node, min(depth) as depth from l group by k")
def r6_lineage(spark, d):
    return graph.lineage(_commits(spark, d), "c9")


@query("with recursive l as (select max(s_suppkey) as k, 0 as depth from supplier union all select k - 3, depth + 1 from l where k >= 3) select 'c' || k as node, depth from l")
def r6_log(spark, d):
    return graph.log(_commits(spark, d)).select("node", "depth")


@query("with recursive t as (select 1 as k, 0 as depth union all select p.p_partkey, depth + 1 from t join part p on p.p_partkey // 2 = t.k and p.p_partkey <> t.k where depth < 30) select k::VARCHAR as node, depth from t")
def r7_subsumed(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.floor(F.col("p_partkey") / 2).alias("parent_id"), F.col("p_partkey").alias("seq"))
    return graph.subsumed(rows, 1)


# Learning records.


@query(f"""with {STATEMENTS}, m as (select * from statements where verb like '%completed' and stored_ms > 1704153600000 and stored_ms <= 1706745600000),
  v as (select voids from statements where voids is not null) select distinct id from (select id from m where id not in (select voids from v) union all select s.id from statements s where s.voids in (select id from m))""")
def x1_matching(spark, d):
    return lrs.matching(A.statements(spark, d), verb="http://example.org/verbs/completed", since=1_704_153_600_000, until=1_706_745_600_000).select("id")


@query(f"with {STATEMENTS}, v as (select voids from statements where voids is not null), m as (select * from statements where registration = {uuid_sql('7')}) select id, stored_ms from (select id, stored_ms, seq from m where id not in (select voids from v) union select s.id, s.stored_ms, s.seq from statements s where s.voids in (select id from m)) order by stored_ms desc, seq desc limit 20 offset 5")
def l4_page(spark, d):
    import hashlib

    h = hashlib.md5(b"7").hexdigest()
    found = lrs.matching(A.statements(spark, d), registration=f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")
    return lrs.page(found, limit=20, offset=5)[0].select("id", "stored_ms")


@query(f"with {STATEMENTS} select s.id as voided, v.id as voiding from statements s join statements v on v.voids = s.id")
def j8_voiding(spark, d):
    rows = A.statements(spark, d)
    return rows.select(F.col("id").alias("voided")).join(rows.select(F.col("voids").alias("voided"), F.col("id").alias("voiding")), "voided")


@query("select event_id as seq, case when event_id % 10 in (2, 4) then 'duplicate' when event_id % 10 in (3, 5) then 'conflict' when event_id % 10 in (7, 8) then 'voids_a_voiding_statement' else 'stored' end as outcome from events")
def x3_stored(spark, d):
    """Of each ten: new ids; a repeat and a conflict within the batch, then of what was there; voiding, and voiding a voiding one, new or there."""
    rows = A.table(spark, d, "events")
    key, n = F.col("event_id"), F.col("event_id") % 10
    ten = key - n
    there = lambda k: A.statement_id(k + 1_000_000_000)
    text = F.lit(None).cast("string")
    existing = rows.filter("event_id % 10 in (4, 5, 8)").select(there(key).alias("id"), F.when(n == 5, "old").otherwise(key.cast("string")).alias("raw_json"), (key - 2_000_000_000).alias("seq"), F.when(n == 8, there(ten + 4)).otherwise(text).alias("voids"))
    same = n.isin(2, 3)
    incoming = rows.select(
        F.when(same, A.statement_id(ten)).when(n.isin(4, 5), there(key)).otherwise(A.statement_id(key)).alias("id"),
        F.when(n == 3, "other").when(same, ten.cast("string")).otherwise(key.cast("string")).alias("raw_json"),
        key.alias("seq"),
        F.when(n == 6, A.statement_id(ten)).when(n == 7, A.statement_id(key - 1)).when(n == 8, there(key)).otherwise(text).alias("voids"),
    )
    return lrs.stored(existing, incoming).select("seq", "outcome")


STATUS = "case when verb like '%/completed' then case success when true then 'passed' when false then 'failed' else 'completed' end when verb like '%/attempted' then 'attempted' when verb like '%/registered' then 'registered' end"


@query(f"with {STATEMENTS} select {identity_sql(chr(39) + 'event' + chr(39), 'actor', 'object_id', 'id')} as event_id, {STATUS} as status, stored_ms as at_ms from statements where {STATUS} is not null")
def x4_events(spark, d):
    return lrs.events(A.statements(spark, d)).select("event_id", "status", "at_ms")


@query(f"with {STATEMENTS} select actor, object_id, 'passed' as status, round(arg_max(scaled, seq), 6) as confidence from statements where verb like '%/mastered' group by 1, 2")
def x4_competencies(spark, d):
    return lrs.competencies(A.statements(spark, d)).select("actor", "object_id", "status", F.round("confidence", 6).alias("confidence"))


GOAL_VERBS = ("assigned", "pursued", "dismissed", "recommended", "removed")


@query(f"with {STATEMENTS}, g as (select actor, object_id || '/goal' as object_id, stored_ms, seq, ['assigned', 'pursued', 'dismissed', 'recommended', 'removed'][seq % 5 + 1] as v from statements) select actor, object_id, arg_max(case v when 'assigned' then 'assigned' when 'recommended' then 'recommended' else 'self' end, seq) as kind, arg_max(case when v in ('dismissed', 'removed') then 'removed' else 'active' end, seq) as status, arg_max(case when v in ('dismissed', 'removed') then 0 else stored_ms + 2592000000 end, seq) as target_ms from g group by 1, 2")
def x4_goals(spark, d):
    verbs = F.array(*(F.lit(f"http://example.org/verbs/{v}") for v in GOAL_VERBS))
    rows = A.statements(spark, d).withColumns({"verb": F.element_at(verbs, (F.col("seq") % 5 + 1).cast("int")), "object_id": F.concat("object_id", F.lit("/goal"))})
    return lrs.goals(rows).select("actor", "object_id", "kind", "status", "target_ms")


@query(f"with {STATEMENTS} select distinct {identity_sql(chr(39) + 'person' + chr(39), 'actor')} as person_id, actor as identifier from statements")
def x4_persons(spark, d):
    return lrs.persons(A.statements(spark, d))


@query(f"with {STATEMENTS} select object_id, max(seq) as seq from statements group by 1")
def x4_resources(spark, d):
    return lrs.resources(A.statements(spark, d)).select("object_id", "seq")


@query(f"with {STATEMENTS} select id, {STATUS} as status from statements where {STATUS} is not null and not actor like '%1@example.org'".replace("select id, ", "select stored_ms as at_ms, "))
def x6_of_person(spark, d):
    rows = A.statements(spark, d)
    return lrs.of_person(lrs.events(rows), withdrawn=rows.filter(F.col("actor").endswith("1@example.org"))).select("at_ms", "status")


@query("select 'k' || event_id as key from events where event_id % 3 = 1 and event_id > 500 and 'k' || event_id like 'k7%' and event_id % 10 <> 4 order by 1")
def x7_document_ids(spark, d):
    rows = A.table(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("doc_kind"), F.concat(F.lit("k"), "event_id").alias("key"), F.col("event_id").alias("timestamp_ms"), (F.col("event_id") % 10 == 4).alias("deleted"), F.col("event_id").alias("seq"))
    return lrs.document_ids(rows, 1, "k7", 500)


@query(f"with {STATEMENTS} select seq from statements where registration = {uuid_sql('7')} order by stored_ms, seq limit 10000")
def x8_registration_export(spark, d):
    import hashlib

    h = hashlib.md5(b"7").hexdigest()
    return lrs.registration_export(A.statements(spark, d), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}").select("seq")


@query("select p_brand as object_id, json_object('first', min(p_partkey), 'last', max(p_partkey))::VARCHAR as definition from part group by p_brand")
def x11_activities(spark, d):
    ends = A.table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    mention = lambda name, c, seq: ends.select(F.col("p_brand").alias("object_id"), F.concat(F.lit(f'{{"{name}":'), c, F.lit("}")).alias("definition"), F.lit(seq).alias("seq"))
    found = lrs.activities(mention("first", "a", 1).unionByName(mention("last", "a", 2)).unionByName(mention("last", "b", 3)))
    return found.withColumn("definition", F.regexp_replace("definition", " ", ""))


@query("select event_id as seq, case event_id % 4 when 0 then 'mailto:a' || event_id when 1 then 'sum' || event_id when 2 then 'http://id/' || event_id else 'http://home' || chr(0) || event_id end as actor from events")
def x13_actor_identity(spark, d):
    n = F.col("event_id").cast("string")
    body = F.element_at(F.array(F.concat(F.lit('{"mbox":"mailto:a'), n, F.lit('","openid":"x"}')), F.concat(F.lit('{"mbox_sha1sum":"sum'), n, F.lit('"}')), F.concat(F.lit('{"openid":"http://id/'), n, F.lit('"}')), F.concat(F.lit('{"account":{"homePage":"http://home","name":"'), n, F.lit('"}}'))), (F.col("event_id") % 4 + 1).cast("int"))
    return A.table(spark, d, "events").withColumn("actor_json", body).select(F.col("event_id").alias("seq"), lrs.actor_identity("actor_json").alias("actor"))


@query("select event_id as seq, '{\"objectType\":\"Person\",\"mbox\":[\"mailto:u' || user_id || '\"]}' as person from events")
def x12_person_object(spark, d):
    agent = F.to_json(F.struct(F.concat(F.lit("mailto:u"), "user_id").alias("mbox")))
    return A.table(spark, d, "events").select(F.col("event_id").alias("seq"), lrs.person_object(agent).alias("person"))


@query("select event_id as seq, case event_id % 4 when 0 then 2 when 3 then 7 end::INT as verb_id from events")
def x10_verb_labels(spark, d):
    """Registered verbs by their whole IRI: an own one, foreign ones that only end alike, and a listed public one."""
    n = F.col("seq") % 4
    verb = F.when(n == 0, lrs.VERB_BASE + "reviewed").when(n == 1, "http://other.example/reviewed").when(n == 2, "reviewed").otherwise("http://purl.org/spar/cito/cites")
    return lrs.with_verb_labels(A.statements(spark, d).withColumn("verb", verb)).select("seq", "verb_id")


@query("select event_id as seq, case event_id % 4 when 1 then 'id is no UUID' when 2 then 'verb id is no IRI' else 'scaled score is out of range' end as why from events where event_id % 4 > 0")
def t7_violations(spark, d):
    n = F.col("event_id") % 4
    ident = F.when(n == 1, "no").otherwise(A.statement_id(F.col("event_id")))
    verb = F.when(n == 2, "x y").otherwise("http://example.org/verbs/asked")
    score = F.when(n == 3, 1.5).otherwise(0.5)
    body = F.to_json(F.struct(ident.alias("id"), F.struct(F.lit("mailto:a@example.org").alias("mbox")).alias("actor"), F.struct(verb.alias("id")).alias("verb"), F.struct(F.lit("http://example.org/1").alias("id")).alias("object"), F.struct(F.struct(score.alias("scaled")).alias("score")).alias("result")))
    return lrs.violations(A.table(spark, d, "events").select(F.col("event_id").alias("seq"), body.alias("raw_json")))


@query(f"with {STATEMENTS} select (select count(*) from statements where not (seq % 9 = 0 and seq % 27 <> 0)) as kept, (select count(*) from statements where seq % 9 = 0 and seq % 27 <> 0) as receipts")
def g12_purge(spark, d):
    rows = A.statements(spark, d)
    kept, receipts = lrs.purge(rows, rows.filter("seq % 9 = 0"), rows.filter("seq % 27 = 0"))
    both = kept.select(F.lit(True).alias("k")).unionAll(receipts.select(F.lit(False).alias("k")))
    return both.agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("receipts"))


@query(f"with {STATEMENTS} select count(*) as n from statements where stored_ms < 1711929600000 - 90 * 86400000::BIGINT")
def g12_retention(spark, d):
    return lrs.retention_ids(A.statements(spark, d), 1_711_929_600_000, 90).agg(F.count("*").alias("n"))


@query("""select event_id as key, case event_id % 6 when 0 then 'conflict' when 1 then 'stored' when 2 then 'precondition_failed' when 3 then 'stored' when 4 then 'precondition_failed' else 'stored' end as outcome,
  case event_id % 6 when 1 then 'new' when 3 then '{"a":"1","b":"3","c":"4"}' when 5 then 'new' end as result from events""")
def g16_put_document(spark, d):
    n = F.col("event_id") % 6
    rows = A.table(spark, d, "events")
    old = F.lit('{"a":"1","b":"2"}')
    here = rows.filter(~(n.isin(5))).select(F.lit(1).alias("doc_kind"), F.col("event_id").alias("key"), old.alias("content"), F.lit(True).alias("is_json"), F.col("event_id").alias("seq"))
    asked = rows.select(F.lit(1).alias("doc_kind"), F.col("event_id").alias("key"), F.when(n == 3, '{"b":"3","c":"4"}').otherwise("new").alias("content"), (n == 3).alias("is_json"), F.when(n == 1, F.concat(F.lit('"'), F.sha1(old), F.lit('"'))).when(n == 2, "other").alias("if_match"), F.when(n == 4, "*").alias("if_none_match"), (n == 3).alias("merge"))
    return lrs.put_outcomes(here, asked).select("key", "outcome", "result")


@query("select o_orderkey as batch_seq, case when o_orderkey % 5 = 0 then 'corrupt' when o_orderkey <= 10 then 'duplicate' when o_orderkey = 11 then 'applied' else 'gap' end as outcome from orders")
def x9_synced(spark, d):
    rows = A.table(spark, d, "orders")
    applied = spark.range(1).select(F.lit("s").alias("session"), F.lit(10).cast("bigint").alias("batch_seq"))
    batches = rows.select(F.lit("s").alias("session"), F.col("o_orderkey").alias("batch_seq"), F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.sha2("o_orderstatus", 256)).alias("checksum"), F.col("o_orderstatus").alias("payload"))
    return lrs.synced(applied, batches).select("batch_seq", "outcome")


# Cleaning.

INVOICES = cleaning.Category(
    "invoices",
    ("csv",),
    "invoice",
    (cleaning.Field("segment", allowed=("BUILDING", "AUTO", "FURNITURE", "HOUSEHOLD")), cleaning.Field("balance", "decimal", True), cleaning.Field("due", "date", True)),
    (cleaning.Rule("trim", "trim"), cleaning.Rule("seg", "uppercase", "segment"), cleaning.Rule("map", "map", "segment", values={s: s for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")} | {"AUTOMOBILE": "AUTO"}), cleaning.Rule("due", "date_iso", "due", layouts=("YYYY-MM-DD", "DD.MM.YYYY"))),
)


def _invoices(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    due = F.when(key % 3 == 0, F.date_format(F.date_add(F.lit("2024-01-01"), (key % 300).cast("int")), "dd.MM.yyyy")).when(key % 7 == 1, "soon").otherwise(F.date_add(F.lit("2024-01-01"), (key % 300).cast("int")).cast("string"))
    return A.table(spark, d, "customer").select(F.lit("invoice_oct.csv").alias("source"), key.alias("row"), F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("segment"), F.when(key % 11 == 0, "").otherwise((key % 1000).cast("string")).alias("balance"), due.alias("due"))


GOOD_INVOICE = "c_mktsegment <> 'MACHINERY' and c_custkey % 11 <> 0 and not (c_custkey % 3 <> 0 and c_custkey % 7 = 1)"


@query(f"select c_custkey as row, case c_mktsegment when 'AUTOMOBILE' then 'AUTO' else c_mktsegment end as segment, strftime(date '2024-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') as due from customer where {GOOD_INVOICE}")
def c3_clean_records(spark, d):
    return cleaning.cleaned(_invoices(spark, d), INVOICES, "rulebook")["records"].select("row", "segment", "due")


@query(f"select field, rule_id, count(*) as n from (select unnest(['segment', 'segment']) as field, unnest(['trim', 'seg']) as rule_id from customer where {GOOD_INVOICE} union all select 'segment', 'map' from customer where {GOOD_INVOICE} and c_mktsegment = 'AUTOMOBILE' union all select 'due', 'due' from customer where {GOOD_INVOICE} and c_custkey % 3 = 0) group by 1, 2")
def c3_clean_changes(spark, d):
    return cleaning.cleaned(_invoices(spark, d), INVOICES, "rulebook")["changes"].groupBy("field", "rule_id").agg(F.count("*").alias("n"))


@query(f"select c_custkey as row, case when c_custkey % 3 <> 0 and c_custkey % 7 = 1 then 'due' when c_mktsegment = 'MACHINERY' then 'segment' else 'balance' end as field from customer where not ({GOOD_INVOICE})")
def c4_review_queue(spark, d):
    return cleaning.cleaned(_invoices(spark, d), INVOICES, "rulebook")["review"].select("row", "field")


@query("select page_id, case page_id % 3 when 0 then 'a' end as category, case page_id % 3 when 1 then 'unclassified' when 2 then 'needs_rule' end as tag from pages")
def c1_categorised(spark, d):
    name = F.element_at(F.array(F.lit("invoice_1.csv"), F.lit("x.pdf"), F.lit("invoice.tsv")), (F.col("page_id") % 3 + 1).cast("int"))
    rules = [cleaning.Category("a", ("csv", "tsv"), "invoice", ()), cleaning.Category("b", ("tsv",), None, ())]
    return cleaning.categorised(A.table(spark, d, "pages").withColumn("file_name", name), rules).select("page_id", "category", "tag")


@query("select c_mktsegment as sha256, c_nationkey::VARCHAR as connector, min(c_custkey) as seq from customer where c_nationkey <> 3 group by 1, 2")
def c5_intake(spark, d):
    rows = A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("sha256"), F.col("c_nationkey").cast("string").alias("connector"), F.col("c_custkey").alias("seq"))
    return cleaning.intake(rows.filter("connector = '3'"), rows)


# Merge, metrics, budgets.


@query("""with recursive e as (select o_orderkey % 500 as r, row_number() over (partition by o_orderkey % 500 order by o_orderkey) as i, sha256(o_orderstatus || '|' || o_orderpriority) as h, floor(epoch(o_orderdate))::BIGINT as ts, sha256(o_orderkey::VARCHAR) as sig from orders),
  m as (select r, i, h, ts, sig from e where i = 1 union all select e.r, e.i, case when e.h <> m.h and (e.ts > m.ts or e.ts = m.ts and e.sig > m.sig) then e.h else m.h end, case when e.h <> m.h and (e.ts > m.ts or e.ts = m.ts and e.sig > m.sig) then e.ts else m.ts end, case when e.h <> m.h and (e.ts > m.ts or e.ts = m.ts and e.sig > m.sig) then e.sig else m.sig end from m join e on e.r = m.r and e.i = m.i + 1)
  select r::VARCHAR as record_id, arg_max(h, i) as payload_hash, arg_max(ts, i) as committed_timestamp from m group by r""")
def g13_merged(spark, d):
    return merge.merged(A.merge_entries(spark, d)).select("record_id", "payload_hash", "committed_timestamp")


@query("select p_partkey, p_size in (11, 13, 20, 32) or p_name like '%claim%' or p_brand like 'claim_%' as human from part")
def g14_needs_human(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("tile_type"), F.col("p_name").alias("type_name"), F.col("p_brand").alias("record_id"))
    return rows.select("p_partkey", merge.needs_human().alias("human"))


@query("select l_suppkey, count(*) as n, list_sort(list(l_orderkey))[least(floor(count(*) * 0.5)::BIGINT, count(*) - 1) + 1] / 1000 as p50_ms, list_sort(list(l_orderkey))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] / 1000 as p99_ms from lineitem group by l_suppkey")
def a2_latency_metrics(spark, d):
    return merge.latency_metrics(A.table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey")


@query(f"""with recursive a as (select user_id % 100 as ledger, {EPOCH} as ts, event_id as seq, case event_type when 'purchase' then (floor(abs(value) * 100) + 1000) * 0.0001 else 0 end as cost, event_type <> 'purchase' as free from events where event_type in ('purchase', 'click')),
  n as (select *, ts // 86400 as day, row_number() over (partition by ledger, ts // 86400 order by ts, seq) as i from a),
  r as (select ledger, day, i, seq, free or cost <= 1.0 as ok, case when not free and cost <= 1.0 then cost else 0 end as spent from n where i = 1
    union all select n.ledger, n.day, n.i, n.seq, n.free or r.spent + n.cost <= 1.0, r.spent + case when not n.free and r.spent + n.cost <= 1.0 then n.cost else 0 end from r join n on n.ledger = r.ledger and n.day = r.day and n.i = r.i + 1)
  select seq, case when ok then 'executed' else 'deferred' end as status, round(spent, 6) as spent from r""")
def w3_budget(spark, d):
    return merge.budget(A.ledger_actions(spark, d)).select("seq", "status", F.round("spent", 6).alias("spent"))


@query(f"""with e as (select user_id % 40 as plan_id, event_id as seq, case event_type when 'signup' then 'plan' when 'error' then 'amendment' else 'run' end as kind from events),
  p as (select *, count(*) filter (kind = 'plan') over (partition by plan_id order by seq rows unbounded preceding) as epoch from e),
  v as (select *, case when epoch > 0 then count(*) filter (kind = 'amendment') over (partition by plan_id, epoch order by seq rows unbounded preceding) else 0 end as plan_version from p),
  r as (select *, first_value(plan_version) over (partition by plan_id order by seq) as f from v where kind = 'run') select seq as run_seq, plan_version, plan_version <> f as switched from r""")
def w4_run_report(spark, d):
    rows = A.table(spark, d, "events").select((F.col("user_id") % 40).alias("plan_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "plan").when(F.col("event_type") == "error", "amendment").otherwise("run").alias("kind"), F.col("event_type").alias("hash"), F.lit("ok").alias("outcome"))
    return merge.run_report(rows).select("run_seq", "plan_version", "switched")


@query("""with t as (select s_suppkey as team_id, s_suppkey % 7 as w, (s_suppkey * 3) % 11 as gw, s_suppkey % 5 as gl from supplier), g as (select s_suppkey as a, s_suppkey * 7 % (select count(*) from supplier) + 1 as b from supplier),
  b as (select g.a, sum(t.w)::BIGINT as buchholz from g join t on t.team_id = g.b group by g.a)
  select row_number() over (order by w desc, coalesce(buchholz, 0) desc, gw - gl desc, team_id)::INT as rank, team_id, coalesce(buchholz, 0) as buchholz from t left join b on b.a = t.team_id""")
def a7_standings(spark, d):
    rows = A.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    teams = rows.select(key.alias("team_id"), (key % 7).alias("match_wins"), (7 - key % 7).alias("match_losses"), (key * 3 % 11).alias("game_wins"), (key % 5).alias("game_losses"))
    games = rows.select(key.alias("team_id"), (key * 7 % rows.count() + 1).alias("opponent_id"))
    return merge.standings(teams, games).select("rank", "team_id", "buchholz")


@query("select null as parent, 'O' || min(l_orderkey::VARCHAR) as part_number, 1.0::DOUBLE as quantity from lineitem union all select 'O' || l_orderkey, 'P' || l_partkey, sum(l_quantity) from lineitem group by 1, 2")
def a13_bill_of_materials(spark, d):
    return merge.bill_of_materials(A.part_uses(spark, d)).select("parent", "part_number", "quantity")


@query("select case when o_orderkey % 2 = 0 then 0 else 12 end as tile_type, count(*) as added, count(*) filter (o_orderkey % 7 = 0) as withdrawn from orders where o_orderkey // 100 > 1 and o_orderkey // 100 <= 5 group by 1")
def a10_added_between(spark, d):
    key = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select(F.floor(key / 100).alias("tile_id"), F.when(key % 2 == 0, 0).otherwise(12).alias("tile_type"), (key % 7 == 0).alias("withdrawn"))
    return merge.added_between(rows, 1, 5)


@query(f"select seq, recent, recent <= 2 as allowed from (select event_id as seq, count(*) over (partition by user_id % 20 order by {EPOCH} // 600 range between 59 preceding and current row) as recent from events)")
def w8_rate_limited(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("session"), F.floor(A.epoch() / 600).alias("ts"))
    return merge.rate_limited(rows, 2).select("seq", "recent", "allowed")


@query("select event_id as seq, case when x >= 0 then 2 * x else -2 * x - 1 end as code from (select event_id, event_id % 13 - lag(event_id % 13, 1, 0) over (partition by user_id order by event_id) as x from events)")
def w9_deltas(spark, d):
    from pyspark.sql import Window

    v = F.col("event_id") % 13
    change = v - F.lag(v, 1, 0).over(Window.partitionBy("user_id").orderBy("event_id"))
    return A.table(spark, d, "events").select(F.col("event_id").alias("seq"), S.zigzag(change).alias("code"))


# Evidence.


@query("select l.doc_id as claim_id, case when l.doc_id % 2 = 0 then l.doc_id else 1 end as paper_id, '10.1000/' || case when l.doc_id % 2 = 0 then l.doc_id else 1 end as doi, l.doc_id % 3 = 0 as verified from labels l")
def j4_proof_chains(spark, d):
    rows = A.table(spark, d, "labels")
    claims = rows.select(F.col("doc_id").alias("claim_id"), F.lit(None).cast("bigint").alias("citation_fingerprint_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("v"), "doc_id")).alias("verification_uuid"), F.col("doc_id").alias("seq"))
    prints = rows.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("paper_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("content_sha256"), (F.col("doc_id") + 10).alias("seq"))
    first = spark.range(1).select(F.lit(1).cast("bigint").alias("paper_id"), F.lit("first").alias("content_sha256"), F.lit(0).cast("bigint").alias("seq"))
    statements = rows.select(F.concat(F.lit("v"), "doc_id").alias("id"))
    found = evidence.proof_chains(claims.filter("claim_id <> 1").unionByName(claims.filter("claim_id = 1")), prints.unionByName(first), statements)
    return found.select("claim_id", "paper_id", "doi", "verified")


@query("select doc_id as paper_id, case when doc_id % 4 = 0 then '10.5/' || doc_id else '10.1000/' || doc_id end as doi from labels")
def j5_bibliography(spark, d):
    rows = A.table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), F.lit("h").alias("content_sha256"))
    return evidence.bibliography(rows, rows.filter("paper_id % 4 = 0").select("paper_id", F.concat(F.lit("10.5/"), "paper_id").alias("doi"))).select("paper_id", "doi")


@query("""with p as (select doc_id, case when doc_id % 5 = 0 then 'o' when doc_id % 3 > 0 then 'p' else 's' end as kind from labels)
  select doc_id as paper_id, kind || doc_id as source, case kind when 'o' then 'unchanged' when 'p' then case when doc_id % 2 = 0 then 'changed' else 'retracted' end else case when doc_id % 2 = 0 then 'unreachable' else 'unchanged' end end as status from p""")
def a16_recheck(spark, d):
    """Overrides of some papers, papers of most, statements of all; a second URL of each never counts."""
    rows = A.table(spark, d, "labels")
    key = F.col("doc_id")
    prints = rows.select(key.alias("paper_id"), F.lit("h").alias("content_sha256"))

    def urls(kind: str, which: str) -> DataFrame:
        some = rows.filter(which)
        first = some.select(key.alias("paper_id"), F.concat(F.lit(kind), key).alias("url"), (key * 2).alias("seq"))
        return first.unionByName(some.select(key.alias("paper_id"), F.concat(F.lit("late"), key).alias("url"), (key * 2 + 1).alias("seq")))

    sha = lambda kind: F.when((F.lit(kind) == "p"), "g").otherwise("h")
    read = [rows.filter(which).select(F.concat(F.lit(kind), key).alias("url"), sha(kind).alias("content_sha256"), ((F.lit(kind) == "p") & (key % 2 == 1)).alias("retracted")) for kind, which in (("o", "true"), ("p", "true"), ("s", "doc_id % 2 = 1"))]
    return evidence.recheck(prints, urls("o", "doc_id % 5 = 0"), urls("p", "doc_id % 3 > 0"), urls("s", "true"), files.unioned(*read))


# Text functions and files.


@query("select parent, part_number, quantity, 1 as part, concat_ws(',', parent, part_number, quantity::BIGINT || '.0') as line from (select 'O' || l_orderkey as parent, 'P' || l_partkey as part_number, sum(l_quantity) as quantity from lineitem group by 1, 2)")
def s19_bom_lines(spark, d):
    rows = merge.bill_of_materials(A.part_uses(spark, d)).filter("parent is not null").select("parent", "part_number", "quantity")
    lines = files.csv_lines(rows).filter("part = 1")
    cells = F.split("line", ",")
    return lines.select(cells[0].alias("parent"), cells[1].alias("part_number"), cells[2].cast("double").alias("quantity"), "part", "line")


@query("select event_id as seq, value from events where value > 40")
def s14_projection(spark, d):
    """Only the two columns asked for are read, and the filter reaches the scan."""
    return A.telemetry(spark, d).filter("value > 40").select("seq", "value")


@query("select event_id % 4 as tier, event_id as seq, value from events where event_id % 4 >= 2")
def s18_cold_tiers(spark, d):
    """Records of the colder tiers, as they were moved to their folders."""
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    archive = files.Archive(spark, f"{folder}/warm")
    A.telemetry(spark, d).write.parquet(f"{folder}/warm/readings")
    archive.cold("readings", F.col("seq") % 4, 2, f"{folder}/cold")
    return spark.read.parquet(f"{folder}/cold").select(F.col("tier").cast("bigint").alias("tier"), "seq", "value")


@query("select event_id as timestamp, user_id as sensor_id, event_id % 7 as metric_id, event_id / 4 as value from events")
def s7_csv_readings(spark, d):
    """Readings exported as CSV under other names, and imported."""
    path = f"{shared_folder(spark)}/imports/{uuid.uuid4().hex}"
    rows = A.table(spark, d, "events").select(F.col("event_id").alias(" Time"), F.col("user_id").alias("SENSOR"), (F.col("event_id") % 7).alias("metric"), (F.col("event_id") / 4).alias("val"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.readings_from_csv(files.read_csv(spark, path), 0)


@query("select c_custkey::VARCHAR as key, c_name as name, c_nationkey as nation from customer")
def s8_json_documents(spark, d):
    """An array of objects as a JSON file, imported as documents."""
    path = f"{shared_folder(spark)}/imports/{uuid.uuid4().hex}"
    item = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    lists = A.table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 500)).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(item)), F.lit("]")).alias("value"))
    lists.select("value").repartition(4).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    found = files.documents_from_json(spark, path, "c")
    return found.select("key", F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", "$.nation").cast("int").alias("nation"))


@query("select o_orderkey as paper_id, 1990 + o_orderkey % 30 as year from orders")
def s10_ndjson(spark, d):
    """Papers as NDJSON, read by their record type."""
    path = f"{shared_folder(spark)}/imports/{uuid.uuid4().hex}"
    A.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), (F.col("o_orderkey") % 30 + 1990).alias("year")).write.json(path)
    return files.read_ndjson(spark, path, "academic_papers").select("paper_id", F.col("year").cast("bigint").alias("year"))


@query("select doc_id, len(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as n from documents")
def t1_words(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(T.words("text")).cast("bigint").alias("n"))


@query("select c_custkey, case c_custkey % 4 when 3 then null else '10.55/ab' || c_custkey end as doi from customer")
def t2_normal_doi(spark, d):
    n = F.col("c_custkey").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit("https://doi.org/10.55/AB"), n), F.concat(F.lit("doi: 10.55/Ab"), n), F.concat(F.lit(" http://dx.doi.org/10.55/ab"), n), F.concat(F.lit("11.5/"), n)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return A.table(spark, d, "customer").select("c_custkey", T.normal_doi(raw).alias("doi"))


@query("select p_partkey, case when p_size % 3 = 0 then 'import' when p_size % 3 = 1 then 'export' end as suggestion from part")
def t4_suggestions(spark, d):
    typed = F.element_at(F.array(F.lit("Imprt"), F.lit("exporrt"), F.lit("zzzz")), (F.col("p_size") % 3 + 1).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", T.best_suggestion(typed, ["import", "export", "inspect"]).alias("suggestion"))


@query("select event_id, strftime(make_timestamp(floor(epoch(ts))::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as at from events")
def t8_iso_millis(spark, d):
    return A.table(spark, d, "events").select("event_id", T.iso_millis(A.epoch() * 1000).alias("at"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'colour' when 1 then 'Farbe' else 'colour' end as name from customer")
def t9_language_value(spark, d):
    maps = F.element_at(F.array(F.lit('{"de":"Farbe","en-GB":"colour"}'), F.lit('{"de":"Farbe"}'), F.lit('{"fr":"x","en":"colour"}')), (F.col("c_custkey") % 3 + 1).cast("int"))
    return A.table(spark, d, "customer").select("c_custkey", T.language_value(maps, "en-US").alias("name"))


@query("""select 1 as part, c_custkey || ',"' || c_mktsegment || ', x"' as line from customer union all select 0, 'key,name'""")
def s9_csv_lines(spark, d):
    return files.csv_lines(A.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat("c_mktsegment", F.lit(", x")).alias("name")))


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as place, role, text as content from conversations")
def s20_chatml(spark, d):
    made = files.chatml(A.turns(spark, d))
    said = F.from_json(F.get_json_object("json", "$.messages"), "array<struct<role:string,content:string>>")
    return made.select("conv_id", F.posexplode(said).alias("place", "m")).select("conv_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content")


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as place, case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as said_by, text as value from conversations where conv_id % 2 = 0")
def s20_sharegpt(spark, d):
    permitted = A.turns(spark, d).filter("conv_id % 2 = 0").select("conv_id").distinct()
    made = files.sharegpt(A.turns(spark, d), permitted)
    said = F.from_json(F.get_json_object("json", "$.conversations"), "array<struct<from:string,value:string>>")
    return made.select("conv_id", F.posexplode(said).alias("place", "m")).select("conv_id", F.col("place").cast("bigint").alias("place"), F.col("m.from").alias("said_by"), "m.value")


@query("select event_id as row, case when event_id % 3 = 0 then value end as value, case event_id % 3 when 1 then 'malformed' when 2 then 'not_found' end as error from events")
def s16_batch_answers(spark, d):
    rows = A.telemetry(spark, d)
    n = F.col("seq") % 3
    ask = F.when(n == 0, F.concat(F.lit("L0:T"), "tile_id", F.lit(":R"), "record_offset")).when(n == 1, "QUERY").otherwise(F.lit("L0:T999999:R1"))
    return files.answered(rows.select(F.col("seq").alias("row"), ask.alias("query")), rows).select("row", "value", "error")


@query("select o_orderkey as seq, case when o_orderkey % 20 = 18 then 'forbidden' when o_orderkey % 20 not in (10, 11, 12, 13, 14, 19) then 'unknown' else 'unauthorised' end as why from orders where o_orderkey % 20 = 18 or o_orderkey % 20 not in (10, 11, 12, 13, 14, 19, 0) or (o_orderkey % 20 = 19 and ((o_orderkey % 2 = 1 and o_orderkey % 7 not in (2, 3)) or (o_orderkey % 2 = 0 and o_orderkey % 7 in (1, 3, 4))))")
def s13_delta_violations(spark, d):
    key = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select(key.alias("seq"), F.when(key % 20 == 0, 20).otherwise(key % 20).alias("tile_type"), (key % 7).alias("mark_kind"), (key % 2).alias("set_or_clear"))
    return files.delta_violations(rows)


@query("select target_tile_id, record_index, mark_kind from (select doc_id // 1000 as target_tile_id, doc_id % 1000 as record_index, case when toxic = 1 then 1 end as mark_kind, doc_id from labels where toxic = 1) union all select doc_id // 1000, doc_id % 1000, 1 from labels where toxic = 1 and doc_id % 7 = 0")
def s12_snapshot_marks(spark, d):
    return files.snapshot({}, A.marks(spark, d))["marks"].select("target_tile_id", "record_index", "mark_kind")
