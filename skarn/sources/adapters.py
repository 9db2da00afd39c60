"""Domain records from the star schema: what an archive's tables look like when built from orders, events and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the event types.
METRICS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
DAY = 86_400
TILE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str = "ts") -> Column:
    return F.unix_timestamp(ts)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _code(names: dict[str, int], of: str) -> Column:
    out = F.lit(0)
    for name, number in names.items():
        out = F.when(F.col(of) == name, number).otherwise(out)
    return out.cast("bigint")


def _coordinates(df: DataFrame) -> DataFrame:
    return df.withColumns({"tile_id": F.floor(F.col("seq") / TILE), "record_offset": F.col("seq") % TILE})


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings; times are cut to days, so that keys have versions, and a tenth are tombstones."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.floor(epoch() / DAY) * DAY).alias("timestamp"),
        F.col("user_id").alias("sensor_id"),
        _code(METRICS, "event_type").alias("metric_id"),
        "value",
        F.when(_k() % 10 == 0, 1).otherwise(0).cast("bigint").alias("flags"),
    )
    return _coordinates(rows)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (1_700_000_000 + 60 * F.col("vec_id")).alias("timestamp"), F.col("embedding").alias("vector"), "label", F.col("vec_id").alias("seq"))


def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.col("role") == role)


def humans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir, "user")
    return rows.select(F.col("conv_id").cast("string").alias("session_uuid"), F.col("turn").alias("timestamp_sec"), (F.col("conv_id") % 97).alias("actor_hash"), F.lit(1).alias("verb_id"), (F.length("text") % 100 / 100).alias("decision_score"), F.concat(F.lit("L0:T"), F.col("conv_id"), F.lit(":R"), F.col("turn") + 1).alias("ai_trace_coord"), F.lit(0).cast("bigint").alias("flags"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir, "assistant")
    return rows.select(F.col("conv_id").cast("string").alias("session_uuid"), F.col("turn").alias("timestamp_sec"), (F.col("conv_id") % 7).alias("agent_id"), F.lit(1).alias("step_type"), (F.length("text") % 50 / 50).alias("confidence"), F.col("conv_id").alias("tile_id"), F.col("turn").alias("record_offset"), F.lit(0).cast("bigint").alias("flags"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda n: F.col("doc_id") * n % 1000 / 1000
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("venue"), unit(7).alias("topic_x"), unit(11).alias("topic_y"), unit(13).alias("topic_z"), (1990 + F.col("doc_id") % 35).cast("int").alias("year"), (F.col("n_chars") % 100).alias("citation_count"), F.col("doc_id").alias("seq"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims with the vectors of the same number, where there is one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text", F.col("doc_id").alias("seq"))
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("vector")), "claim_id", "left")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are set to quarantine, poor ones to review; every seventh is cleared again later."""
    rows = table(spark, sf_dir, "labels").withColumn("kind", F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2)).filter("kind is not null")
    target = [F.lit(12).alias("target_tile_type"), F.floor(F.col("doc_id") / TILE).alias("target_tile_id"), (F.col("doc_id") % TILE).alias("record_index"), F.col("kind").alias("mark_kind")]
    sets = rows.select(*target, F.lit(1).alias("set_or_clear"), F.col("doc_id").alias("timestamp"), (F.col("doc_id") * 2).alias("seq"))
    clears = rows.filter(F.col("doc_id") % 7 == 0).select(*target, F.lit(0).alias("set_or_clear"), F.col("doc_id").alias("timestamp"), (F.col("doc_id") * 2 + 1).alias("seq"))
    return sets.unionByName(clears)


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for each customer: a grant for research; then even keys withdraw, every fifth expires, every ninth is held."""
    rows = table(spark, sf_dir, "customer")
    base = lambda seq, withdrawn, expires, hold: rows.select(F.col("c_custkey").cast("string").alias("subject_id"), (F.col("c_custkey") % 3).alias("study_id"), F.lit(1).alias("purpose"), F.lit(100).cast("bigint").alias("granted_at"), expires.cast("bigint").alias("expires_at"), withdrawn.cast("bigint").alias("withdrawn_at"), hold.cast("int").alias("legal_hold"), (F.col("c_custkey") * 2 + seq).alias("seq"))
    key = F.col("c_custkey")
    return base(0, F.lit(0), F.lit(0), F.lit(0)).unionByName(base(1, F.when(key % 2 == 0, 200).otherwise(0), F.when(key % 5 == 0, 500).otherwise(0), F.when(key % 9 == 0, 1).otherwise(0)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions contain nations contain customers, who placed orders; (src, dst, edge_type, seq, edge_id)."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c))
    made = nation.select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst"), F.lit("contains").alias("edge_type"), F.col("n_nationkey").cast("bigint").alias("seq"))
    made = made.unionByName(customer.select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst"), F.lit("contains").alias("edge_type"), (1000 + F.col("c_custkey")).alias("seq")))
    made = made.unionByName(orders.select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst"), F.lit("placed").alias("edge_type"), (10_000_000 + F.col("o_orderkey")).alias("seq")))
    return made.withColumn("edge_id", F.col("seq"))


def tree_edges(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """node_(i div 4) -> node_(i + 1) for i below n; every fifth edge cites, the others contain."""
    rows = spark.range(n)
    return rows.select(F.concat(F.lit("node_"), F.floor(F.col("id") / 4)).alias("src"), F.concat(F.lit("node_"), F.col("id") + 1).alias("dst"), F.when(F.col("id") % 5 == 0, "cites").otherwise("contains").alias("edge_type"), F.col("id").alias("seq"))


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_quantity").alias("px"), F.round(100 * F.col("l_discount") + 0.0, 2).alias("py"), F.round(100 * F.col("l_tax") + 0.0, 2).alias("pz"), (epoch("l_shipdate") * 1_000_000).alias("timestamp_us"), F.col("l_suppkey").alias("robot_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def survey_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((key * 7919 % 180_000_001 - 90_000_000).cast("int").alias("lat_micro"), (key * 104_729 % 360_000_001 - 180_000_000).cast("int").alias("lon_micro"), (key * 31 % 5_000_000).cast("int").alias("elevation_mm"), (key % 4).cast("int").alias("point_class"), key.alias("seq"))


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("tx_count"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(F.col("o_orderkey").alias("block_height"), epoch("o_orderdate").alias("timestamp_sec"), F.coalesce("tx_count", F.lit(0)).alias("tx_count"), F.col("o_orderkey").alias("seq"))


def wearables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.functions.spatial import wearable_code

    return table(spark, sf_dir, "events").select(epoch().alias("timestamp_sec"), (F.col("user_id") % 8).alias("sensor_id"), _code(METRICS, "event_type").alias("metric_id"), wearable_code(F.col("value")).alias("quantized"), F.col("event_id").alias("seq"))


#: Verbs that the event types stand for.
VERB_OF = {"click": "completed", "error": "voided", "purchase": "mastered", "signup": "registered", "view": "attempted"}


def statement_id(of: Column) -> Column:
    h = F.md5(of.cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as learning records; an error voids the statement seven before it, where that is no error itself."""
    rows = table(spark, sf_dir, "events")
    verb = F.lit("")
    for kind, name in VERB_OF.items():
        verb = F.when(F.col("event_type") == kind, f"http://example.org/verbs/{name}").otherwise(verb)
    errors = rows.filter("event_type = 'error'").select((F.col("event_id") + 7).alias("event_id")).withColumn("_after_error", F.lit(True))
    rows = rows.join(errors, "event_id", "left")
    voids = F.when((F.col("event_type") == "error") & F.col("_after_error").isNull() & (F.col("event_id") >= 7), statement_id(F.col("event_id") - 7))
    return rows.select(
        statement_id(F.col("event_id")).alias("id"),
        (epoch() * 1000).alias("stored_ms"),
        F.concat(F.lit("mailto:u"), F.col("user_id"), F.lit("@example.org")).alias("actor"),
        verb.alias("verb"),
        F.concat(F.lit("http://example.org/items/"), _k()).alias("object_id"),
        F.lit("Activity").alias("object_type"),
        statement_id(F.col("user_id") % 50).alias("registration"),
        voids.alias("voids"),
        F.when(_k() % 3 == 0, True).when(_k() % 3 == 1, False).alias("success"),
        (_k() % 100 / 100).alias("scaled"),
        F.col("props").alias("raw_json"),
        F.col("event_id").alias("seq"),
    )


def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select((F.col("o_orderkey") % 500).cast("string").alias("record_id"), F.lit(0).alias("tile_type"), F.lit("telemetry").alias("type_name"), F.sha2(F.concat("o_orderstatus", F.lit("|"), "o_orderpriority"), 256).alias("payload_hash"), epoch("o_orderdate").alias("committed_timestamp"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit_signature"), F.col("o_orderkey").alias("seq"))


def ledger_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as paid actions, one ledger for each hundredth user."""
    rows = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click')")
    return rows.select((F.col("user_id") % 100).alias("ledger"), epoch().alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "sandbox").otherwise("free").alias("kind"), (F.floor(F.abs(F.col("value")) * 100) + 1000.0).alias("units"))


def part_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("parent"), F.concat(F.lit("P"), F.col("l_partkey")).alias("child"), F.col("p_name").alias("name"), F.col("l_quantity").alias("quantity"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
