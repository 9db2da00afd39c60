"""Small cases with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from skarn import schema
from skarn.functions import spatial as S
from skarn.functions import text as T
from skarn.functions import vectors as V
from skarn.operators import cleaning, evidence, governance, graph, lrs, merge, packs, sessions, telemetry
from skarn.sources import adapters, files
from skarn.streaming import ingest

READING = "timestamp long, sensor_id long, metric_id long, value double, flags long, seq long"


def readings(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], READING)


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_versions(spark):
    two = readings(spark, (100, 1, 1, 1.5, 0), (100, 1, 1, 2.5, 0))
    assert values(telemetry.compact(two), "value") == [(1.5,), (2.5,)]
    assert values(telemetry.sift(two), "value") == values(telemetry.fuse(two), "value") == [(2.5,)]
    dead = readings(spark, (100, 1, 1, 1.0, 0), (100, 1, 1, 0.0, 1), (200, 1, 1, 3.0, 0))
    assert values(telemetry.compact(dead), "timestamp", "value") == values(telemetry.sift(dead), "timestamp", "value") == [(200, 3.0)]
    assert telemetry.live_counts(dead).first() == telemetry.live_counts(telemetry.compact(dead)).first()


def test_lifecycle(spark):
    empty = readings(spark, (0, 0, 0, 0.0, 1)).limit(0)
    new = spark.createDataFrame([(1000, 42, 99, 123.45)], "timestamp long, sensor_id long, metric_id long, value double")
    stored = telemetry.inserted(empty, new)
    assert values(telemetry.sift(stored, 500, 1500, 42, limit=5), "value") == [(123.45,)]
    assert values(telemetry.sift(telemetry.updated(stored, new.withColumn("value", F.lit(7.0)))), "value") == [(7.0,)]
    gone = telemetry.deleted(stored, new)
    assert telemetry.compact(gone).count() == 0 and telemetry.tombstones(gone, new).count() == 0
    with pytest.raises(Exception, match="legal hold"):
        telemetry.purged(stored, new, spark.createDataFrame([("42",)], "subject_id string")).count()


def test_hundred_thousand_readings(spark):
    rows = spark.range(100_000).select((1000 + 10 * F.col("id")).alias("timestamp"), (F.col("id") % 100).alias("sensor_id"), (F.col("id") % 5).alias("metric_id"), (F.col("id") * 0.1).alias("value"), F.lit(0).cast("long").alias("flags"), F.col("id").alias("seq"))
    assert values(telemetry.sift(rows, 5000, 6000, 42), "seq") == [(442,)]


def test_erased_records_go_with_what_they_replaced(spark):
    rows = readings(spark, (1, 1, 1, 1.0, 0), (1, 1, 1, 2.0, 0), (1, 1, 1, 3.0, 0))
    erased = rows.filter("seq = 1").select(telemetry.record_hash().alias("erased_record_hash"))
    assert values(telemetry.compact(rows, erased), "seq") == [(2,)]
    with pytest.raises(Exception, match="legal hold"):
        telemetry.compact(rows, erased, held=True).collect()
    dead = readings(spark, (1, 1, 1, 1.0, 0), (1, 1, 1, 0.0, 1))
    assert values(telemetry.compact(dead, held=True), "seq") == [(1,)]


def test_hidden_newest_shows_older(spark):
    rows = readings(spark, (1, 1, 1, 1.0, 0), (1, 1, 1, 2.0, 0)).withColumns({"tile_id": F.lit(0), "record_offset": F.col("seq")})
    hidden = spark.createDataFrame([(0, 1)], "tile_id int, record_offset long")
    assert values(telemetry.sift(rows, hidden=hidden), "value") == [(1.0,)]


def test_prune_never_changes_results(spark):
    stats = spark.createDataFrame([(0, 1, 5), (1, 6, 9), (2, 10, 20)], "tile_id long, min_ts long, max_ts long")
    assert values(telemetry.prunable(stats, 6, 9), "tile_id") == [(0,), (2,)]


def test_consent(spark):
    rows = [governance.grant("s", 1, 1, 0, 10) | {"seq": 0}, governance.grant("s", 1, 3, 0, 10, 50) | {"seq": 1}, governance.grant("h", 1, 1, 0, 10, legal_hold=True) | {"seq": 2}, governance.grant("s", 1, 1, 0, 10) | {"withdrawn_at": 20, "seq": 3}]
    table = spark.createDataFrame(rows)
    assert values(governance.consented(table, 1, 30), "subject_id") == [("h",)]
    assert values(governance.consented(table, 3, 50), "subject_id") == [("s",)] and governance.consented(table, 3, 51).count() == 0
    assert governance.consented(table, 2, 30).count() == 0
    assert values(governance.legal_holds(table), "subject_id") == [("h",)]
    records = spark.createDataFrame([("s",), ("h",), ("x",)], "who string")
    assert governance.consent_gate(records, table, "who", None, 30).count() == 3
    assert values(governance.consent_gate(records, table, "who", 1, 30), "who") == [("h",)]


def test_chains_show_tampering(spark):
    rows = spark.createDataFrame([("a", i, f"x{i}") for i in range(5)] + [("b", 1, "y")], "subject string, seq long, body string")
    chain = governance.chained(rows, ["subject"], "seq", F.col("body"))
    assert governance.broken_links(chain, ["subject"], "seq", F.col("body")).count() == 0
    bent = chain.withColumn("body", F.when(F.col("seq") == 2, "z").otherwise(F.col("body")))
    assert values(governance.broken_links(bent, ["subject"], "seq", F.col("body")), "subject", "seq") == [("a", 2)]
    with pytest.raises(PermissionError):
        governance.erasures(rows, rows, rows, by_agent=True)


def test_vectors(spark):
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    r = one(spark, dot8=V.int8_dot(a(10, 20, -5, 4), a(2, -1, 4, 10)), d8=V.squared_distance(a(10, 20, -5, 4), a(2, -1, 4, 10)), dot=V.dot(a(1, 2, 3, 4, 5), a(2, 0.5, 1, -1, 2)), d=V.squared_distance(a(1, 2, 3), a(4, 6, 3)), zero=V.cosine(a(0, 0), a(1, 1)), same=V.cosine(a(3, 4), a(6, 8)))
    # 10*2 - 20 - 20 + 40 = 20; 64 + 441 + 81 + 36 = 622
    assert (r.dot8, r.d8, r.dot, r.d, r.zero) == (20, 622.0, 12.0, 25.0, 0.0) and abs(r.same - 1) < 1e-12
    packed = one(spark, p=V.unpack_nibbles(V.pack_nibbles(F.array(*(F.lit(i) for i in (1, 15, 7))))))
    assert packed.p == [1, 15, 7, 0]
    q = one(spark, q=V.quantize_4bit(a(0, 1, 15)))
    assert q.q.codes == [0, 1, 15]


def test_array_slice(spark):
    chunks = spark.createDataFrame([([0, 0], [4, 4], list(range(100, 116))), ([0, 4], [4, 4], list(range(200, 216)))], "chunk_coords array<long>, shape array<long>, data array<int>")
    found = packs.array_slice(chunks, [(1, 3), (2, 6)], -1).orderBy("c0", "c1")
    assert [r.value for r in found.collect()] == [106, 107, 204, 205, 110, 111, 208, 209]
    assert [r.value for r in packs.array_slice(chunks, [(4, 5), (0, 2)], -1).collect()] == [-1, -1]
    assert packs.array_slice(chunks, [(2, 2), (0, 2)], -1).count() == 0


def test_curves(spark):
    cells = spark.range(64).select((F.col("id") % 4).alias("x"), (F.floor(F.col("id") / 4) % 4).alias("y"), F.floor(F.col("id") / 16).alias("z"))
    rows = sorted(cells.select(S.hilbert_3d("x", "y", "z", 2).alias("h"), "x", "y", "z").collect())
    assert [r.h for r in rows] == list(range(64))
    assert all(sum(abs(a[i] - b[i]) for i in (1, 2, 3)) == 1 for a, b in zip(rows, rows[1:], strict=False))
    assert one(spark, m=S.morton_3d(F.lit(1), F.lit(2), F.lit(3), 2)).m == 0b110101
    r = one(spark, a=S.wrapped_contains(350, 370, F.lit(5.0), 360), b=S.wrapped_contains(350, 370, F.lit(20.0), 360), z=S.zigzag(F.lit(-3)), w=S.wearable_code(F.lit(200.0)), q=S.frame_code(F.lit(-0.5), 0, 1))
    assert (r.a, r.b, r.z, r.w, r.q) == (True, False, 5, 32767, -1)


ASSEMBLY = [("GEARBOX-001", "SHAFT-MAIN-10"), ("GEARBOX-001", "HOUSING-TOP-20"), ("SHAFT-MAIN-10", "BEARING-101"), ("BEARING-101", "BALL-STEEL-01")]


def test_assembly(spark):
    edges = spark.createDataFrame([(a, b, "has_part", i) for i, (a, b) in enumerate(ASSEMBLY)], "src string, dst string, edge_type string, seq long")
    assert [r.dst for r in graph.neighbors(edges, "GEARBOX-001").collect()] == ["SHAFT-MAIN-10", "HOUSING-TOP-20"]
    assert values(graph.traverse(edges, "GEARBOX-001", 2), "dst") == [("BEARING-101",), ("HOUSING-TOP-20",), ("SHAFT-MAIN-10",)]
    steps = graph.path(edges, "GEARBOX-001", "BALL-STEEL-01", "HAS_PART").orderBy("step").collect()
    assert [r.node for r in steps] == ["GEARBOX-001", "SHAFT-MAIN-10", "BEARING-101", "BALL-STEEL-01"]
    assert graph.path(edges, "BALL-STEEL-01", "GEARBOX-001").count() == 0
    assert [r.node for r in graph.path(edges, "X", "X").collect()] == ["X"]
    assert graph.traverse(edges, "GEARBOX-001", 0).count() == 0


def test_first_shortest_path_wins_ties(spark):
    edges = spark.createDataFrame([("a", "c", 5), ("a", "b", 1), ("b", "d", 9), ("c", "d", 2), ("d", "a", 3)], "src string, dst string, seq long").withColumn("edge_type", F.lit("t"))
    assert [r.node for r in graph.path(edges, "a", "d").orderBy("step").collect()] == ["a", "b", "d"]
    assert values(graph.traverse(edges, "a", 3), "src", "dst") == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")]


def test_large_tree(spark):
    edges = adapters.tree_edges(spark).cache()
    steps = [r.node for r in graph.path(edges, "node_0", "node_99999").orderBy("step").collect()]
    told, n = [99999], 99999
    while n:
        n = (n - 1) // 4
        told.append(n)
    assert steps == [f"node_{i}" for i in reversed(told)]
    assert graph.neighbors(edges, "node_7").count() == 4


def test_merge_is_a_fold(spark):
    def run(*rows):
        table = spark.createDataFrame([("r", kind, "t", h, ts, sig, i) for i, (kind, h, ts, sig) in enumerate(rows)], "record_id string, tile_type int, type_name string, payload_hash string, committed_timestamp long, commit_signature string, seq long")
        r = merge.merged(table).first()
        return r.payload_hash, r.committed_timestamp, r.rule

    assert run((0, "h1", 1, "a"), (0, "h1", 5, "b"), (0, "h2", 3, "c")) == ("h2", 3, "timestamp_lww")
    assert run((0, "h1", 1000, "z"), (0, "h2", 1050, "a")) == ("h2", 1050, "timestamp_lww")
    assert run((0, "h1", 1000, "z"), (0, "h2", 950, "zz")) == ("h1", 1000, "timestamp_lww_existing_newer")
    assert run((0, "h1", 1000, "a"), (0, "h2", 1000, "b")) == ("h2", 1000, "signature_tie_break")
    assert run((20, "h1", 1000, "a"), (20, "h2", 2000, "b")) == ("h1", 1000, "needs_human")


def test_budget_defers(spark):
    rows = [(1, 10, 0, "sandbox", 6000.0), (1, 20, 1, "sandbox", 5000.0), (1, 30, 2, "free", 9.0), (1, 40, 3, "sandbox", 4000.0), (1, 86_400, 4, "sandbox", 5000.0)]
    ledger = merge.budget(spark.createDataFrame(rows, "ledger long, ts long, seq long, kind string, units double"))
    assert [r.status for r in ledger.orderBy("seq").collect()] == ["executed", "deferred", "executed", "executed", "executed"]
    days = {r.day: r for r in merge.budget_status(ledger).collect()}
    assert days[0].spent == 1.0 and days[0].cap_reached and days[0].n_deferred == 1 and days[1].pct_spent == 50.0 and not days[1].warning


def test_bill_of_materials(spark):
    uses = spark.createDataFrame([("root", "shaft", "Shaft", 1.0), ("shaft", "bearing", "B", 1.0), ("shaft", "bearing", "B", 1.0)], "parent string, child string, name string, quantity double")
    assert sorted((r.parent or "", r.part_number, r.quantity) for r in merge.bill_of_materials(uses).collect()) == [("", "root", 1.0), ("root", "shaft", 1.0), ("shaft", "bearing", 2.0)]


def test_sessions(spark):
    humans = spark.createDataFrame([("a", 1_700_000_001, 1, 1.0), ("b", 1_700_000_003, 2, 0.85)], "session_uuid string, timestamp_sec long, actor_hash long, decision_score double")
    ais = spark.createDataFrame([("a", 1_700_000_002, 7, 0.98), ("b", 1_700_000_004, 7, 0.95)], "session_uuid string, timestamp_sec long, agent_id long, confidence double")
    assert sessions.bundle(humans, ais).groupBy("session_uuid").count().filter("count = 2").count() == 2
    r = sessions.aggregate(humans, ais).orderBy("session_uuid").first()
    assert (r.duration, r.n_humans, r.n_ais, r.mean_score, r.mean_confidence) == (1, 1, 1, 1.0, 0.98)


def statement(i, verb="experienced", mail="privacy@example.com", **more):
    body = {"id": f"00000000-0000-4000-8000-{i:012d}", "actor": {"mbox": f"mailto:{mail}"}, "verb": {"id": f"http://adlnet.gov/expapi/verbs/{verb}"}, "object": {"id": f"http://x.org/{i}"}}
    return json.dumps(body | more), i * 1000, i


def raw_table(spark, *rows):
    return spark.createDataFrame(list(rows), "raw_json string, stored_ms long, seq long")


def test_statements(spark):
    target = "00000000-0000-4000-8000-000000000001"
    rows = lrs.parsed(raw_table(spark, statement(1), statement(2, "voided", object={"objectType": "StatementRef", "id": target}), statement(3, mail="b@x.org")))
    found = lrs.matching(rows, actor="mailto:privacy@example.com", verb="http://adlnet.gov/expapi/verbs/experienced")
    assert values(found, "seq") == [(2,)]
    assert values(lrs.matching(rows, since=2000, until=3000), "seq") == [(3,)]
    hidden = rows.filter("seq = 3").select("id")
    assert lrs.matching(rows, actor="mailto:b@x.org", hidden=hidden).count() == 0 and lrs.matching(rows, actor="mailto:b@x.org").count() == 1
    page, more = lrs.page(rows, limit=2)
    assert [r.seq for r in page.collect()] == [3, 2] and more == "offset=2" and lrs.page(rows)[1] is None


def test_statement_rules(spark):
    bad = raw_table(spark, statement(1), statement(2, id="no"), statement(3, verb="x y"), statement(4, actor={}), statement(5, result={"duration": "PT"}), statement(6, result={"score": {"scaled": 1.5}}), statement(7, context={"language": "e"}), statement(8, result={"duration": "P1DT2H"}, context={"language": "de-AT"}))
    assert {r.seq: r.why for r in lrs.violations(bad).collect()} == {2: "id is no UUID", 3: "verb id is no IRI", 4: "agent has no identifier", 5: "duration is malformed", 6: "scaled score is out of range", 7: "language is no tag"}


def test_profile_rules(spark):
    base = "http://adlnet.gov/expapi/verbs/"
    bad = raw_table(spark, statement(1, "approved"), statement(2, "approved", result={"success": True}), statement(3, "cited", object={"objectType": "Agent"}), statement(4, "reviewed", object={"id": "no iri"}), statement(5, "unknown", object={"id": "no iri"}))
    assert {r.seq: r.why for r in lrs.profile_violations(bad, base).collect()} == {1: "success is missing", 3: "cited work is missing", 4: "activity id is no IRI"}
    assert values(lrs.with_verb_labels(lrs.parsed(bad), base), "seq", "verb_id") == [(1, 3), (2, 3), (3, 7), (4, 2), (5, None)]
    foreign = spark.createDataFrame([(1, "http://other.example/approved"), (2, "http://purl.org/spar/cito/cites"), (3, lrs.VERB_BASE + "approved"), (4, "approved")], "seq long, verb string")
    assert values(lrs.with_verb_labels(foreign), "seq", "verb_id") == [(1, None), (2, 7), (3, 3), (4, None)]


def test_projections_replay(spark):
    rows = lrs.parsed(raw_table(spark, statement(1, "completed", result={"success": False}), statement(2, "mastered", result={"score": {"scaled": 0.5}}), statement(3, "earned"), statement(4, "assigned"), statement(5, "nothing")))
    live, again = lrs.projections(rows), lrs.projections(rows.repartition(3))
    assert {k: v.count() for k, v in live.items()} == {"person": 1, "resource": 5, "event": 1, "competency": 1, "credential": 1, "goal": 1}
    assert live["event"].first().status == "failed" and live["competency"].first().confidence == 0.5 and live["goal"].first().target_ms == 4000 + 30 * lrs.DAY_MS
    assert all(sorted(map(repr, live[k].collect())) == sorted(map(repr, again[k].collect())) for k in live)


INVOICE = cleaning.Category("invoice", ("csv",), "invoice", (cleaning.Field("date", "date", True), cleaning.Field("currency", allowed=("USD",)), cleaning.Field("total", "decimal", True)), (cleaning.Rule("t", "trim"), cleaning.Rule("u", "uppercase", "currency"), cleaning.Rule("d", "date_iso", "date")))


def test_cleaning(spark):
    rows = spark.createDataFrame([("f", 0, "10/21/2026", " usd", "1.5"), ("f", 1, "2026-10-21", "GBP", "2"), ("f", 2, "01/02/2026", "USD", "3"), ("f", 3, "21.10.2026", "USD", "")], "source string, row long, date string, currency string, total string")
    out = cleaning.cleaned(rows, INVOICE, "book")
    assert values(out["records"], "row", "date", "currency") == [(0, "2026-10-21", "USD")]
    assert values(out["changes"], "row", "field", "before", "after", "rule_id") == [(0, "currency", " usd", "usd", "t"), (0, "currency", "usd", "USD", "u"), (0, "date", "10/21/2026", "2026-10-21", "d")]
    assert values(out["review"], "row", "field") == [(1, "currency"), (2, "date"), (3, "total")]
    assert cleaning.body_hash(out) == cleaning.body_hash(cleaning.cleaned(rows.repartition(3), INVOICE, "book"))
    files_ = spark.createDataFrame([("invoice_oct.csv", ["date", "x"]), ("payroll.xlsx", ["date"])], "file_name string, header array<string>")
    assert {r.file_name: r.tag for r in cleaning.categorised(files_, [INVOICE]).collect()} == {"invoice_oct.csv": None, "payroll.xlsx": "unclassified"}
    assert values(cleaning.bad_headers(files_, INVOICE), "file_name") == [("invoice_oct.csv",)]
    blobs = spark.createDataFrame([("a",), ("b",)], "sha256 string")
    assert values(cleaning.orphans(blobs, blobs.filter("sha256 = 'a'")), "sha256") == [("b",)]


def test_documents(spark):
    rows = spark.createDataFrame([(3, "k", "{}", True, None, None, False)], "doc_kind int, key string, content string, is_json boolean, if_match string, if_none_match string, merge boolean")
    none = spark.createDataFrame([], "doc_kind int, key string, content string, is_json boolean, seq long")
    assert lrs.put_outcomes(none, rows).first().outcome == "invalid"
    old = spark.createDataFrame([(3, "k", "[1]", True, 1)], none.schema)
    assert lrs.put_outcomes(old, rows.withColumn("merge", F.lit(True))).first().outcome == "invalid"


def test_text(spark):
    r = one(spark, d=T.iso_date(F.lit("13/02/2026")), a=T.iso_date(F.lit("01/02/2026")), s=T.iso_date(F.lit("03/03/2026")), n=T.iso_date(F.lit("2026-02-30")), u=T.is_utc_timestamp(F.lit("2026-02-28T10:00:00Z")), v=T.is_utc_timestamp(F.lit("2026-02-30T10:00:00Z")), w=T.is_duration(F.lit("P3W")), x=T.is_duration(F.lit("P")), m=T.mime_of(F.lit(b"%PDF-1.7")), c=T.csv_cell(F.lit('a"b')), t=T.tsv_cell(F.lit("a\tb\nc")))
    assert (r.d, r.a, r.s, r.n, r.u, r.v, r.w, r.x, r.m, r.c, r.t) == ("2026-02-13", None, "2026-03-03", None, True, False, True, False, "application/pdf", '"a""b"', "a b c")


def test_archive(spark, tmp_path):
    archive = files.Archive(spark, str(tmp_path / "a"))
    kind = schema.REGISTRY["telemetry"]
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").alias("timestamp"), F.lit(1).cast("long").alias("sensor_id"), F.lit(2).cast("long").alias("metric_id"), F.lit(0.5).alias("value"), F.lit(0).cast("long").alias("flags"))
    archive.append("telemetry", rows, bloom="sensor_id")
    archive.append("telemetry", rows.limit(10))
    back = archive.read("telemetry")
    assert back.count() == 1010 and back.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first() == (0, 1009, 1010)
    assert back.filter("seq < 1000 and seq <> timestamp").count() == 0
    assert telemetry.fetch(back, 0, 17).first().timestamp == 17
    assert archive.cold("telemetry", F.col("timestamp") % 3, 1, str(tmp_path / "cold")) == back.filter("timestamp % 3 >= 1").count()
    with pytest.raises(schema.AddonRequired):
        files.Archive(spark, str(tmp_path / "b"), addon_mask=4).append("academic_papers", rows)
    with pytest.raises(schema.PackRequired):
        schema.require_pack("nothing", 255)
    assert kind.bit == 0 and schema.BY_NUMBER[0] is kind


def test_imports(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Time, Sensor ,metric,VAL\n5,1,2,x\nbad,3,4,1.5\n")
    raw = files.read_csv(spark, str(tmp_path / "r.csv"))
    assert values(files.readings_from_csv(raw, 99), "timestamp", "sensor_id", "value") == [(5, 1, 0.0), (99, 3, 1.5)]
    (tmp_path / "d.csv").write_text('id,a,b\nk1,1,"x ""y"""\nk2,2.50,\n')
    docs = files.documents_from_csv(files.read_csv(spark, str(tmp_path / "d.csv")), "d")
    assert {r.key: json.loads(r.content)["a"] for r in docs.collect()} == {"k1": 1, "k2": 2.5}
    (tmp_path / "j.json").write_text('[{"id":"a","v":1},{"v":2}]')
    (tmp_path / "o.json").write_text('{"x":{"v":3},"y":4}')
    found = {r.key: r.content for p in ("j", "o") for r in files.documents_from_json(spark, str(tmp_path / f"{p}.json"), p).collect()}
    assert set(found) == {"a", "j:1", "x", "y"} and json.loads(found["x"]) == {"v": 3}
    table = files.union_of_keys(spark.createDataFrame([("1", '{"b":1,"a":2}', 0), ("2", '{"c":3,"a":4}', 1)], "key string, content string, seq long"))
    assert table.columns == ["key", "b", "a", "c"] and table.count() == 2
    (tmp_path / "p.ndjson").write_text('{"paper_id": 5, "year": 2001}\n')
    assert files.read_ndjson(spark, str(tmp_path / "p.ndjson"), "academic_papers").first().year == 2001


def test_delta(spark):
    entries = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, tile_type int, mark_kind int, set_or_clear int")
    good = entries((10, None, None), (19, 2, 1), (19, 3, 1), (19, 2, 0))
    assert files.delta_outcome(1, 0, good) == "apply" and files.delta_outcome(1, 1, good) == "replay" and files.delta_outcome(3, 1, good) == "gap"
    assert files.delta_outcome(1, 0, entries((18, None, None))) == files.delta_outcome(1, 0, entries((19, 1, 1))) == files.delta_outcome(1, 0, entries((19, 4, 0))) == "refused"
    marks = spark.createDataFrame([(12, 0, 5, 1)], "target_tile_type int, target_tile_id long, record_index long, mark_kind int")
    places = spark.createDataFrame([(12, 0, 5, 2, 9)], "target_tile_type int, target_tile_id long, record_index long, new_tile_id long, new_index long")
    assert values(files.remapped(marks, places), "target_tile_id", "record_index") == [(2, 9)]


def test_exports(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    for r in files.chatml(turns).collect():
        told = turns.filter(F.col("conv_id") == r.conv_id).orderBy("turn").limit(3).collect() if r.conv_id < 3 else None
        body = json.loads(r.json)
        assert told is None or [m["content"] for m in body["messages"][:3]] == [t.text for t in told]
    assert files.iceberg_schema(turns, "t")["schema"]["fields"][0] == {"id": 1, "name": "conv_id", "required": False, "type": "long"}
    assert evidence.bibtex(spark.createDataFrame([(1, "10.1/x", "h")], "paper_id long, doi string, content_sha256 string")).first().entry.startswith("@article{p1,")
    marks = evidence.recheck_marks(spark.createDataFrame([(1, "changed"), (2, "unchanged")], "paper_id long, status string"))
    assert values(marks, "record_index") == [(1,)]


def test_streams_resume(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 3).cast("string").alias("session"), F.lit(1).cast("long").alias("delta_seq")).limit(1)
    rows.withColumn("delta_seq", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 2, 4))))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: ingest.in_sequence(ingest.source(spark, str(tmp_path / "in"), rows.schema))
    for n in (1, 2):
        ingest.run(stream(), ingest.to_parquet(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out/batch=*"))
        assert sorted((r.delta_seq, r.outcome) for r in found.collect()) == ([(1, "applied"), (2, "applied"), (2, "replay"), (4, "gap")] if n == 1 else [(1, "applied"), (2, "applied"), (2, "replay"), (3, "applied"), (4, "applied"), (4, "gap")])
        if n == 1:
            rows.withColumn("delta_seq", F.explode(F.array(F.lit(3).cast("long"), F.lit(4).cast("long")))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_streams_mixed_arrival(spark, tmp_path):
    """More rows of a session than an Arrow batch holds, in any order, in one micro-batch and in several."""
    rows = spark.range(1, 60_001).select(F.lit("s").alias("session"), F.col("id").alias("delta_seq"), F.col("id").alias("seq"), F.lit("p").alias("payload"), F.lit("d").alias("device"))
    rows.repartition(3, F.xxhash64("seq")).sortWithinPartitions(F.xxhash64("seq")).write.parquet(str(tmp_path / "in"))
    for name, files_per_batch in (("one", 16), ("several", 1)):
        stream = ingest.in_sequence(ingest.source(spark, str(tmp_path / "in"), rows.schema, files_per_batch), hold=True)
        ingest.run(stream, ingest.to_parquet(str(tmp_path / name)), str(tmp_path / f"state_{name}")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / name / "batch=*"))
        assert found.groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("delta_seq").alias("d")).collect() == [("applied", 60_000, 60_000)]
    ingest.run(ingest.sealed(ingest.source(spark, str(tmp_path / "in"), rows.schema)), ingest.to_parquet(str(tmp_path / "seals")), str(tmp_path / "state_seals")).awaitTermination()
    seals = {r.seq: (r.prev_seal, r.seal) for r in spark.read.parquet(str(tmp_path / "seals/batch=*")).collect()}
    assert len(seals) == 60_000 and seals[1][0] == "" and all(seals[i + 1][0] == seals[i][1] for i in range(1, 60_000))


def test_long_chains(spark):
    """A chain of 10,000 first parents, and cycles, in a logarithm of rounds."""
    commits = spark.range(10_000).select(F.col("id").cast("string").alias("seal"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array()).alias("parents"), F.col("id").alias("seq"))
    found = graph.log(commits)
    assert found.agg(F.count("*"), F.count_if(F.col("depth") + F.col("node").cast("int") == 9999)).first() == (10_000, 10_000)
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "src string, dst string")
    assert sorted(map(tuple, graph.chain(ring, "a").collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_stream_hulls_and_sessions(spark, sf):
    box = ingest.hulls(spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 4.0, -1.0, 2.0)], "robot_id long, px double, py double, pz double")).first()
    assert (box.min_px, box.max_px, box.min_py, box.n) == (0.0, 4.0, -1.0, 2)
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00")], "sensor_id long, t string").select("sensor_id", F.to_timestamp("t").alias("ts"))
    assert values(ingest.sessions(events), "n") == [(1,), (2,)]
