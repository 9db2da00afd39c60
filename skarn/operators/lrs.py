"""Learning records: statement queries, voiding, storing, projections, lookups, documents, sync and purges.

Statements are a table (id, stored_ms, actor, verb, object_id, registration, voids, raw_json, seq, ...); ``voids`` is
the id of the statement that one voids, or null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as T

PAGE = 50
DAY_MS = 86_400_000


def actor_identity(actor_json: str | Column) -> Column:
    """First of mbox, mbox_sha1sum, openid and account (homePage and name) in an actor object."""
    get = lambda p: F.get_json_object(actor_json, p)
    account = F.concat(get("$.account.homePage"), F.lit("\0"), get("$.account.name"))
    return F.coalesce(get("$.mbox"), get("$.mbox_sha1sum"), get("$.openid"), account)


def parsed(raw: DataFrame) -> DataFrame:
    """Columns of statements from (raw_json, stored_ms, seq)."""
    get = lambda p: F.get_json_object("raw_json", p)
    return raw.select(
        F.lower(get("$.id")).alias("id"),
        "stored_ms",
        actor_identity(get("$.actor")).alias("actor"),
        get("$.verb.id").alias("verb"),
        get("$.object.id").alias("object_id"),
        F.coalesce(get("$.object.objectType"), F.lit("Activity")).alias("object_type"),
        get("$.context.registration").alias("registration"),
        F.when(F.endswith(get("$.verb.id"), F.lit("/voided")), F.lower(get("$.object.id"))).alias("voids"),
        get("$.result.success").cast("boolean").alias("success"),
        get("$.result.score.scaled").cast("double").alias("scaled"),
        "raw_json",
        "seq",
    )


def violations(raw: DataFrame) -> DataFrame:
    """(seq, why) of statements that break a rule: missing parts, malformed ids, IRIs, durations, scores or times."""
    get = lambda p: F.get_json_object("raw_json", p)
    bad = lambda value, ok, why: F.when(value.isNotNull() & ~ok, why)
    scaled = get("$.result.score.scaled")
    why = F.coalesce(
        F.when(get("$.actor").isNull(), "actor is missing"),
        F.when(get("$.verb").isNull(), "verb is missing"),
        F.when(get("$.object").isNull(), "object is missing"),
        F.when((get("$.actor.objectType").isNull() | (get("$.actor.objectType") == "Agent")) & actor_identity(get("$.actor")).isNull(), "agent has no identifier"),
        bad(get("$.id"), T.is_uuid(get("$.id")), "id is no UUID"),
        F.when(get("$.verb.id").isNull() | ~T.is_iri(get("$.verb.id")), "verb id is no IRI"),
        F.when(F.coalesce(get("$.object.objectType"), F.lit("Activity")).isin("Activity") & ~F.coalesce(T.is_iri(get("$.object.id")), F.lit(False)), "activity id is no IRI"),
        F.when((get("$.object.objectType") == "StatementRef") & ~F.coalesce(T.is_uuid(get("$.object.id")), F.lit(False)), "reference is no UUID"),
        bad(get("$.context.registration"), T.is_uuid(get("$.context.registration")), "registration is no UUID"),
        bad(get("$.context.language"), T.is_language_tag(get("$.context.language")), "language is no tag"),
        bad(get("$.result.duration"), T.is_duration(get("$.result.duration")), "duration is malformed"),
        bad(scaled, scaled.try_cast("double").between(-1, 1), "scaled score is out of range"),
        bad(get("$.timestamp"), F.try_to_timestamp(get("$.timestamp")).isNotNull(), "timestamp is malformed"),
    )
    return raw.select("seq", why.alias("why")).filter("why is not null")


def stored(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``outcome``: stored, duplicate (same body), conflict (other body), or a voiding rule broken.

    A statement id counts once, its first body in order of ``seq``; a voiding statement must not be voided.
    """
    both = existing.select("id", "raw_json", "seq", F.lit(0).alias("new")).unionByName(incoming.select("id", "raw_json", "seq", F.lit(1).alias("new")))
    first = both.groupBy("id").agg(F.min(F.struct("new", "seq", F.sha2("raw_json", 256).alias("h"))).alias("f"))
    voiding = existing.unionByName(incoming, allowMissingColumns=True).filter("voids is not null").select(F.col("id").alias("voids")).distinct().withColumn("_void", F.lit(True))
    rows = incoming.join(first, "id").join(voiding, "voids", "left")
    outcome = F.when(F.col("_void"), "voids_a_voiding_statement").when((F.col("f.new") == 1) & (F.col("f.seq") == F.col("seq")), "stored").when(F.col("f.h") == F.sha2("raw_json", 256), "duplicate").otherwise("conflict")
    return rows.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def _matches(statements: DataFrame, actor: str | None, verb: str | None, activity: str | None, registration: str | None, since: int | None, until: int | None, related: bool) -> Column:
    test = F.lit(True)
    if actor is not None:
        own = F.col("actor") == actor
        test = test & (own | F.coalesce(F.array_contains("related_agents", actor), F.lit(False)) if related and "related_agents" in statements.columns else own)
    if verb is not None:
        test = test & (F.col("verb") == verb)
    if activity is not None:
        own = F.col("object_id") == activity
        test = test & (own | F.coalesce(F.array_contains("related_activities", activity), F.lit(False)) if related and "related_activities" in statements.columns else own)
    if registration is not None:
        test = test & (F.col("registration") == registration)
    if since is not None:
        test = test & (F.col("stored_ms") > since)
    if until is not None:
        test = test & (F.col("stored_ms") <= until)
    return test


def matching(statements: DataFrame, actor: str | None = None, verb: str | None = None, activity: str | None = None, registration: str | None = None, since: int | None = None, until: int | None = None, related: bool = False, hidden: DataFrame | None = None) -> DataFrame:
    """Statements that match, later than ``since`` and not later than ``until``.

    Voided statements don't show, but one that matches shows the statement that voids it. ``hidden`` (id) is left out.
    """
    test = _matches(statements, actor, verb, activity, registration, since, until, related)
    voided = statements.filter("voids is not null").select(F.col("voids").alias("id"))
    plain = statements.filter(test).join(voided, "id", "left_anti")
    gone = statements.filter(test).join(voided, "id", "left_semi").select(F.col("id").alias("voids"))
    voiding = statements.join(gone, "voids", "left_semi").select(*statements.columns)
    found = plain.select(*statements.columns).unionByName(voiding).dropDuplicates(["id"])
    return found if hidden is None else found.join(hidden.select("id"), "id", "left_anti").select(*statements.columns)


def page(found: DataFrame, ascending: bool = False, limit: int = 0, offset: int = 0) -> tuple[DataFrame, str | None]:
    """One page by time of storing, and the token of the next one; a limit of 0 is ``PAGE``."""
    limit = limit or PAGE
    order = [F.asc("stored_ms"), F.asc("seq")] if ascending else [F.desc("stored_ms"), F.desc("seq")]
    more = f"offset={offset + limit}" if found.count() > offset + limit else None
    return found.orderBy(*order).offset(offset).limit(limit), more


#: By verb suffix, the event that a statement tells of (status), in order.
EVENTS = (("/passed", "passed"), ("/failed", "failed"), ("/satisfied", "satisfied"), ("/attempted", "attempted"), ("/registered", "registered"), ("/scheduled", "scheduled"), ("/verbs/reviewed", "completed"), ("/verbs/approved", "passed"), ("/verbs/rejected", "failed"), ("/requested-human-review", "attempted"), ("/cito/cites", "completed"))
#: Goals by verb suffix: type, status, and whether a target date of 30 days is set.
GOALS = (("/assigned", "assigned", "active"), ("/pursued", "self", "active"), ("/chose", "self", "active"), ("/planned", "self", "active"), ("/recommended", "recommended", "active"), ("/abandoned", "self", "removed"), ("/dismissed", "self", "removed"), ("/removed", "self", "removed"))


def _ends(suffix: str) -> Column:
    return F.endswith("verb", F.lit(suffix))


def persons(statements: DataFrame) -> DataFrame:
    who = F.coalesce("actor", F.lit("anonymous"))
    return statements.select(T.identity("person", who).alias("person_id"), who.alias("identifier")).distinct()


def resources(statements: DataFrame) -> DataFrame:
    """The last statement's view of each activity."""
    rows = statements.filter("object_type = 'Activity' and object_id is not null")
    return rows.groupBy("object_id").agg(F.max("seq").alias("seq")).select(T.identity("resource", F.col("object_id")).alias("resource_id"), "object_id", "seq")


def events(statements: DataFrame) -> DataFrame:
    """One event for each statement whose verb tells of one: an event never replaces another."""
    status = F.when(_ends("/completed"), F.when(F.col("success"), "passed").when(~F.col("success"), "failed").otherwise("completed"))
    for suffix, name in EVENTS:
        status = status.when(_ends(suffix), name)
    return statements.withColumn("status", status).filter("status is not null").select(T.identity("event", F.col("actor"), F.col("object_id"), F.col("id")).alias("event_id"), "actor", "object_id", "status", F.col("stored_ms").alias("at_ms"))


def competencies(statements: DataFrame) -> DataFrame:
    """By person and object, the last statement that tells of a competency: status and confidence."""
    status = F.when(_ends("/mastered") | _ends("/achieved"), "passed").when(_ends("/waived"), "satisfied").when(_ends("/verbs/reviewed"), "completed").when(_ends("/flagged-hallucination") | _ends("/ta-approved-draft"), "passed")
    rows = statements.withColumn("status", status).filter("status is not null")
    confidence = F.when(_ends("/waived"), 1.0).otherwise(F.coalesce("scaled", F.lit(1.0)))
    last = rows.withColumn("confidence", confidence).groupBy("actor", "object_id").agg(F.max_by(F.struct("status", "confidence", F.col("stored_ms").alias("at_ms")), "seq").alias("c"))
    return last.select(T.identity("competency", F.col("actor"), F.col("object_id")).alias("competency_id"), "actor", "object_id", "c.*")


def credentials(statements: DataFrame) -> DataFrame:
    rows = statements.filter(_ends("/earned") | _ends("/conferred"))
    last = rows.groupBy("actor", "object_id").agg(F.max_by(F.struct(F.col("stored_ms").alias("at_ms")), "seq").alias("c"))
    return last.select(T.identity("credential", F.col("actor"), F.col("object_id")).alias("credential_id"), "actor", "object_id", "c.*")


def goals(statements: DataFrame) -> DataFrame:
    """By person and object, the last statement of a goal: type, status, and a target date 30 days on while active.

    Only where the object is a goal, or its id or the verb mentions one, or the verb is one that makes goals.
    """
    entered = (F.col("object_type") == "Goal") | F.contains(F.lower("object_id"), F.lit("goal")) | F.contains(F.lower("verb"), F.lit("goal"))
    for suffix in ("assigned", "pursued", "chose", "planned", "dismissed"):
        entered = entered | F.endswith("verb", F.lit(suffix))
    kind, status = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for suffix, k, s in GOALS:
        kind, status = kind.when(_ends(suffix), k), status.when(_ends(suffix), s)
    rows = statements.filter(entered).withColumns({"kind": kind, "status": status}).filter("kind is not null")
    target = F.when(F.col("status") == "active", F.col("stored_ms") + 30 * DAY_MS).otherwise(0)
    last = rows.groupBy("actor", "object_id").agg(F.max_by(F.struct("kind", "status", target.alias("target_ms")), "seq").alias("g"))
    return last.select(T.identity("goal", F.col("actor"), F.col("object_id")).alias("goal_id"), "actor", "object_id", "g.*")


def projections(statements: DataFrame) -> dict[str, DataFrame]:
    """All projections; recomputing them from the statements is the rebuild, so replay and live are the same."""
    return {"person": persons(statements), "resource": resources(statements), "event": events(statements), "competency": competencies(statements), "credential": credentials(statements), "goal": goals(statements)}


def of_person(projection: DataFrame, actor: str | None = None, withdrawn: DataFrame | None = None, include_hidden: bool = False) -> DataFrame:
    """A projection's rows, of one person, without persons who withdrew (``actor``)."""
    found = projection if actor is None else projection.filter(F.col("actor") == actor)
    return found if include_hidden or withdrawn is None else found.join(withdrawn.select("actor").distinct(), "actor", "left_anti")


def registration_export(statements: DataFrame, registration: str, limit: int = 10_000) -> DataFrame:
    """The statements of a registration, oldest first, at most ``limit`` of them."""
    return statements.filter(F.col("registration") == registration).orderBy("stored_ms", "seq").limit(limit).select("seq", "raw_json")


def _merge(into: dict, more: dict) -> dict:
    for k, v in more.items():
        into[k] = _merge(into[k], v) if isinstance(v, dict) and isinstance(into.get(k), dict) else v
    return into


def activities(mentions: DataFrame) -> DataFrame:
    """(object_id, definition): definitions of an activity, merged deeply in order of ``seq``.

    Equal definitions are one row before they are gathered, so a popular activity costs its distinct definitions. Rows
    come sorted to a task, which keeps one definition at a time.
    """
    rows = mentions.filter("definition is not null").groupBy("object_id", "definition").agg(F.max("seq").alias("seq"))
    rows = rows.repartition("object_id").sortWithinPartitions("object_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for pdf in batches:
            done = []
            for name, text in zip(pdf["object_id"], pdf["definition"], strict=True):
                if name != now:
                    if now is not None:
                        done.append((now, json.dumps(held, sort_keys=True)))
                    now, held = name, {}
                _merge(held, json.loads(text))
            yield pd.DataFrame(done, columns=["object_id", "definition"])
        if now is not None:
            yield pd.DataFrame([(now, json.dumps(held, sort_keys=True))], columns=["object_id", "definition"])

    return rows.mapInPandas(run, "object_id string, definition string")


def person_object(agent_json: str | Column) -> Column:
    """A person of one agent: its names and identifiers as lists, as JSON."""
    get = lambda p: F.get_json_object(agent_json, p)
    many = lambda p: F.when(get(p).isNotNull(), F.array(get(p)))
    account = F.when(get("$.account").isNotNull(), F.array(F.struct(get("$.account.homePage").alias("homePage"), get("$.account.name").alias("name"))))
    return F.to_json(F.struct(F.lit("Person").alias("objectType"), many("$.name").alias("name"), many("$.mbox").alias("mbox"), many("$.mbox_sha1sum").alias("mbox_sha1sum"), many("$.openid").alias("openid"), account.alias("account")))


#: Numbers, labels and permission bits of the scholar profile's verbs; other last parts of their IRIs.
VERBS = (
    (0x00E1, "ta-approved-draft", 0),
    (0x00E2, "ta-provided-analogy", 1),
    (0x00E3, "ta-redirected", 2),
    (0x00E4, "ta-escalated", 3),
    (1, "experienced", 4),
    (2, "reviewed", 5),
    (3, "approved", 6),
    (4, "rejected", 7),
    (5, "requested-human-review", 8),
    (6, "flagged-hallucination", 9),
    (7, "cited", 10),
    (8, "imported", 11),
    (9, "exported-snapshot", 12),
    (10, "searched", 13),
    (11, "opened", 14),
    (12, "viewed", 15),
    (13, "saved", 16),
    (14, "removed", 17),
    (15, "created", 18),
    (16, "edited", 19),
    (17, "asked", 20),
    (18, "ai-answered", 21),
    (19, "accepted", 22),
    (20, "logged-out", 23),
    (21, "consent-declined", 24),
    (22, "flagged-discrepancy", 25),
    (23, "verified-claim", 26),
)
#: Public IRIs of other vocabularies that stand for registered verbs.
VERB_IRIS = {
    "http://adlnet.gov/expapi/verbs/experienced": "experienced",
    "http://adlnet.gov/expapi/verbs/asked": "asked",
    "http://adlnet.gov/expapi/verbs/logged-out": "logged-out",
    "http://purl.org/spar/cito/cites": "cited",
    "http://activitystrea.ms/schema/1.0/create": "created",
    "http://activitystrea.ms/schema/1.0/search": "searched",
    "http://activitystrea.ms/schema/1.0/open": "opened",
    "http://activitystrea.ms/schema/1.0/save": "saved",
    "http://activitystrea.ms/schema/1.0/remove": "removed",
    "http://activitystrea.ms/schema/1.0/accept": "accepted",
    "http://id.tincanapi.com/verb/viewed": "viewed",
}
#: Where a deployment keeps its own verbs: their IRIs are this and the label.
VERB_BASE = "http://example.org/verbs/"


def verb_label(iri: str | Column, base: str = VERB_BASE) -> Column:
    """The label that a whole IRI stands for: a registered verb under ``base``, or a listed one; else null."""
    whole = F.col(iri) if isinstance(iri, str) else iri
    label = F.lit(None).cast("string")
    for other, name in [*VERB_IRIS.items(), *((base + name, name) for _, name, _ in VERBS)]:
        label = F.when(whole == other, name).otherwise(label)
    return label


def with_verb_labels(statements: DataFrame, base: str = VERB_BASE) -> DataFrame:
    """``statements`` with label, number and permission bit of registered verbs; the registry is a fixed small table."""
    table = statements.sparkSession.createDataFrame(list(VERBS), "verb_id int, verb_label string, verb_bit int")
    return statements.withColumn("verb_label", verb_label("verb", base)).join(F.broadcast(table), "verb_label", "left")


def profile_violations(raw: DataFrame, base: str = VERB_BASE) -> DataFrame:
    """(seq, why) of statements of registered verbs that break the scholar profile.

    An activity must have an IRI; approvals must say whether they succeeded; a citation must name what it cites.
    """
    get = lambda p: F.get_json_object("raw_json", p)
    label = verb_label(get("$.verb.id"), base)
    activity = F.coalesce(get("$.object.objectType"), F.lit("Activity")) == "Activity"
    why = F.coalesce(
        F.when(get("$.object").isNull(), "object is missing"),
        F.when(activity & ~F.coalesce(T.is_iri(get("$.object.id")), F.lit(False)), "activity id is no IRI"),
        F.when(label.isin("approved", "ta-approved-draft") & ~F.coalesce(get("$.result.success").isin("true", "false"), F.lit(False)), "success is missing"),
        F.when((label == "cited") & get("$.object.id").isNull(), "cited work is missing"),
    )
    return raw.filter(label.isin(*(v[1] for v in VERBS))).select("seq", why.alias("why")).filter("why is not null")


def document_ids(documents: DataFrame, kind: int, prefix: str = "", since_ms: int | None = None) -> DataFrame:
    """Keys of a kind that begin with ``prefix`` and changed after ``since_ms``."""
    last = documents.groupBy("doc_kind", "key").agg(F.max_by(F.struct("timestamp_ms", "deleted"), "seq").alias("d"))
    found = last.filter((F.col("doc_kind") == kind) & F.startswith("key", F.lit(prefix)) & ~F.col("d.deleted"))
    return (found if since_ms is None else found.filter(F.col("d.timestamp_ms") > since_ms)).select("key").orderBy("key")


def put_outcomes(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (doc_kind, key, content, is_json, if_match, if_none_match, merge) with ``outcome`` and ``result``.

    An ETag is the SHA-1 of the content. A plain PUT without a header conflicts with a document that is there, and is
    invalid for profiles (kinds 3 and 4) even where none is. POST merges top-level keys of JSON objects, the new ones
    winning.
    """
    last = existing.groupBy("doc_kind", "key").agg(F.max_by(F.struct(F.col("content").alias("old"), F.col("is_json").alias("old_json")), "seq").alias("d")).select("doc_kind", "key", "d.*")
    clean = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    tag = F.sha1("old")
    here = F.col("old").isNotNull()
    rows = requests.join(last, ["doc_kind", "key"], "left")
    as_map = lambda c: F.from_json(c, "map<string,string>")
    old_map, new_map = as_map("old"), as_map("content")
    union = F.map_concat(F.map_filter(old_map, lambda k, v: ~F.map_contains_key(new_map, k)), new_map)
    outcome = (
        F.when(~F.col("merge") & F.col("if_match").isNull() & F.col("if_none_match").isNull() & here, "conflict")
        .when(~F.col("merge") & F.col("if_match").isNull() & F.col("if_none_match").isNull() & F.col("doc_kind").isin(3, 4), "invalid")
        .when(F.col("if_match").isNotNull() & (~here | ((clean(F.col("if_match")) != tag) & (clean(F.col("if_match")) != "*"))), "precondition_failed")
        .when(F.col("if_none_match").isNotNull() & here & ((clean(F.col("if_none_match")) == tag) | (clean(F.col("if_none_match")) == "*")), "precondition_failed")
        .when(F.col("merge") & here & ((F.col("old_json") != F.col("is_json")) | (F.col("is_json") & (old_map.isNull() | new_map.isNull()))), "invalid")
        .otherwise("stored")
    )
    merged = F.when(F.col("merge") & here & F.col("is_json"), F.to_json(union)).otherwise(F.col("content"))
    return rows.withColumn("outcome", outcome).withColumn("result", F.when(F.col("outcome") == "stored", merged)).select(*requests.columns, "outcome", "result")


def purge(statements: DataFrame, ids: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements without those to purge (ids that are not held), and a receipt for each one purged."""
    gone = ids.select("id").distinct().join(held.select("id"), "id", "left_anti")
    receipts = statements.join(gone, "id", "left_semi").select(T.identity("receipt", F.col("id")).alias("receipt_id"), F.col("id").alias("purged_id"), F.sha2("raw_json", 256).alias("purged_hash"))
    return statements.join(gone, "id", "left_anti"), receipts


def retention_ids(statements: DataFrame, now_ms: int, days: int) -> DataFrame:
    return statements.filter(F.col("stored_ms") < now_ms - days * DAY_MS).select("id")


def account_ids(statements: DataFrame, name: str, home_page: str | None = None) -> DataFrame:
    """Statements of an actor's account by its name, and home page where given."""
    test = F.endswith("actor", F.lit("\0" + name)) if home_page is None else F.col("actor") == home_page + "\0" + name
    return statements.filter(test).select("id")


def synced(applied: DataFrame, batches: DataFrame) -> DataFrame:
    """``batches`` (session, batch_seq, checksum, payload) with an outcome, against the last applied one of a session.

    A past number is a duplicate, the next one is applied, a later one is a gap, and a wrong checksum is corrupt.
    """
    last = applied.groupBy("session").agg(F.max("batch_seq").alias("_last"))
    rows = batches.join(last, "session", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    outcome = F.when(F.col("checksum") != F.sha2("payload", 256), "corrupt").when(F.col("batch_seq") <= F.col("_last"), "duplicate").when(F.col("batch_seq") == F.col("_last") + 1, "applied").otherwise("gap")
    return rows.withColumn("outcome", outcome).drop("_last")
