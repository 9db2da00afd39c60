"""Rule-based cleaning with provenance: categories, rules, checks, a review queue, and an intake log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as default_of
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as T


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """``op``: trim, uppercase, lowercase, map (with ``values``) or date_iso (with ``layouts``); no field: all fields."""

    id: str
    op: str
    field: str | None = None
    version: int = 1
    values: dict[str, str] = default_of(default_factory=dict)
    layouts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    name: str
    extensions: tuple[str, ...]
    prefix: str | None
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...] = ()

    def covers(self, file_name: Column) -> Column:
        low = F.lower(file_name)
        test = F.element_at(F.split(low, "\\."), -1).isin(*(e.lower() for e in self.extensions)) & F.contains(low, F.lit("."))
        return test & F.startswith(low, F.lit(self.prefix.lower())) if self.prefix else test


def categorised(files: DataFrame, categories: list[Category]) -> DataFrame:
    """``files`` (file_name, ...) with category, tag and mark: none covers: unclassified; more than one: needs a rule."""
    found = F.array_compact(F.array(*(F.when(c.covers(F.col("file_name")), c.name) for c in categories)))
    rows = files.withColumn("_found", found)
    n = F.size("_found")
    return rows.withColumns({"category": F.when(n == 1, F.try_element_at("_found", F.lit(1))), "tag": F.when(n == 0, "unclassified").when(n > 1, "needs_rule"), "mark": F.when(n == 0, 2).when(n > 1, 1)}).drop("_found")


def bad_headers(files: DataFrame, category: Category) -> DataFrame:
    """(file_name, unknown): files whose header (array) has names that the category lacks."""
    known = F.array(*(F.lit(f.name) for f in category.fields))
    return files.select("file_name", F.array_except("header", known).alias("unknown")).filter(F.size("unknown") > 0)


def _applied(rule: Rule, value: Column) -> tuple[Column, Column]:
    """New value, and why the rule fails (null: it does not)."""
    none = F.lit(None).cast("string")
    if rule.op == "trim":
        return F.trim(value), none
    if rule.op == "uppercase":
        return F.upper(value), none
    if rule.op == "lowercase":
        return F.lower(value), none
    if rule.op == "map":
        table = F.create_map(*(F.lit(x) for kv in rule.values.items() for x in kv))
        return table[value], F.when(table[value].isNull(), F.concat(F.lit("no mapping for '"), value, F.lit("'")))
    date = T.iso_date(value, list(rule.layouts))
    return date, F.when(date.isNull(), F.concat(F.lit("no single date in '"), value, F.lit("'")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


CHANGE = "array<struct<field:string,before:string,after:string,rule_id:string,rule_version:int>>"


def cleaned(rows: DataFrame, category: Category, approver: str) -> dict[str, DataFrame]:
    """``records``, ``changes`` and ``review`` of ``rows`` (source, row, and a string column for each field).

    Rules run in order over each row; each that changes a value adds a change. The first rule or check that fails sends
    the whole row to review, and its changes are dropped. A row's state is a struct that each step binds once and makes
    anew, so the plan grows with the number of rules and everything is one projection: nothing shuffles.
    """
    names = [f.name for f in category.fields if f.name in rows.columns]

    def state(get: Callable[[str], Column], changes: Column, bad: Column, why: Column) -> Column:
        return F.struct(*(get(n).alias(n) for n in names), changes.alias("_changes"), bad.alias("_bad"), why.alias("_why"))

    def apply(rule: Rule, name: str) -> Callable[[Column], Column]:
        def step(now: Column) -> Column:
            def use(made: Column) -> Column:
                edit = made["new"].isNotNull() & (made["new"] != now[name])
                change = F.struct(F.lit(name).alias("field"), now[name].alias("before"), made["new"].alias("after"), F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"))
                failed = made["fail"].isNotNull()
                return state(
                    lambda n: F.when(edit, made["new"]).otherwise(now[n]) if n == name else now[n],
                    F.when(edit, F.concat(now["_changes"], F.array(change))).otherwise(now["_changes"]),
                    F.when(failed, F.lit(name)).otherwise(now["_bad"]),
                    F.when(failed, F.concat(F.lit(f"rule {rule.id} v{rule.version}: "), made["fail"])).otherwise(now["_why"]),
                )

            new, why = _applied(rule, now[name])
            going = now["_why"].isNull() & now[name].isNotNull()
            return _let(F.struct(F.when(going, new).alias("new"), F.when(going, why).alias("fail")), use)

        return step

    def check(f: Field) -> Callable[[Column], Column]:
        def step(now: Column) -> Column:
            value = F.coalesce(now[f.name], F.lit("")) if f.name in names else F.lit("")
            why = F.when(value == "", F.lit("required field is empty") if f.required else F.lit(None)).when(~T.is_type(f.type, value), F.concat(F.lit("'"), value, F.lit(f"' is not a valid {f.type}")))
            if f.allowed:
                why = why.when(~value.isin(*f.allowed), F.concat(F.lit("'"), value, F.lit("' is not an allowed value")))
            failed = lambda w: now["_why"].isNull() & w.isNotNull()
            return _let(why, lambda w: state(lambda n: now[n], now["_changes"], F.when(failed(w), F.lit(f.name)).otherwise(now["_bad"]), F.when(failed(w), w).otherwise(now["_why"])))

        return step

    now = state(F.col, F.array().cast(CHANGE), F.lit(None).cast("string"), F.lit(None).cast("string"))
    for rule in category.rules:
        for name in [rule.field] if rule.field else names:
            if name in names:
                now = _let(now, apply(rule, name))
    for f in category.fields:
        now = _let(now, check(f))
    out = rows.select("source", "row", now.alias("_now")).select("source", "row", "_now.*")
    good = out.filter("_why is null")
    return {
        "records": good.select("source", "row", *names, F.lit(category.name).alias("category")),
        "changes": good.select("source", "row", F.inline("_changes")).withColumn("approved_by", F.lit(approver)),
        "review": out.filter("_why is not null").select("source", "row", F.lit("needs_rule").alias("tag"), F.lit(1).alias("mark"), F.col("_bad").alias("field"), F.col("_why").alias("reason")),
    }


def body_hash(parts: dict[str, DataFrame]) -> str:
    """One hash of records, changes and queue, whatever the order of their rows."""
    sums = [df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first() for _, df in sorted(parts.items())]
    return "-".join(f"{n}:{h & (1 << 64) - 1:016x}" for n, h in sums)


def intake(log: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals (sha256, connector, seq) that the log does not have, once each."""
    first = arrivals.groupBy("sha256", "connector").agg(F.min_by(F.struct(*[c for c in arrivals.columns if c not in ("sha256", "connector")]), "seq").alias("a")).select("sha256", "connector", "a.*")
    return first.join(log.select("sha256", "connector").distinct(), ["sha256", "connector"], "left_anti")


def orphans(blobs: DataFrame, *logs: DataFrame) -> DataFrame:
    """Blobs (sha256) that no log names."""
    return reduce(lambda b, log: b.join(log.select("sha256").distinct(), "sha256", "left_anti"), logs, blobs)
