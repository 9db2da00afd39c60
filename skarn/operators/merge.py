"""Deterministic merges, run metrics, budgets, reports, standings and bills of materials."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.tables import cut

#: Record types and name parts whose conflicts people judge; prices of actions, and the daily budget.
HUMAN_TYPES = (11, 13, 20, 32)
HUMAN_NAMES = "claim|evidence|citation_fingerprint|ai_trace"
RATES = {"free": 0.0, "llm": 0.000002, "sandbox": 0.0001, "browser": 0.0002, "r2": 0.00005}
DAILY_CAP, WARNING = 1.0, 0.8


def needs_human(tile_type: str = "tile_type", type_name: str = "type_name", record_id: str = "record_id") -> Column:
    """Whether people must judge a conflict over a record of this type, name or id."""
    return F.col(tile_type).isin(*HUMAN_TYPES) | F.col(type_name).rlike(HUMAN_NAMES) | F.col(record_id).rlike("^(claim|evidence)_")


def merged(entries: DataFrame) -> DataFrame:
    """One row for each record: the entry that stays after all, in order of ``seq``, and the last rule that applied.

    An equal payload changes nothing, not even the time; then a conflict that people must judge leaves the entry as it
    is; then the newer time wins, and of equal times the larger signature. Because an equal payload keeps the older
    time, what an entry does depends on all before it: this is a fold, no maximum. Rows come sorted to a task by record
    and ``seq``; the task keeps one entry at a time, however many a record has.
    """
    names = ["record_id", "payload_hash", "committed_timestamp", "commit_signature", "human"]
    rows = entries.withColumn("human", needs_human()).select("seq", *names)
    rows = rows.repartition("record_id").sortWithinPartitions("record_id", "seq").select(*names)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names[:4], "rule", "queued", "n_entries"]
        record, now = None, []
        for pdf in batches:
            done = []
            for name, payload, ts, sig, human in pdf.itertuples(index=False):
                if name != record:
                    if record is not None:
                        done.append((record, *now[:3], *now[4:]))
                    record, now = name, [payload, ts, sig, human, "first", 0, 1]
                    continue
                now[6] += 1
                if payload == now[0]:
                    now[4] = "idempotent_identical_content"
                elif human or now[3]:
                    now[4], now[5] = "needs_human", now[5] + 1
                elif (ts, sig) > (now[1], now[2]):
                    now[:5] = payload, ts, sig, human, "timestamp_lww" if ts > now[1] else "signature_tie_break"
                else:
                    now[4] = "timestamp_lww_existing_newer" if ts < now[1] else "signature_tie_break_existing_won"
            yield pd.DataFrame(done, columns=columns)
        if record is not None:
            yield pd.DataFrame([(record, *now[:3], *now[4:])], columns=columns)

    return rows.mapInPandas(fold, "record_id string, payload_hash string, committed_timestamp long, commit_signature string, rule string, queued long, n_entries long")


def latency_metrics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, and the values at places floor(n / 2) and floor(0.99 n) of the sorted ones (no interpolation), in thousandths.

    Equal values are counted first, so what a window sorts is the distinct values of a group.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    places = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    return places.groupBy(*by).agg(F.max("n").alias("n"), (at(0.5) / 1000).alias("p50_ms"), (at(0.99) / 1000).alias("p99_ms"))


def budget(actions: DataFrame, cap: float = DAILY_CAP, rates: dict[str, float] = RATES) -> DataFrame:
    """Actions (ledger, ts, seq, kind, units) with cost, whether each was executed or deferred, and the day's spending.

    Within a ledger's UTC day, paid actions run in order while they fit under the cap; one that does not fit is
    deferred and adds nothing, so a later, cheaper one may still run. That makes a day sequential: rows come sorted to
    a task by (ledger, day), and the task keeps one number for the day it is in. Free actions always run.
    """
    prices = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))
    rows = actions.withColumns({"day": F.floor(F.col("ts") / 86400), "cost": F.coalesce(prices[F.col("kind")], F.lit(0.0)) * F.col("units")})
    rows = rows.repartition("ledger", "day").sortWithinPartitions("ledger", "day", "ts", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, spent = None, 0.0
        for pdf in batches:
            status, total = [], []
            for ledger, day, kind, cost in zip(pdf["ledger"], pdf["day"], pdf["kind"], pdf["cost"], strict=True):
                if (ledger, day) != now:
                    now, spent = (ledger, day), 0.0
                fits = kind == "free" or spent + cost <= cap
                spent += cost if fits and kind != "free" else 0.0
                status.append("executed" if fits else "deferred")
                total.append(spent)
            yield pdf.assign(status=status, spent=total)

    schema = rows.schema.simpleString()[7:-1]
    return rows.mapInPandas(run, f"{schema},status:string,spent:double".replace(":", " "))


def budget_status(ledger: DataFrame, cap: float = DAILY_CAP) -> DataFrame:
    """Per ledger and day: spending, its share of the cap in percent, whether the warning level or the cap is reached."""
    days = ledger.groupBy("ledger", "day").agg(F.max("spent").alias("spent"), F.count_if(F.col("status") == "deferred").alias("n_deferred"))
    share = F.col("spent") / cap * 100
    return days.select("ledger", "day", F.round("spent", 4).alias("spent"), F.round(share, 1).alias("pct_spent"), (share >= WARNING * 100).alias("warning"), (F.col("spent") >= cap).alias("cap_reached"), "n_deferred")


def run_report(entries: DataFrame) -> DataFrame:
    """Runs with the number of amendments since their plan was last set, and whether that differs from its first run's.

    ``entries`` (plan_id, seq, kind: plan, amendment or run; hash; outcome). Amendments before any plan don't count.
    """
    order = Window.partitionBy("plan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plans = entries.withColumn("epoch", F.count_if(F.col("kind") == "plan").over(order))
    part = Window.partitionBy("plan_id", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("epoch") > 0
    marked = plans.withColumns({"plan_version": F.when(known, F.count_if(F.col("kind") == "amendment").over(part)).otherwise(0), "plan_hash": F.when(known, F.last(F.when(F.col("kind") != "run", F.col("hash")), ignorenulls=True).over(part)).otherwise("")})
    runs = marked.filter("kind = 'run'")
    first = F.first("plan_version").over(Window.partitionBy("plan_id").orderBy("seq"))
    return runs.select("plan_id", F.col("seq").alias("run_seq"), "plan_version", "plan_hash", (F.col("plan_version") != first).alias("switched"), "outcome")


def standings(teams: DataFrame, games: DataFrame) -> DataFrame:
    """Rank by wins, then Buchholz score (wins of all opponents played), then game differential; ties by team_id.

    ``teams`` (team_id, match_wins, match_losses, game_wins, game_losses), ``games`` (team_id, opponent_id). Rows are
    range-partitioned by the ranking, each partition is numbered by itself, and the counts of those before it are added.
    """
    wins = teams.select(F.col("team_id").alias("opponent_id"), F.col("match_wins").alias("wins"))
    buchholz = games.join(wins, "opponent_id").groupBy("team_id").agg(F.sum("wins").alias("buchholz"))
    rows = teams.join(buchholz, "team_id", "left").withColumns({"buchholz": F.coalesce("buchholz", F.lit(0)), "differential": F.col("game_wins") - F.col("game_losses")})
    order = (F.desc("match_wins"), F.desc("buchholz"), F.desc("differential"), F.asc("team_id"))
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in parts.groupBy("_part").count().collect()}
    starts = [(p, sum(n for q, n in counts.items() if q < p)) for p in counts]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = parts.withColumn("rank", rank).join(starts, "_part").withColumn("rank", (F.col("rank") + F.col("_start")).cast("int"))
    return ranked.select("rank", "team_id", F.concat("match_wins", F.lit("W - "), "match_losses", F.lit("L")).alias("record"), F.greatest(F.lit(50), 500 - (F.col("rank") - 1) * 60).alias("prize_points"), "buchholz", "differential")


def bill_of_materials(uses: DataFrame) -> DataFrame:
    """(parent, part_number, name, quantity): quantities of each child in its parent, single level, after the root row.

    ``uses`` (parent, child, name, quantity). The root is the smallest parent that is nobody's child, with quantity 1.
    """
    lines = uses.groupBy("parent", F.col("child").alias("part_number")).agg(F.min("name").alias("name"), F.sum("quantity").alias("quantity"))
    roots = uses.select(F.col("parent").alias("part_number")).distinct().join(uses.select(F.col("child").alias("part_number")), "part_number", "left_anti")
    root = roots.agg(F.min("part_number").alias("part_number")).filter("part_number is not null").select(F.lit(None).cast("string").alias("parent"), "part_number", F.col("part_number").alias("name"), F.lit(1.0).alias("quantity"))
    return root.unionByName(lines)


def added_between(records: DataFrame, old: int, new: int) -> DataFrame:
    """By tile type: records of tiles in (old, new], and how many of them were withdrawn."""
    rows = records.filter((F.col("tile_id") > old) & (F.col("tile_id") <= new))
    return rows.groupBy("tile_type").agg(F.count("*").alias("added"), F.count_if(F.col("withdrawn")).alias("withdrawn"))


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """Requests (session, ts) with how many their session made in the trailing window, and whether that is allowed."""
    recent = Window.partitionBy("session").orderBy("ts").rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("recent", F.count("*").over(recent)).withColumn("allowed", F.col("recent") <= most)
