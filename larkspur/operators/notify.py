"""Notification rules, deliveries and delivery limits (JN26, STR3, STR6, STR8).

Every function takes batch or streaming event rows; rules are a static table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

C = F.col
# Event types that are never batched.
CRITICAL_TYPES = ["malicious_package_detected", "security_analysis_failure"]


def usable_rules(rules: DataFrame, teams: DataFrame, projects: DataFrame, *, now: Column) -> DataFrame:
    """Active event rules whose team or project is not on pause and that are not snoozed."""
    paused = lambda c: F.coalesce(C(c) > now, F.lit(False))
    off = (
        teams.filter(paused("notifications_paused_until")).select(F.lit("team").alias("scope"), C("team_id").alias("scope_id"))
        .unionByName(projects.filter(paused("notifications_paused_until")).select(F.lit("project").alias("scope"), C("project_id").alias("scope_id")))
    )
    live = rules.filter(C("active") & (C("trigger_type") != "weekly_digest") & ~paused("snoozed_until"))
    return live.join(off, ["scope", "scope_id"], "left_anti")


def matching_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with every rule of their organization, team and project; discovery rules may ask for a score.

    ``rules`` comes from ``usable_rules``.
    """
    def scope(name: str, column: str) -> Column:
        return F.struct(F.lit(name).alias("scope"), C(column).alias("scope_id"))

    scopes = F.filter(F.array(scope("organization", "organization_id"), scope("team", "team_id"), scope("project", "project_id")), lambda s: s["scope_id"].isNotNull())
    spread = events.select("*", F.explode(scopes).alias("_s")).select(*events.columns, "_s.*")
    wanted = rules.select("rule_id", "scope", "scope_id", "min_depscore_threshold", "destinations")
    weak = F.coalesce((C("event_type") == "vulnerability_discovered") & (C("depscore") < C("min_depscore_threshold")), F.lit(False))
    return spread.join(wanted, ["scope", "scope_id"]).filter(~weak)


def notify(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Deliveries: one per (event, destination), whichever rules ask for it."""
    return matching_rules(events, rules).select("event_id", "organization_id", "created_at", F.explode("destinations").alias("destination"))


def is_critical(event_type: Column, priority: Column) -> Column:
    return event_type.isin(CRITICAL_TYPES) | (priority == "critical")


def retry_stuck(events: DataFrame, *, now: Column, minutes: int = 10, max_attempts: int = 3) -> DataFrame:
    """Pending events older than the limit: retry them, or fail them after the last attempt."""
    stuck = events.filter((C("status") == "pending") & (C("created_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))
    again = C("dispatch_attempts") < max_attempts
    return stuck.withColumn("action", F.when(again, "retry").otherwise("failed")).withColumn("dispatch_attempts", C("dispatch_attempts") + again.cast("long"))


def accept_in_order(times, limit: int, window_micros: int, recent: deque) -> list[bool]:
    """Sliding-log decision over ascending times; ``recent`` holds the accepted times still in the window."""
    out = []
    for t in times:
        while recent and recent[0] <= t - window_micros:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def rate_limit(events: DataFrame, *, scope: str, time: str, tie: str, limit: int, window_seconds: int = 3600) -> DataFrame:
    """Allow an event if fewer than ``limit`` events of its scope were allowed in the window before it.

    Only allowed events count, so the decision is sequential.  Scopes are first cut at idle windows: across an empty
    window-length bucket nothing carries over, and each piece is its own unit of work.  Pieces of at most ``limit``
    events need no decision at all.  The others are sorted by Spark and streamed through Python, which keeps at most
    ``limit`` times.  Events without a scope are one scope.
    """
    micros = window_seconds * 1_000_000
    at = F.unix_micros(C(time).cast("timestamp"))
    # one value that is never null stands for the scope, so that events without a scope share one limit
    rows = events.withColumn("_t", at).withColumn("_bucket", F.floor(C("_t") / micros)).withColumn("_scope", F.struct(scope))
    w = Window.partitionBy("_scope").orderBy("_bucket")
    busy = rows.groupBy("_scope", "_bucket").agg(F.count("*").alias("_n"))
    jump = F.coalesce(C("_bucket") - F.lag("_bucket").over(w) > 1, F.lit(False)).cast("int")
    pieces = busy.withColumn("_jump", jump).withColumn("_piece", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = pieces.groupBy("_scope", "_piece").agg(F.sum("_n").alias("_size"))
    placed = rows.join(pieces.select("_scope", "_bucket", "_piece"), ["_scope", "_bucket"]).join(sizes, ["_scope", "_piece"])
    calm = placed.filter(C("_size") <= limit).select(*events.columns, F.lit(True).alias("allowed"))
    crowded = placed.filter(C("_size") > limit).select(*events.columns, "_piece", "_t")
    ordered = crowded.repartition(scope, "_piece").sortWithinPartitions(scope, "_piece", "_t", tie)
    columns = events.columns

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            allowed = []
            for unit, part in batch.groupby([scope, "_piece"], sort=False, dropna=False):
                unit = tuple(None if pd.isna(x) else x for x in unit)
                if unit != current:
                    current, recent = unit, deque()
                allowed += accept_in_order(part["_t"].to_numpy(), limit, micros, recent)
            yield batch[columns].assign(allowed=allowed)

    schema = StructType([*events.schema.fields, StructField("allowed", BooleanType())])
    return calm.unionByName(ordered.mapInPandas(decide, schema))
