"""Deadline clocks and deadline reports (WIN7, JN25, AGG11-AGG13, SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
STATES = ("on_track", "warning", "breached", "exempt", "met", "resolved_late")


def effective_policy(findings: DataFrame, projects: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings with the enabled policy of their organization and severity."""
    on = policies.filter(C("enabled")).select("organization_id", "severity", "max_hours", "warning_threshold_percent")
    return findings.join(projects.select("project_id", "organization_id"), "project_id").join(on, ["organization_id", "severity"])


def sla_clock(findings: DataFrame, events: DataFrame, projects: DataFrame, organizations: DataFrame, policies: DataFrame, *, now: Column) -> DataFrame:
    """Start clocks on findings without one: deadline, warning instant, state and breach instant.

    A clock starts at the first ``detected`` event of the vulnerability in the project, else when the row was
    created.  Organizations on pause, suppressed and accepted findings get no clock.
    """
    first = events.filter(C("event_type") == "detected").groupBy("project_id", "osv_id").agg(F.min("created_at").alias("_first"))
    running = organizations.filter(C("sla_paused_at").isNull()).select("organization_id")
    due = findings.filter(
        C("sla_status").isNull() & ~F.coalesce(C("suppressed"), F.lit(False)) & ~F.coalesce(C("risk_accepted"), F.lit(False))
    )
    rows = effective_policy(due, projects, policies).join(running, "organization_id", "left_semi").join(first, ["project_id", "osv_id"], "left")
    start = F.coalesce(C("_first"), C("created_at"))
    percent = F.coalesce(C("warning_threshold_percent"), F.lit(75))
    minute = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))
    rows = (
        rows.withColumn("detected_at", start)
        .withColumn("sla_deadline_at", start + minute * (C("max_hours") * 60))
        .withColumn("sla_warning_at", start + minute * (C("max_hours") * percent * 60 / 100))
    )
    state = F.when(now > C("sla_deadline_at"), "breached").when(now >= C("sla_warning_at"), "warning").otherwise("on_track")
    return (
        rows.withColumn("sla_status", state)
        .withColumn("sla_breached_at", F.when(C("sla_status") == "breached", C("sla_deadline_at")))
        .drop("_first")
    )


def clock_alerts(findings: DataFrame, *, since: Column, until: Column) -> DataFrame:
    """Warnings and breaches of running clocks that fell due in (since, until], each at its own instant.

    Calling it with adjoining intervals announces every instant exactly once, without any state per finding; a finding
    whose warning and deadline fall into one interval gets the breach only.
    """
    running = C("sla_status").isin("on_track", "warning")
    due = lambda c: F.coalesce((C(c) > since) & (C(c) <= until), F.lit(False))
    alert = F.when(due("sla_deadline_at"), "breach").when(due("sla_warning_at") & (C("sla_status") == "on_track") & (C("sla_deadline_at") > until), "warning")
    at = F.when(C("alert") == "breach", C("sla_deadline_at")).otherwise(C("sla_warning_at"))
    return findings.filter(running).withColumn("alert", alert).filter(C("alert").isNotNull()).withColumn("alert_at", at)


def resume_shift(findings: DataFrame, *, pause_seconds: int) -> DataFrame:
    """Move the running clocks forward by the length of a pause."""
    moving = C("sla_status").isin("on_track", "warning") & C("sla_deadline_at").isNotNull()
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(pause_seconds))
    out = findings
    for column in ("sla_deadline_at", "sla_warning_at"):
        out = out.withColumn(column, F.when(moving, C(column) + gap).otherwise(C(column)))
    return out


def percent_or_full(part: Column, whole: Column) -> Column:
    """Whole percent, 100 when there is nothing to measure."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(100).cast("long")


def sla_compliance(findings: DataFrame, key: list[str]) -> DataFrame:
    """Counts per clock state and the share of resolved findings that were on time."""
    counts = findings.groupBy(*key).agg(*[F.count_if(C("sla_status") == s).alias(s) for s in STATES])
    return counts.withColumn("compliance_percent", percent_or_full(C("met"), C("met") + C("resolved_late")))


def mttr(findings: DataFrame, key: list[str]) -> DataFrame:
    """Mean hours from detection to resolution, one decimal.

    Sums whole seconds, so the result does not depend on row order.
    """
    done = findings.filter(C("sla_status").isin("met", "resolved_late") & C("sla_met_at").isNotNull())
    seconds = F.timestamp_diff("SECOND", F.coalesce(C("detected_at"), C("created_at")), C("sla_met_at"))
    out = done.groupBy(*key).agg(F.sum(F.coalesce(seconds, F.lit(0))).alias("_s"), F.count("*").alias("resolved"))
    hours = C("_s") / F.lit(3600.0) / C("resolved")
    return out.withColumn("mttr_hours", F.floor(hours * 10 + 0.5) / 10).drop("_s")


def sla_by_month(findings: DataFrame, key: list[str]) -> DataFrame:
    """Findings per month by their state; one counts in a month when it was met, breached, or exempt and created in it.

    Each finding emits at most three months, so there is no range join.
    """
    month = lambda c: F.date_format(C(c), "yyyy-MM")
    exempt_month = F.when(C("sla_status") == "exempt", month("created_at"))
    months = F.array_distinct(F.array_compact(F.array(month("sla_met_at"), month("sla_breached_at"), exempt_month)))
    rows = findings.select(*key, "sla_status", F.explode(months).alias("month"))
    return rows.groupBy(*key, "month").agg(
        F.count_if(C("sla_status") == "met").alias("met"), F.count_if(C("sla_status") == "resolved_late").alias("met_late"),
        F.count_if(C("sla_status") == "breached").alias("breached"), F.count_if(C("sla_status") == "exempt").alias("exempt"),
    )


def export_sla(findings: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat rows of every finding with a clock, and one summary row per organization."""
    named = findings.join(projects.select("project_id", "organization_id", C("name").alias("project_name")), "project_id")
    flat = named.filter(C("sla_status").isNotNull()).select(
        "organization_id", "project_id", "project_name", "finding_id", "osv_id", "severity", "sla_status",
        "detected_at", "sla_deadline_at", "sla_met_at",
    )
    return flat, sla_compliance(named, ["organization_id"])
