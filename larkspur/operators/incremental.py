"""Stored summaries kept current by signed changes, and the pass over those that are missing or old (STR15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
COUNTS = ["vuln_total", "vuln_high", "score_total"]


def measures() -> dict[str, Column]:
    """What one finding adds to the counts of its project; taking it off again undoes it."""
    shown = ~F.coalesce("suppressed", F.lit(False))
    return {
        "vuln_total": shown.cast("long"), "vuln_high": (shown & F.coalesce(C("severity") == "high", F.lit(False))).cast("long"),
        "score_total": F.when(shown, F.coalesce("depscore", F.lit(0))).otherwise(0).cast("long"),
    }


def worst() -> Column:
    """A finding's part in its project's worst score.  A maximum cannot be taken off, see ``apply_changes``."""
    return F.when(~F.coalesce("suppressed", F.lit(False)), C("depscore"))


def summarize(findings: DataFrame, projects: DataFrame, at: Column) -> DataFrame:
    """Summary rows of the given projects, from all their findings: counts, worst score, time."""
    own = measures()
    facts = findings.groupBy("project_id").agg(*[F.sum(own[c]).alias(c) for c in COUNTS], F.max(worst()).alias("worst_depscore"))
    out = projects.select("project_id").distinct().join(facts, "project_id", "left").fillna(0, COUNTS)
    return out.select("project_id", *COUNTS, "worst_depscore", at.alias("computed_at"))


def changes(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ between two states of a table: the old one with sign -1, the new one with sign 1.

    One aggregation over both states instead of a full outer join; equal rows cancel out.
    """
    cols = [*key, *columns]
    tagged = before.select(*cols, F.lit(-1).alias("sign")).unionByName(after.select(*cols, F.lit(1).alias("sign")))
    return tagged.groupBy(*cols).agg(F.sum("sign").alias("sign")).filter(C("sign") != 0)


def apply_changes(stored: DataFrame, changed: DataFrame, at: Column) -> DataFrame:
    """Stored summaries with signed changes merged in; touches only projects that have a summary.

    Counts add up.  A worst score grows with new rows; where a row as bad as the stored one went, it is unknown
    now, and the summary loses its time so that the stale pass computes it anew.
    """
    own = measures()
    delta = changed.groupBy("project_id").agg(
        *[F.sum(own[c] * C("sign")).alias(f"_{c}") for c in COUNTS],
        F.max(F.when(C("sign") > 0, worst())).alias("_rise"), F.max(F.when(C("sign") < 0, worst())).alias("_gone"))
    rows = stored.join(delta, "project_id", "left")
    touched = C("_vuln_total").isNotNull()
    lost = touched & F.coalesce(C("_gone") >= C("worst_depscore"), F.lit(False)) & ~F.coalesce(C("_rise") >= C("_gone"), F.lit(False))
    return rows.select(
        "project_id", *[(C(c) + F.coalesce(C(f"_{c}"), F.lit(0))).alias(c) for c in COUNTS],
        F.when(~lost, F.greatest("worst_depscore", "_rise")).alias("worst_depscore"),
        F.when(lost, F.lit(None)).when(touched, at).otherwise(C("computed_at")).alias("computed_at"))


def stale_projects(stored: DataFrame, projects: DataFrame, cut: Column | None) -> DataFrame:
    """Projects without a summary or with one older than the cut (all, without a cut).

    Reads ids and times of the stored summaries only.
    """
    have = stored.select("project_id", "computed_at")
    rows = projects.select("project_id").distinct().join(have, "project_id", "left")
    return (rows if cut is None else rows.filter(C("computed_at").isNull() | (C("computed_at") < cut))).select("project_id")


def stale_pass(stored: DataFrame, findings: DataFrame, projects: DataFrame, *, cut: Column | None, at: Column) -> DataFrame:
    """All summaries after those that are missing or older than the cut were computed from their findings."""
    stale = stale_projects(stored, projects, cut)
    fresh = summarize(findings.join(stale, "project_id", "left_semi"), stale, at)
    return stored.join(stale, "project_id", "left_anti").unionByName(fresh)
