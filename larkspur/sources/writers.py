"""Sinks (SNK*).  Each writes with Spark's own writers into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replace exactly the runs that ``rows`` holds; other runs of the table stay.

    Rows of one run go to several files: Spark splits an oversized partition before the write.
    """
    rows.hint("rebalance", "extraction_run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("extraction_run_id").parquet(path)


def notice_lines(deps: DataFrame, catalog: DataFrame, projects: DataFrame, obligations: DataFrame) -> DataFrame:
    """Lines of the third-party notice of every project, with the columns that order them."""
    live = deps.filter(C("removed_at").isNull()).join(catalog.select("dependency_id", "license"), "dependency_id", "left")
    rows = live.select("project_id", F.coalesce("license", F.lit("Unknown")).alias("license"), "name", "version")
    groups = rows.select("project_id", "license").distinct().join(obligations.withColumnRenamed("license_spdx_id", "license"), "license", "left")
    none = F.lit("")

    def line(df: DataFrame, part: int, kind: int, name, text) -> DataFrame:
        return df.select("project_id", F.lit(part).alias("part"), (C("license") if "license" in df.columns else none).alias("license"), F.lit(kind).alias("kind"), name.alias("sort_name"), text.alias("line"))

    owners = projects.join(rows.select("project_id").distinct(), "project_id", "left_semi").select("project_id", C("name").alias("project_name"))
    out = line(owners, 0, 0, none, F.lit("THIRD-PARTY SOFTWARE NOTICES AND INFORMATION"))
    out = out.unionByName(line(owners, 0, 1, none, F.concat(F.lit("Project: "), C("project_name"))))
    out = out.unionByName(line(owners, 0, 2, none, F.lit("=" * 70)))
    out = out.unionByName(line(groups, 1, 0, none, F.concat(F.lit("LICENSE: "), C("license"))))
    out = out.unionByName(line(groups.filter(C("summary").isNotNull()), 1, 1, none, F.concat(F.lit("Obligations: "), C("summary"))))
    out = out.unionByName(line(groups, 1, 2, none, F.lit("-" * 70)))
    out = out.unionByName(line(rows, 1, 3, F.concat_ws("@", "name", "version"), F.concat(F.lit("  - "), C("name"), F.lit("@"), C("version"))))
    return out.unionByName(line(groups.filter(C("is_copyleft") & C("full_text").isNotNull()), 1, 4, none, C("full_text")))


def export_notice(lines: DataFrame, path: str) -> None:
    """One folder per project; its files, in name order, are the notice.

    Range partitioning by the line order splits a project with very many packages over several files.
    """
    order = ["project_id", "part", "license", "kind", "sort_name"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("project_id", "line").write.mode("overwrite").partitionBy("project_id").text(path)


def export_audit_log(rows: DataFrame, path: str, *, actions: list[str] | None = None, since=None, until=None) -> None:
    """Audit rows as CSV, filtered by action and time."""
    out = rows
    if actions:
        out = out.filter(C("event_type").isin(actions))
    if since is not None:
        out = out.filter(C("created_at") >= since)
    if until is not None:
        out = out.filter(C("created_at") <= until)
    out.write.mode("overwrite").option("header", "true").csv(path)


def export_sla(flat: DataFrame, summary: DataFrame, path: str) -> None:
    """Deadline rows and the summary as two JSON folders."""
    flat.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")
