"""Row filters over fact tables (FLT*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import labels
from larkspur.functions.versions import is_prerelease, version_key

RUN = ["project_id", "extraction_run_id"]


def run_pointers(projects: DataFrame, which: str = "active") -> DataFrame:
    """(project_id, extraction_run_id) of each project's active or previous run."""
    column = f"{which}_extraction_run_id"
    return projects.filter(F.col(column).isNotNull()).select("project_id", F.col(column).alias("extraction_run_id"))


def active_run(facts: DataFrame, projects: DataFrame, which: str = "active") -> DataFrame:
    """Rows of each project's active run; a project without one keeps no rows."""
    return facts.join(run_pointers(projects, which), RUN, "left_semi")


def live_dependencies(dependencies: DataFrame) -> DataFrame:
    return dependencies.filter(F.col("removed_at").isNull())


def open_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(labels.is_open())


def drop_noise_rules(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Drop static-analysis noise by rule id and path; browser-only projects drop a few rules more."""
    spa = projects.select("project_id", F.col("is_client_spa").alias("_spa"))
    return (
        findings.join(spa, "project_id", "left")
        .filter(~labels.sast_is_noise(F.col("rule_id"), F.coalesce(F.col("_spa"), F.lit(False))))
        .filter(~labels.sast_path_is_generated(F.col("file_path")))
        .drop("_spa")
    )


def drop_vendored_paths(findings: DataFrame) -> DataFrame:
    return findings.filter(~labels.is_vendored(F.col("file_path")) & ~F.col("file_path").startswith(".git/"))


SEVERITY_WORDS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def finding_filter(
    findings: DataFrame,
    *,
    severity: str | None = None,
    status: str | None = None,
    framework: str | None = None,
    min_score: int | None = None,
    frameworks: tuple[str, ...] = ("kubernetes", "terraform", "dockerfile", "cloudformation", "helm"),
) -> DataFrame:
    """Optional conjunctive filters; a value outside its vocabulary is ignored, as if it were not given."""
    out = findings
    if severity and severity.strip().upper() in SEVERITY_WORDS:
        out = out.filter(F.col("severity") == severity.strip().upper())
    if status and status.strip().lower() in ("open", "ignored"):
        out = out.filter(F.col("status") == status.strip().lower())
    if framework and framework.strip().lower() in frameworks:
        out = out.filter(F.col("framework") == framework.strip().lower())
    if min_score is not None:
        out = out.filter(F.col("depscore") >= min_score)
    return out


def reachability_filter(findings: DataFrame, levels: list[str], include_unknown: bool = False) -> DataFrame:
    keep: Column = F.col("reachability_level").isin(levels)
    if include_unknown:
        keep = keep | F.col("reachability_level").isNull()
    return findings.filter(keep)


def access_grants(org_members: DataFrame, org_roles: DataFrame, project_members: DataFrame, team_members: DataFrame) -> DataFrame:
    """Who may see what, as (user, scope, scope id) without listing every project of an organization.

    Owners hold their whole organization, as do members whose role there may manage teams and projects; other members
    hold their own projects and teams.  A role that the organization's table does not have permits nothing.
    """
    may = org_roles.select("organization_id", F.col("name").alias("role"), F.col("manage_teams_and_projects").alias("_may"))
    roles = org_members.join(may, ["organization_id", "role"], "left").withColumn("_all", (F.col("role") == "owner") | F.coalesce("_may", F.lit(False)))
    wide = roles.filter("_all").select("user_id", F.lit("organization").alias("scope"), F.col("organization_id").alias("scope_id"))
    plain = roles.filter(~F.coalesce("_all", F.lit(False))).select("user_id").distinct()
    direct = project_members.select("user_id", F.lit("project").alias("scope"), F.col("project_id").alias("scope_id"))
    team = team_members.select("user_id", F.lit("team").alias("scope"), F.col("team_id").alias("scope_id"))
    narrow = direct.unionByName(team).join(plain, "user_id", "left_semi")
    return wide.unionByName(narrow).distinct()


#: Viewers of one organization or team are dealt over so many tasks, each of which gets its projects.
VIEWER_PARTS = 16


def _each_project(viewers: DataFrame, projects: DataFrame, keys: list[str]) -> DataFrame:
    """Viewers joined to the projects with the same keys, which are few and have very many of both."""
    dealt = viewers.withColumn("_part", F.pmod(F.xxhash64("user_id"), F.lit(VIEWER_PARTS)).cast("int"))
    return dealt.join(projects.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(VIEWER_PARTS - 1)))).hint("merge"), [*keys, "_part"])


def accessible_projects(grants: DataFrame, projects: DataFrame, project_teams: DataFrame, org_members: DataFrame) -> DataFrame:
    """Expand the grants of the given viewers to (user_id, project_id) inside the viewers' organizations.

    Team and project grants meet projects by organization as well, so a team that many organizations share makes no pairs
    across them.  Rows are made last and never exchanged: a project that several teams of a viewer have comes with the
    first of these teams, and a grant of a single project counts where no team of the viewer has the project.
    """
    of_org = ["user_id", "organization_id"]
    inside = projects.select("project_id", "organization_id")
    viewers = org_members.select(of_org).distinct()
    scoped = lambda scope, name: grants.filter(F.col("scope") == scope).select("user_id", F.col("scope_id").alias(name)).distinct()
    wide = scoped("organization", "organization_id").join(viewers, of_org, "left_semi")
    plain = viewers.join(wide, of_org, "left_anti")
    member = scoped("team", "team_id").groupBy("user_id").agg(F.collect_set("team_id").alias("_mine"))
    teams = inside.distinct().join(project_teams.groupBy("project_id").agg(F.collect_set("team_id").alias("_theirs")), "project_id", "left")
    joined = plain.join(member, "user_id", "left")
    one = (F.size("_mine") == 1) | (F.size("_theirs") == 1)
    first = F.when(one, True).otherwise(F.array_min(F.array_intersect("_mine", "_theirs")) == F.col("team_id"))
    by_team = _each_project(joined.withColumn("team_id", F.explode("_mine")), teams.withColumn("team_id", F.explode("_theirs")), ["team_id", "organization_id"]).filter(first)
    direct = scoped("project", "project_id").join(teams, "project_id").join(joined, of_org).filter(~F.coalesce(F.arrays_overlap("_mine", "_theirs"), F.lit(False)))
    cols = ["user_id", "project_id", "organization_id"]
    return _each_project(wide, inside, ["organization_id"]).select(cols).union(by_team.select(cols)).union(direct.select(cols))


def _sla_scope(findings: DataFrame, projects: DataFrame, organizations: DataFrame) -> DataFrame:
    running = organizations.filter(F.col("sla_paused_at").isNull()).select("organization_id")
    owners = projects.select("project_id", "organization_id").join(running, "organization_id", "left_semi")
    return findings.join(owners, "project_id")


def _nearest(rows: DataFrame, per_organization: int | None) -> DataFrame:
    """All rows, or so many of each organization by deadline."""
    if per_organization is None:
        return rows
    return row_number_at_most(rows, ["organization_id"], [F.col("sla_deadline_at"), F.col("finding_id")], per_organization)


def sla_approaching(findings: DataFrame, projects: DataFrame, organizations: DataFrame, *, now: Column, per_organization: int | None = None) -> DataFrame:
    """Findings inside their warning window that nobody was told about, all of them or the nearest deadlines of each organization."""
    due = findings.filter(
        (F.col("sla_status") == "on_track") & F.col("sla_warning_notified_at").isNull()
        & (F.col("sla_warning_at") <= now) & (F.col("sla_deadline_at") > now)
    )
    hours = F.timestamp_diff("SECOND", now, F.col("sla_deadline_at")) / 3600
    return _nearest(_sla_scope(due, projects, organizations).withColumn("hours_remaining", F.round(hours, 4)), per_organization)


def sla_newly_breached(findings: DataFrame, projects: DataFrame, organizations: DataFrame, *, now: Column, per_organization: int | None = None) -> DataFrame:
    """Findings past their deadline whose breach was not announced yet, all of them or the oldest deadlines of each organization."""
    late = findings.filter(
        F.col("sla_status").isin("on_track", "warning") & F.col("sla_breach_notified_at").isNull()
        & (F.col("sla_deadline_at") < now)
    )
    hours = F.timestamp_diff("SECOND", F.col("sla_deadline_at"), now) / 3600
    return _nearest(_sla_scope(late, projects, organizations).withColumn("hours_overdue", F.round(hours, 4)), per_organization)


def stable_versions(versions: DataFrame) -> DataFrame:
    """Versions that coerce and carry no pre-release tail, with their sort key."""
    v = F.col("version")
    return versions.withColumn("version_key", version_key(v)).filter(F.col("version_key").isNotNull() & ~is_prerelease(v))


def drop_single_node_flows(flows: DataFrame, key: str = "flow_signature_hash", order: str = "flow_id") -> DataFrame:
    """Drop flows of at most one node; of several flows with one key keep the first by ``order``.

    A flow without an order column comes after those that have one.  Flows without a key are all kept.
    """
    long = flows.filter(F.col("flow_length") > 1)
    first = row_number_at_most(long.filter(F.col(key).isNotNull()), ["project_id", key], [F.col(order).asc_nulls_last()], 1)
    return first.unionByName(long.filter(F.col(key).isNull()))


def fresh_cache(cache: DataFrame, expected_hash: Column, *, scanner_version: str, now: Column, ttl_days: int = 7) -> DataFrame:
    """Cached results of exactly this scanner version, inside the time to live, with an intact content hash."""
    return cache.filter(
        (F.col("scanner_version") == scanner_version)
        & (F.timestamp_diff("SECOND", F.col("scanned_at"), now) <= ttl_days * 86400)
        & (F.col("scan_results_hash") == expected_hash)
    )


def fix_rule_gate(rules: DataFrame, package: list[str]) -> DataFrame:
    """Drop low-precision malware rules; keep weak rules only when the package has a feed hit or a strong rule."""
    dropped = labels.malware_rule_dropped(F.col("rule_id"))
    weak = labels.malware_rule_weak(F.col("rule_id"))
    backing = rules.groupBy(*package).agg(F.bool_or(F.col("has_feed_hit") | (~dropped & ~weak)).alias("_backed"))
    return (
        rules.filter(~dropped).join(backing, package)
        .filter(~weak | F.col("_backed")).drop("_backed")
    )


def row_number_at_most(df: DataFrame, partition: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per partition; Spark limits each input partition to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
