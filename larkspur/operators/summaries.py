"""Project, team and organization roll-ups (AGG1-AGG9, AGG29-AGG36, AGG44-AGG50, WIN1, WIN9, WIN10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import labels, scores
from larkspur.operators.filters import RUN, active_run, run_pointers
from larkspur.operators.sla import STATES, percent_or_full

C = F.col
BANDS = ("critical", "high", "medium", "low")


def per_active_run(facts: DataFrame, projects: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate by (project, run) first, then keep each project's active run.

    The raw rows are reduced on the map side, so no fact row is shuffled for the run filter.
    """
    return facts.groupBy(*RUN).agg(*aggregates).join(run_pointers(projects), RUN, "left_semi").drop("extraction_run_id")


def band_counts(band: Column, keep: Column | None = None) -> list[Column]:
    out = []
    for b in BANDS:
        hit = band == b
        out.append(F.count_if(hit if keep is None else keep & hit).alias(f"band_{b}"))
    return out


def container_image_groups(findings: DataFrame) -> DataFrame:
    """Exploited container findings one by one; all others collapsed to the worst score per image."""
    live = findings.filter(
        ~C("status").isin("ignored", "resolved") & ~F.coalesce(C("suppressed"), F.lit(False)) & ~F.coalesce(C("risk_accepted"), F.lit(False))
    )
    score = F.coalesce(C("depscore"), F.lit(0))
    single = live.filter(C("is_kev")).select(*RUN, "image_reference", score.alias("score"), F.lit(True).alias("is_kev"))
    grouped = live.filter(~C("is_kev")).groupBy(*RUN, "image_reference").agg(F.max(score).alias("score")).withColumn("is_kev", F.lit(False))
    return single.unionByName(grouped)


def newest_run_scope(dast: DataFrame) -> DataFrame:
    """Rows of the newest runtime scan of each project."""
    newest = dast.groupBy("project_id").agg(F.max_by("dast_run_id", F.struct("created_at", "finding_id")).alias("dast_run_id"))
    return dast.join(newest, ["project_id", "dast_run_id"], "left_semi")


def dast_groups(dast: DataFrame) -> DataFrame:
    """One score per (project, handler file, family): the canonical open finding of the newest scan."""
    vuln = F.lower(F.concat_ws(" ", F.coalesce("vulnerability_type", F.lit("")), F.coalesce("message", F.lit(""))))
    shape = (
        F.when(vuln.rlike("(template ?injection|ssti|sql ?injection|sqli|command ?injection)"), 3)
        .when(vuln.rlike("(persistent|stored)"), 2).when(vuln.rlike(r"(cross.?site.?script|\bxss\b)"), 1).otherwise(0)
    )
    canon = labels.severity_rank(C("severity")) * 10 + shape
    score = scores.dast_depscore(C("severity"), C("confidence"), C("vulnerability_type"), C("linked_sca_osv_id").isNotNull(), C("kev"), unknown_base=48)
    rows = newest_run_scope(dast).filter((C("status") == "open") & ~C("auto_ignored")).select(
        "project_id", "handler_file_path", labels.vuln_family(C("vulnerability_type"), C("rule_id"), C("message")).alias("family"),
        score.alias("score"), canon.alias("canon"), "finding_id",
    )
    return rows.groupBy("project_id", "handler_file_path", "family").agg(
        F.max_by("score", F.struct("canon", (-C("finding_id")).alias("t"))).alias("score"))


def security_summary(projects, findings, semgrep, secrets, iac, container, dast, malicious, flows, suppressions, jobs) -> DataFrame:
    """One row per project: counts, worst score and band totals over all finding families.

    Every family contributes long-form rows (project, measure columns); one aggregation adds them up.  Families are
    reduced by (project, run) before the active-run join.
    """
    from larkspur.operators.runs import suppressed_flag

    closed = C("status").isin("ignored", "resolved")
    accepted = F.coalesce(C("suppressed"), F.lit(False)) | F.coalesce(C("risk_accepted"), F.lit(False))
    silenced = C("auto_ignored") & C("runtime_confirmed_at").isNull()
    open_ = ~closed & ~accepted & ~silenced
    ranked = labels.score_band(labels.ranking_score(C("contextual_depscore"), C("depscore")))
    vulns = per_active_run(
        findings, projects,
        F.count_if(~closed).alias("vuln_count"), F.count_if(~closed & (C("severity") == "critical")).alias("critical_count"),
        F.count_if(~closed & C("is_reachable")).alias("reachable_count"),
        F.max(F.when(open_, C("depscore"))).alias("worst_depscore"), *band_counts(ranked, open_),
        F.count_if((C("status") == "ignored") | accepted | silenced).alias("ignored_count"),
    )
    severity = F.lower(F.coalesce(C("severity"), F.lit("")))
    iac_band = F.when(severity.isin("critical", "high"), severity).when(severity.isin("medium", "moderate"), "medium").otherwise("low")
    by_score = labels.score_band(C("depscore"))
    infra = per_active_run(iac, projects, *band_counts(iac_band, ~closed & ~accepted & ~C("auto_ignored")))
    images = per_active_run(container_image_groups(container), projects, *band_counts(labels.score_band(C("score"))))
    has_images = per_active_run(container, projects, F.lit(True).alias("has_container"))
    code = per_active_run(semgrep, projects, *band_counts(by_score, ~closed), F.count("*").alias("semgrep_count"))
    keys = per_active_run(
        secrets, projects, *band_counts(by_score, ~closed), F.count("*").alias("secret_count"), F.count_if("is_verified").alias("verified_secret_count"))
    mal_score = F.coalesce(C("depscore"), F.when(F.lower(F.coalesce(C("severity"), F.lit(""))) == "critical", 95).otherwise(0))
    malware = per_active_run(malicious, projects, *band_counts(labels.score_band(mal_score), ~closed & ~accepted))
    own = suppressed_flag(flows.filter((C("reachability_source") == "taint_engine") & C("osv_id").isNull()), suppressions).filter(~C("is_suppressed"))
    flow_score = scores.lookup(scores.FLOW_BAND, F.lower(F.coalesce(C("vuln_class"), F.lit(""))), 55)
    paths = per_active_run(own, projects, *band_counts(labels.score_band(flow_score)))
    runtime = dast_groups(dast).groupBy("project_id").agg(*band_counts(labels.score_band(C("score"))))
    has_dast = dast.select("project_id").distinct().withColumn("has_dast", F.lit(True))
    scans = jobs.filter(C("status") == "completed").groupBy("project_id").agg(F.max("completed_at").alias("last_scan_at"))

    parts = [vulns, infra, images, has_images, code, keys, malware, paths, runtime, has_dast, scans]
    long = projects.select("project_id")
    for part in parts:
        long = long.unionByName(part, allowMissingColumns=True)
    counts = ["vuln_count", "critical_count", "reachable_count", "band_critical", "band_high", "band_medium", "band_low",
              "ignored_count", "semgrep_count", "secret_count", "verified_secret_count"]
    out = long.groupBy("project_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce(F.max("worst_depscore"), F.lit(0)).alias("worst_depscore"),
        F.coalesce(F.bool_or("has_container"), F.lit(False)).alias("has_container"),
        F.coalesce(F.bool_or("has_dast"), F.lit(False)).alias("has_dast"), F.max("last_scan_at").alias("last_scan_at"),
    )
    return out.join(projects.select("project_id"), "project_id", "left_semi")


def project_stats(findings: DataFrame, deps: DataFrame, projects: DataFrame) -> DataFrame:
    """Finding, deadline and package counts per project; suppressed findings do not count."""
    shown = ~C("suppressed")
    facts = per_active_run(
        findings, projects, F.count_if(shown).alias("vuln_total"),
        *[F.count_if(shown & (C("severity") == s)).alias(f"vuln_{s}") for s in BANDS],
        F.count_if(shown & C("is_reachable")).alias("reachable_count"),
        *[F.count_if(shown & (C("sla_status") == s)).alias(f"sla_{s}") for s in STATES],
    )
    vulnerable = per_active_run(
        findings.filter(shown).select(*RUN, "project_dependency_id").distinct(), projects, F.count("*").alias("deps_vulnerable"))
    packages = deps.filter(C("removed_at").isNull()).groupBy("project_id").agg(
        F.count("*").alias("deps_total"), F.count_if("is_direct").alias("deps_direct"), F.count_if(~C("is_direct")).alias("deps_transitive"),
        F.count_if("is_outdated").alias("deps_outdated"), F.count_if("policy_allowed").alias("deps_compliant"),
        F.count_if(~C("policy_allowed")).alias("deps_failing"),
    )
    out = projects.select("project_id").join(facts, "project_id", "left").join(vulnerable, "project_id", "left").join(packages, "project_id", "left")
    return out.fillna(0)


def team_stats(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Team totals; unlike the project statistics, deadline states count suppressed findings too."""
    shown = ~C("suppressed")
    rows = per_active_run(
        findings, projects, F.count_if(shown).alias("vuln_total"), *[F.count_if(shown & (C("severity") == s)).alias(f"vuln_{s}") for s in BANDS],
        *[F.count_if(C("sla_status") == s).alias(f"sla_{s}") for s in STATES],
    )
    names = [c for c in rows.columns if c != "project_id"]
    return rows.join(projects.select("project_id", "team_id"), "project_id").groupBy("team_id").agg(*[F.sum(c).alias(c) for c in names])


def org_stats(projects: DataFrame, findings: DataFrame, semgrep: DataFrame, secrets: DataFrame, deps: DataFrame, jobs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per organization: health bands, severities, code findings, compliance, packages, members, deadlines."""
    score = F.coalesce(C("health_score"), F.lit(0))
    heads = projects.groupBy("organization_id").agg(
        F.count("*").alias("projects"), F.count_if(score >= 80).alias("healthy"), F.count_if((score >= 50) & (score < 80)).alias("at_risk"),
        F.count_if(score < 50).alias("critical_health"), F.count_if("is_passing").alias("passing"),
    )
    shown = ~C("suppressed")
    per_project = [
        per_active_run(findings, projects, F.count_if(shown).alias("vuln_total"), *[F.count_if(shown & (C("severity") == s)).alias(f"vuln_{s}") for s in BANDS],
                       *[F.count_if(C("sla_status") == s).alias(f"sla_{s}") for s in STATES]),
        per_active_run(semgrep, projects, F.count("*").alias("semgrep_total")),
        per_active_run(secrets, projects, F.count("*").alias("secret_total")),
        deps.filter(C("removed_at").isNull()).groupBy("project_id").agg(F.count("*").alias("dependencies_total")),
    ]
    names = ["vuln_total", *[f"vuln_{s}" for s in BANDS], *[f"sla_{s}" for s in STATES], "semgrep_total", "secret_total", "dependencies_total"]
    long = projects.select("project_id")
    for part in per_project:
        long = long.unionByName(part, allowMissingColumns=True)
    sums = long.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in names])
    facts = sums.join(projects.select("project_id", "organization_id"), "project_id").groupBy("organization_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    syncing = jobs.filter((C("job_type") == "extraction") & C("status").isin("queued", "processing")).groupBy("organization_id").agg(F.count("*").alias("syncing"))
    people = members.groupBy("organization_id").agg(F.count("*").alias("members"))
    out = heads.join(facts, "organization_id", "left").join(syncing, "organization_id", "left").join(people, "organization_id", "left").fillna(0)
    return (
        out.withColumn("compliance_percent", percent_or_full(C("passing"), C("projects")))
        .withColumn("sla_compliance_percent", percent_or_full(C("sla_met"), C("sla_met") + C("sla_resolved_late")))
    )


def health_score(projects: DataFrame, findings: DataFrame, deps: DataFrame, semgrep: DataFrame, secrets: DataFrame) -> DataFrame:
    """0-100 health: 40 % policy, 30 % vulnerabilities, 20 % freshness, 10 % code findings.

    A package without a policy verdict counts as compliant here.
    """
    live = deps.filter(C("removed_at").isNull()).groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(C("policy_allowed"), F.lit(True))).alias("good"),
        F.count("is_outdated").alias("known"), F.count_if("is_outdated").alias("old"),
    )
    weight = scores.lookup({"critical": 25, "high": 10, "medium": 5, "low": 1}, C("severity"), 0)
    vulns = per_active_run(findings, projects, F.sum(F.when(~C("suppressed"), weight).otherwise(0)).alias("penalty"))
    code = per_active_run(semgrep, projects, F.count("*").alias("sast"))
    keys = per_active_run(secrets, projects, F.count_if("is_verified").alias("verified"))
    rows = projects.select("project_id")
    for part in (live, vulns, code, keys):
        rows = rows.join(part, "project_id", "left")
    rows = rows.fillna(0)
    none = C("n") == 0
    compliance = F.when(none, 100.0).otherwise(C("good") * 100.0 / C("n"))
    safety = F.greatest(F.lit(0), 100 - C("penalty")).cast("double")
    fresh = F.when(none, 100.0).when(C("known") == 0, 80.0).otherwise((C("n") - C("old")) * 100.0 / C("n"))
    tidy = F.greatest(F.lit(0), 100 - C("sast") * 5 - C("verified") * 10).cast("double")
    total = F.floor(compliance * 0.4 + safety * 0.3 + fresh * 0.2 + tidy * 0.1 + 0.5)
    return rows.select("project_id", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long").alias("health_score"))


def debt_points(projects, findings, deps, semgrep, secrets) -> DataFrame:
    """Debt points per project and part, doubled so that the half points stay whole numbers."""
    vuln_weight = scores.lookup({"critical": 20, "high": 10, "medium": 4, "low": 2}, F.lower(F.coalesce(C("severity"), F.lit(""))), 0)
    code_weight = scores.lookup({"critical": 10, "high": 6, "medium": 2, "low": 1}, F.lower(F.coalesce(C("severity"), F.lit(""))), 0)
    open_ = ~C("suppressed") & ~C("risk_accepted")
    live = deps.filter(C("removed_at").isNull()).groupBy("project_id").agg(
        F.sum(F.when(~C("policy_allowed"), 6).otherwise(0)).alias("compliance2"), F.sum(F.when(C("is_outdated"), 2).otherwise(0)).alias("stale2"))
    parts = [
        per_active_run(findings, projects, F.sum(F.when(open_, vuln_weight).otherwise(0)).alias("vulns2")), live,
        per_active_run(semgrep, projects, F.sum(code_weight).alias("code2")),
        per_active_run(secrets, projects, F.sum(F.when(C("is_current"), 10).otherwise(0)).alias("secrets2")),
    ]
    long = projects.select("project_id")
    for part in parts:
        long = long.unionByName(part, allowMissingColumns=True)
    names = ["vulns2", "compliance2", "stale2", "code2", "secrets2"]
    return long.groupBy("project_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def debt_score(projects, findings, deps, semgrep, secrets) -> DataFrame:
    """Debt per project and per organization (project null), capped at 1000 on each level."""
    points = debt_points(projects, findings, deps, semgrep, secrets).join(projects.select("project_id", "organization_id"), "project_id")
    total = F.sum(C("vulns2") + C("compliance2") + C("stale2") + C("code2") + C("secrets2")) / 2.0
    org, project = C("organization_id"), C("project_id")
    return points.groupingSets([[org, project], [org]], org, project).agg(F.least(F.lit(1000.0), total).alias("score"))


def debt_snapshot(projects, findings, deps, semgrep, secrets, *, day: str) -> DataFrame:
    """Snapshot rows of one day: the organization row and its project rows."""
    return debt_score(projects, findings, deps, semgrep, secrets).withColumn("snapshot_date", F.lit(day).cast("date"))


def top_vulns(findings: DataFrame, projects: DataFrame, group: str | None = None, k: int = 5) -> DataFrame:
    """Worst critical/high finding per vulnerability with its affected-project count, best ``k`` (per group).

    Both parts are aggregations with map-side combine; ties go to the lowest project.
    """
    rows = active_run(findings.filter(~C("suppressed") & C("osv_id").isNotNull()), projects)
    key = ["osv_id"]
    if group:
        rows = rows.join(projects.select("project_id", group), "project_id")
        key = [group, "osv_id"]
    affected = rows.groupBy(*key).agg(F.countDistinct("project_id").alias("affected_project_count"))
    rank = F.struct(C("depscore").isNull().alias("n"), (-C("depscore")).alias("d"), C("project_id").alias("p"), C("severity").alias("s"))
    worst = rows.filter(C("severity").isin("critical", "high")).groupBy(*key).agg(F.min(rank).alias("w"))
    out = worst.join(affected, key).select(
        *key, (-C("w.d")).alias("depscore"), C("w.s").alias("severity"), C("w.p").alias("worst_project_id"), "affected_project_count")
    order = [C("depscore").desc_nulls_last(), C("osv_id").asc()]
    if group:
        from larkspur.operators.filters import row_number_at_most

        return row_number_at_most(out, [group], order, k)
    return out.orderBy(*order).limit(k)


def run_list(jobs: DataFrame, k: int = 20) -> DataFrame:
    """First log time of each run, without runs that any fix job touched, newest ``k`` per project."""
    from larkspur.operators.filters import row_number_at_most

    grouped = jobs.groupBy("project_id", "run_id").agg(F.min("created_at").alias("started_at"), F.bool_or(C("job_type") == "fix").alias("fix"))
    return row_number_at_most(grouped.filter(~F.coalesce(C("fix"), F.lit(False))).drop("fix"), ["project_id"], [C("started_at").desc(), C("run_id").desc()], k)


def failure_rate(runs_df: DataFrame, key: list[str], *, now: Column, minutes: int = 60, threshold: float = 5.0, min_runs: int = 5) -> DataFrame:
    """Runs, failures and failure share inside the window; ok below ``min_runs`` runs or below the threshold."""
    recent = (F.timestamp_diff("SECOND", C("created_at"), now) < minutes * 60) & (C("created_at") <= now)
    out = runs_df.groupBy(*key).agg(F.count_if(recent).alias("recent_runs"), F.count_if(recent & (C("status") == "failed")).alias("recent_failures"))
    pct = F.when(C("recent_runs") > 0, F.round(C("recent_failures") * 100.0 / C("recent_runs"), 4)).otherwise(0.0)
    return out.withColumn("failure_pct", pct).withColumn("should_run", (C("recent_runs") < min_runs) | (C("failure_pct") < threshold))


def running_snapshot(jobs: DataFrame, job_type: str) -> tuple[DataFrame, DataFrame]:
    """(distinct busy machines, queued and processing jobs per organization) of one job type."""
    typed = jobs.filter(C("job_type") == job_type)
    machines = typed.filter((C("status") == "processing") & C("machine_id").isNotNull()).select("machine_id").distinct()
    load = typed.filter(C("status").isin("queued", "processing")).groupBy("organization_id").agg(
        F.count_if(C("status") == "queued").alias("queued"), F.count_if(C("status") == "processing").alias("inflight"))
    return machines, load


def scanner_rollup(iac: DataFrame, container: DataFrame, projects: DataFrame) -> DataFrame:
    """Infrastructure and container counts by severity (ignored rows apart) and container reachability."""
    severity = F.upper(F.coalesce(C("severity"), F.lit("")))
    ignored = C("status") == "ignored"

    def part(prefix: str) -> list[Column]:
        return [F.count_if(~ignored & (severity == s.upper())).alias(f"{prefix}_{s}") for s in (*BANDS, "info")] + [F.count_if(ignored).alias(f"{prefix}_ignored")]

    level = C("reachability_level")
    reach = [F.count_if(level == "module").alias("module"), F.count_if(level == "unreachable").alias("unreachable"),
             F.count_if(level.isNull() | ~level.isin("module", "unreachable")).alias("unclassified")]
    out = projects.select("project_id")
    for rows in (per_active_run(iac, projects, *part("iac")), per_active_run(container, projects, *part("container"), *reach)):
        out = out.join(rows, "project_id", "left")
    return out.fillna(0)


def pr_stats(pulls: DataFrame, *, now: Column) -> DataFrame:
    week = F.timestamp_diff("SECOND", C("merged_at"), now) <= 7 * 86400
    return pulls.groupBy("project_id").agg(
        F.count_if(C("status") == "open").alias("open"), F.count_if(C("check_result") == "failed").alias("failed_checks"),
        F.count_if(C("check_result") == "passed").alias("passed_checks"), F.count_if((C("status") == "merged") & week).alias("merged_this_week"),
    )


def finding_timeline(events: DataFrame, *, now: Column, days: int = 30) -> DataFrame:
    """Detected and resolved events per project and day; days without events are absent."""
    recent = events.filter(C("created_at") >= now - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("project_id", C("created_at").cast("date").alias("day")).agg(
        F.count_if(C("event_type") == "detected").alias("detected"), F.count_if(C("event_type") == "resolved").alias("resolved"))


def population_status(deps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct direct packages per project by catalog status; a package the catalog lacks is pending."""
    direct = deps.filter(C("is_direct") & C("removed_at").isNull()).select("project_id", "dependency_id").distinct()
    status = catalog.select("dependency_id", "status", F.lit(True).alias("_known"))
    state = F.when(C("_known").isNull(), "pending").otherwise(C("status"))
    return direct.join(status, "dependency_id", "left").groupBy("project_id").agg(
        F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in ("ready", "analyzing", "pending", "error")])


def task_rollup(fixes: DataFrame) -> DataFrame:
    """State of a task from its fixes: working, completed, failed or completed_with_failures."""
    out = fixes.groupBy("task_id").agg(
        F.max("planned_fixes").alias("planned"), F.count("*").alias("total"), F.count_if(C("status") == "completed").alias("completed_fixes"),
        F.count_if(C("status").isin("failed", "rejected")).alias("failed_fixes"),
        F.count_if(C("status").isin("planning", "awaiting_approval", "approved", "executing")).alias("open_fixes"),
    )
    state = (
        F.when((C("open_fixes") > 0) | (C("total") < C("planned")), "working").when(C("failed_fixes") == 0, "completed")
        .when(C("completed_fixes") == 0, "failed").otherwise("completed_with_failures")
    )
    return out.withColumn("status", state)


def attack_surface(routes: DataFrame, key: list[str]) -> DataFrame:
    """Entry points by exposure; public includes unknown."""
    c = C("classification")
    return routes.groupBy(*key).agg(
        F.count_if(F.coalesce(~c.isin("AUTH_INTERNAL", "OFFLINE_WORKER"), F.lit(True))).alias("public"),
        F.count_if(c == "AUTH_INTERNAL").alias("authenticated"), F.count_if(c == "OFFLINE_WORKER").alias("background"))


def team_roster(teams: DataFrame, members: DataFrame, project_teams: DataFrame) -> DataFrame:
    people = members.groupBy("team_id").agg(F.count("*").alias("members"))
    owned = project_teams.groupBy("team_id").agg(F.count("*").alias("projects"))
    return teams.select("team_id", "name").join(people, "team_id", "left").join(owned, "team_id", "left").fillna(0, ["members", "projects"])


def policy_violations(deps: DataFrame, projects: DataFrame) -> DataFrame:
    """Blocked live packages with their licence score."""
    blocked = deps.filter(C("removed_at").isNull() & ~C("policy_allowed")).join(
        projects.select("project_id", C("name").alias("project_name"), "importance", "team_id"), "project_id")
    score = scores.license_depscore(F.array("policy_reason"), C("is_direct"), F.coalesce(C("environment") == "dev", F.lit(False)), C("importance"))
    return blocked.withColumn("depscore", score)


def commit_anomaly_rank(commits: DataFrame, anomalies: DataFrame, cleared: DataFrame, *, limit: int, offset: int = 0) -> DataFrame:
    """Commits per package by anomaly score (missing last), then newest; cleared commits left out."""
    from pyspark.sql import Window

    joined = commits.join(cleared.select("sha"), "sha", "left_anti").join(anomalies, "sha", "left")
    w = Window.partitionBy("package_id").orderBy(C("anomaly_score").desc_nulls_last(), C("committed_at").desc(), C("sha").asc())
    return joined.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= limit + offset).filter(C("rank") > offset)


def contributor_profile(commits: DataFrame) -> DataFrame:
    """Per author: means and deviations of change sizes, insert/delete ratio, and commits per hour of day."""
    per_hour = commits.groupBy("author_id", "commit_hour").agg(F.count("*").alias("n"))
    hours = per_hour.groupBy("author_id").agg(F.array_sort(F.collect_list(F.struct("commit_hour", "n"))).alias("h"))
    lines = C("insertions") + C("deletions")
    main = commits.groupBy("author_id").agg(
        F.count("*").alias("commits"), F.round(F.avg(lines), 4).alias("avg_lines"), F.round(F.stddev_pop(lines), 4).alias("std_lines"),
        F.round(F.avg("files_changed"), 4).alias("avg_files"), F.round(F.avg("message_length"), 4).alias("avg_message"),
        F.round(F.try_divide(F.sum("insertions"), F.sum("deletions")), 4).alias("insert_delete_ratio"),
    )
    shown = F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["commit_hour"].cast("string"), x["n"].cast("string"))), ",")
    return main.join(hours.select("author_id", shown.alias("hours")), "author_id")


def corpus_gates(cases: DataFrame) -> DataFrame:
    """Noise share and pass flags per ecosystem, plus the total row (ecosystem null)."""
    seen = C("observed") & C("observed_reachability").isNotNull()
    level = C("observed_reachability")
    missed = seen & (level == "unreachable") & C("expected_reachability").isin("confirmed", "data_flow", "function", "module")
    out = cases.rollup("ecosystem").agg(
        F.count("*").alias("ground_truth"), F.count_if(seen).alias("observed"), F.count_if(seen & (level == "unreachable")).alias("unreachable"),
        F.count_if(seen & (level == "module")).alias("module"), F.count_if(missed).alias("false_negatives"),
    )
    noise = F.when(C("observed") > 0, F.round((C("unreachable") * 2 + C("module")) * 50.0 / C("observed"), 2)).otherwise(0.0)
    return (
        out.withColumn("noise_reduction_pct", noise).withColumn("noise_ok", C("noise_reduction_pct") >= 60)
        .withColumn("silences_some", (C("observed") == 0) | (C("unreachable") > 0)).withColumn("no_false_negatives", C("false_negatives") == 0)
    )


def recall(cases: DataFrame) -> DataFrame:
    """Matched share of the labelled cases by repo, by ecosystem and in total."""
    repo, eco = C("repo"), C("ecosystem")
    out = cases.groupingSets([[repo], [eco], []], repo, eco).agg(
        F.count_if("observed").alias("matched"), F.count("*").alias("ground_truth"))
    return out.withColumn("recall_pct", F.round(C("matched") * 100.0 / C("ground_truth"), 2))
