"""Registered queries for project, team and organization roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import labels
from larkspur.operators import summaries as s
from larkspur.operators.filters import active_run
from larkspur.operators.sla import STATES
from larkspur.plans.common import instant, ledger_now, stamp
from larkspur.plans.domain import FINDINGS_NOW, LEDGER_NOW
from larkspur.plans.registry import query

C = F.col
TS = "'%Y-%m-%d %H:%M:%S'"


def act(table: str, alias: str = "f") -> str:
    return f"(SELECT {alias}0.* FROM {table} {alias}0 JOIN projects p0 ON p0.project_id = {alias}0.project_id AND p0.active_extraction_run_id = {alias}0.extraction_run_id) {alias}"


def bands(score: str, cond: str = "true") -> str:
    return (f"count(*) FILTER (WHERE {cond} AND {score} >= 90) AS c, count(*) FILTER (WHERE {cond} AND {score} >= 70 AND {score} < 90) AS h, "
            f"count(*) FILTER (WHERE {cond} AND {score} >= 40 AND {score} < 70) AS m, count(*) FILTER (WHERE {cond} AND {score} < 40) AS l")


OPEN = "status NOT IN ('ignored', 'resolved') AND NOT suppressed AND NOT risk_accepted"
IMPACT = "CASE vulnerability_type WHEN 'SQL Injection' THEN 10 WHEN 'Path Traversal' THEN 10 WHEN 'Cross Site Scripting (Stored)' THEN 4 WHEN 'Open Redirect' THEN 4 ELSE -8 END"
DAST_GROUPS = f"""dg AS (SELECT project_id, score FROM (SELECT *, row_number() OVER (PARTITION BY project_id, handler_file_path, family ORDER BY canon DESC, finding_id) AS rn FROM (
    SELECT d.project_id, d.handler_file_path, d.finding_id, CASE WHEN vulnerability_type = 'SQL Injection' OR message LIKE '%sqli%' THEN 'sqli' WHEN vulnerability_type LIKE 'Cross Site%' THEN 'output-injection' WHEN vulnerability_type = 'Path Traversal' THEN 'path-traversal' ELSE 'rule:' || lower(coalesce(rule_id, vulnerability_type)) END AS family,
      CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 ELSE 0 END + CASE WHEN vulnerability_type = 'SQL Injection' OR message LIKE '%sqli%' THEN 3 WHEN lower(vulnerability_type || message) LIKE '%stored%' THEN 2 ELSE 0 END AS canon,
      greatest(0, least(100, CASE WHEN kev THEN greatest(raw, 96) WHEN linked_sca_osv_id IS NOT NULL THEN greatest(raw, 90) ELSE raw END)) AS score
    FROM (SELECT *, CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 72 WHEN 'medium' THEN 48 WHEN 'low' THEN 26 WHEN 'info' THEN 10 ELSE 48 END + CASE confidence WHEN 'confirmed' THEN 10 WHEN 'high' THEN 6 WHEN 'low' THEN -12 ELSE 0 END + {IMPACT} AS raw FROM dast_findings) d
    WHERE status = 'open' AND NOT auto_ignored AND dast_run_id = (SELECT dast_run_id FROM dast_findings x WHERE x.project_id = d.project_id ORDER BY created_at DESC, finding_id DESC LIMIT 1))) WHERE rn = 1)"""
EFF = "coalesce(contextual_depscore, depscore, 0)"
NOT_SILENT = "NOT (auto_ignored AND runtime_confirmed_at IS NULL)"
IMAGES = f"""img AS (SELECT project_id, extraction_run_id, image_reference, true AS is_kev, coalesce(depscore, 0) AS score FROM container_findings WHERE is_kev AND {OPEN}
    UNION ALL SELECT project_id, extraction_run_id, image_reference, false, max(coalesce(depscore, 0)) FROM container_findings WHERE NOT is_kev AND {OPEN} GROUP BY 1, 2, 3)"""

SUMMARY = f"""{DAST_GROUPS}, {IMAGES},
  fam AS (SELECT project_id, {bands(EFF, OPEN + ' AND ' + NOT_SILENT)} FROM {act('findings')} GROUP BY 1
    UNION ALL SELECT project_id, count(*) FILTER (WHERE severity = 'CRITICAL'), count(*) FILTER (WHERE severity = 'HIGH'), count(*) FILTER (WHERE severity = 'MEDIUM'), count(*) FILTER (WHERE severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM') OR severity IS NULL) FROM {act('iac_findings')} WHERE {OPEN} AND NOT auto_ignored GROUP BY 1
    UNION ALL SELECT project_id, {bands('score')} FROM {act('img')} GROUP BY 1
    UNION ALL SELECT project_id, {bands('score')} FROM dg GROUP BY 1
    UNION ALL SELECT project_id, {bands('coalesce(depscore, 0)')} FROM {act('secret_findings')} WHERE status NOT IN ('ignored', 'resolved') GROUP BY 1
    UNION ALL SELECT project_id, {bands('coalesce(depscore, 0)')} FROM {act('semgrep_findings')} WHERE status NOT IN ('ignored', 'resolved') GROUP BY 1
    UNION ALL SELECT project_id, {bands("coalesce(depscore, CASE WHEN severity = 'critical' THEN 95 ELSE 0 END)")} FROM {act('malicious_findings')} WHERE {OPEN} GROUP BY 1
    UNION ALL SELECT project_id, {bands("(CASE WHEN vuln_class IN ('sql_injection', 'command_injection', 'deserialization') THEN 92 WHEN vuln_class IN ('xss', 'ssrf', 'path_traversal') THEN 78 ELSE 55 END)")} FROM {act('flows')}
      WHERE reachability_source = 'taint_engine' AND osv_id IS NULL AND NOT EXISTS (SELECT 1 FROM flow_suppressions z WHERE z.project_id = f.project_id AND z.flow_signature_hash = f.flow_signature_hash) GROUP BY 1),
  fsum AS (SELECT project_id, sum(c) AS c, sum(h) AS h, sum(m) AS m, sum(l) AS l FROM fam GROUP BY 1),
  vv AS (SELECT project_id, count(*) FILTER (WHERE status NOT IN ('ignored', 'resolved')) AS vuln_count, count(*) FILTER (WHERE status NOT IN ('ignored', 'resolved') AND severity = 'critical') AS critical_count,
    count(*) FILTER (WHERE status NOT IN ('ignored', 'resolved') AND is_reachable) AS reachable_count, max(depscore) FILTER (WHERE {OPEN} AND {NOT_SILENT}) AS worst_depscore,
    count(*) FILTER (WHERE status = 'ignored' OR suppressed OR risk_accepted OR (auto_ignored AND runtime_confirmed_at IS NULL)) AS ignored_count FROM {act('findings')} GROUP BY 1)"""


@query("agg1_security_summary", f"""
    WITH {SUMMARY} SELECT p.project_id, coalesce(vuln_count, 0) AS vuln_count, coalesce(critical_count, 0) AS critical_count, coalesce(reachable_count, 0) AS reachable_count, coalesce(worst_depscore, 0) AS worst_depscore,
      CAST(coalesce(c, 0) AS BIGINT) AS band_critical, CAST(coalesce(h, 0) AS BIGINT) AS band_high, CAST(coalesce(m, 0) AS BIGINT) AS band_medium, CAST(coalesce(l, 0) AS BIGINT) AS band_low, coalesce(ignored_count, 0) AS ignored_count,
      (SELECT count(*) FROM {act('semgrep_findings')} WHERE f.project_id = p.project_id) AS semgrep_count, (SELECT count(*) FROM {act('secret_findings')} WHERE f.project_id = p.project_id) AS secret_count,
      (SELECT count(*) FROM {act('secret_findings')} WHERE f.project_id = p.project_id AND is_verified) AS verified_secret_count, EXISTS (SELECT 1 FROM {act('container_findings')} WHERE f.project_id = p.project_id) AS has_container,
      EXISTS (SELECT 1 FROM dast_findings d WHERE d.project_id = p.project_id) AS has_dast, (SELECT strftime(max(completed_at), {TS}) FROM scan_jobs j WHERE j.project_id = p.project_id AND status = 'completed') AS last_scan_at
    FROM projects p LEFT JOIN vv USING (project_id) LEFT JOIN fsum USING (project_id)""")
def security_summary(v):
    out = s.security_summary(v.projects, v.findings, v.semgrep_findings, v.secret_findings, v.iac_findings, v.container_findings, v.dast_findings, v.malicious_findings, v.flows, v.flow_suppressions, v.scan_jobs)
    return out.withColumn("last_scan_at", stamp("last_scan_at"))


@query("agg2_band_counts", f"SELECT project_id, {bands('coalesce(depscore, 0)')} FROM findings GROUP BY 1".replace(" AS c,", " AS band_critical,").replace(" AS h,", " AS band_high,").replace(" AS m,", " AS band_medium,").replace(" AS l ", " AS band_low "))
def _(v):
    return v.findings.groupBy("project_id").agg(*s.band_counts(labels.score_band(C("depscore"))))


@query("agg3_container_image_groups", f"WITH {IMAGES} SELECT project_id, extraction_run_id, image_reference, is_kev, score FROM img")
def _(v):
    return s.container_image_groups(v.container_findings)


SHOWN = ", ".join(f"count(*) FILTER (WHERE NOT suppressed AND severity = '{x}') AS vuln_{x}" for x in s.BANDS)
SLA_SHOWN = ", ".join(f"count(*) FILTER (WHERE NOT suppressed AND sla_status = '{x}') AS sla_{x}" for x in STATES)
SLA_ALL = ", ".join(f"count(*) FILTER (WHERE sla_status = '{x}') AS sla_{x}" for x in STATES)
FACT_COLS = ["vuln_total", *[f"vuln_{x}" for x in s.BANDS], "reachable_count", *[f"sla_{x}" for x in STATES], "deps_vulnerable"]
DEP_COLS = ["deps_total", "deps_direct", "deps_transitive", "deps_outdated", "deps_compliant", "deps_failing"]


@query("agg4_project_stats", f"""
    WITH x AS (SELECT project_id, count(*) FILTER (WHERE NOT suppressed) AS vuln_total, {SHOWN}, count(*) FILTER (WHERE NOT suppressed AND is_reachable) AS reachable_count, {SLA_SHOWN}, count(DISTINCT project_dependency_id) FILTER (WHERE NOT suppressed) AS deps_vulnerable FROM {act('findings')} GROUP BY 1),
    d AS (SELECT project_id, count(*) AS deps_total, count(*) FILTER (WHERE is_direct) AS deps_direct, count(*) FILTER (WHERE NOT is_direct) AS deps_transitive, count(*) FILTER (WHERE is_outdated) AS deps_outdated, count(*) FILTER (WHERE policy_allowed) AS deps_compliant, count(*) FILTER (WHERE NOT policy_allowed) AS deps_failing
      FROM project_dependencies WHERE removed_at IS NULL GROUP BY 1)
    SELECT p.project_id, {', '.join(f'coalesce(x.{c}, 0) AS {c}' for c in FACT_COLS)}, {', '.join(f'coalesce(d.{c}, 0) AS {c}' for c in DEP_COLS)} FROM projects p LEFT JOIN x USING (project_id) LEFT JOIN d USING (project_id)""")
def _(v):
    return s.project_stats(v.findings, v.project_dependencies, v.projects)


@query("agg5_team_stats", f"SELECT p.team_id, count(*) FILTER (WHERE NOT suppressed) AS vuln_total, {SHOWN}, {SLA_ALL} FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id GROUP BY 1")
def _(v):
    return s.team_stats(v.findings, v.projects)


def pct(part, whole):
    return f"CASE WHEN {whole} > 0 THEN CAST(floor({part} * 100.0 / {whole} + 0.5) AS BIGINT) ELSE 100 END"


@query("agg6_org_stats", f"""
    WITH h AS (SELECT organization_id, count(*) AS projects, count(*) FILTER (WHERE health_score >= 80) AS healthy, count(*) FILTER (WHERE health_score >= 50 AND health_score < 80) AS at_risk, count(*) FILTER (WHERE health_score < 50) AS critical_health, count(*) FILTER (WHERE is_passing) AS passing FROM projects GROUP BY 1),
    x AS (SELECT p.organization_id, count(*) FILTER (WHERE NOT suppressed) AS vuln_total, {SHOWN}, {SLA_ALL} FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id GROUP BY 1)
    SELECT h.*, {', '.join(f'coalesce(x.{c}, 0) AS {c}' for c in ['vuln_total', *[f'vuln_{b}' for b in s.BANDS], *[f'sla_{b}' for b in STATES]])},
      (SELECT count(*) FROM {act('semgrep_findings')} JOIN projects p ON p.project_id = f.project_id WHERE p.organization_id = h.organization_id) AS semgrep_total,
      (SELECT count(*) FROM {act('secret_findings')} JOIN projects p ON p.project_id = f.project_id WHERE p.organization_id = h.organization_id) AS secret_total,
      (SELECT count(*) FROM project_dependencies d JOIN projects p USING (project_id) WHERE p.organization_id = h.organization_id AND removed_at IS NULL) AS dependencies_total,
      (SELECT count(*) FROM scan_jobs j WHERE j.organization_id = h.organization_id AND job_type = 'extraction' AND status IN ('queued', 'processing')) AS syncing, (SELECT count(*) FROM org_members m WHERE m.organization_id = h.organization_id) AS members,
      {pct('passing', 'projects')} AS compliance_percent, {pct('coalesce(sla_met, 0)', '(coalesce(sla_met, 0) + coalesce(sla_resolved_late, 0))')} AS sla_compliance_percent FROM h LEFT JOIN x USING (organization_id)""")
def _(v):
    return s.org_stats(v.projects, v.findings, v.semgrep_findings, v.secret_findings, v.project_dependencies, v.scan_jobs, v.org_members)


@query("agg7_health_score", f"""
    WITH d AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE coalesce(policy_allowed, true)) AS good, count(is_outdated) AS known, count(*) FILTER (WHERE is_outdated) AS old FROM project_dependencies WHERE removed_at IS NULL GROUP BY 1),
    v AS (SELECT project_id, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 1 ELSE 0 END) AS pen FROM {act('findings')} WHERE NOT suppressed GROUP BY 1),
    g AS (SELECT project_id, count(*) AS k FROM {act('semgrep_findings')} GROUP BY 1), t AS (SELECT project_id, count(*) AS k FROM {act('secret_findings')} WHERE is_verified GROUP BY 1)
    SELECT p.project_id, CAST(greatest(0, least(100, floor(CASE WHEN n IS NULL THEN 100e0 ELSE good * 100e0 / n END * 0.4e0 + greatest(0, 100 - coalesce(pen, 0)) * 0.3e0 + CASE WHEN n IS NULL THEN 100e0 WHEN known = 0 THEN 80e0 ELSE (n - old) * 100e0 / n END * 0.2e0
      + greatest(0, 100 - coalesce(g.k, 0) * 5 - coalesce(t.k, 0) * 10) * 0.1e0 + 0.5))) AS BIGINT) AS health_score FROM projects p LEFT JOIN d USING (project_id) LEFT JOIN v USING (project_id) LEFT JOIN g USING (project_id) LEFT JOIN t USING (project_id)""")
def _(v):
    return s.health_score(v.projects, v.findings, v.project_dependencies, v.semgrep_findings, v.secret_findings)


DEBT = f"""pts AS (SELECT project_id, CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS w FROM {act('findings')} WHERE NOT suppressed AND NOT risk_accepted
    UNION ALL SELECT project_id, CASE WHEN NOT policy_allowed THEN 3 ELSE 0 END + CASE WHEN is_outdated THEN 1 ELSE 0 END FROM project_dependencies WHERE removed_at IS NULL
    UNION ALL SELECT project_id, CASE WHEN severity = 'critical' THEN 5 ELSE 0 END FROM {act('semgrep_findings')}
    UNION ALL SELECT project_id, 5 FROM {act('secret_findings')} WHERE is_current UNION ALL SELECT project_id, 0 FROM projects)"""


@query("agg8_debt_score", f"WITH {DEBT.replace('SELECT project_id, CASE WHEN NOT', 'SELECT project_id, CASE WHEN NOT coalesce(policy_allowed, true) THEN 3 WHEN false AND NOT')} SELECT p.organization_id, p.project_id, least(1000e0, CAST(sum(w) AS DOUBLE)) AS score FROM pts JOIN projects p USING (project_id) GROUP BY GROUPING SETS ((p.organization_id, p.project_id), (p.organization_id))")
def _(v):
    return s.debt_score(v.projects, v.findings, v.project_dependencies, v.semgrep_findings, v.secret_findings)


@query("agg9_debt_snapshot", f"WITH {DEBT.replace('SELECT project_id, CASE WHEN NOT', 'SELECT project_id, CASE WHEN NOT coalesce(policy_allowed, true) THEN 3 WHEN false AND NOT')} SELECT '2001-12-01' AS snapshot_date, p.organization_id, p.project_id, least(1000e0, CAST(sum(w) AS DOUBLE)) AS score FROM pts JOIN projects p USING (project_id) GROUP BY GROUPING SETS ((p.organization_id, p.project_id), (p.organization_id))")
def _(v):
    out = s.debt_snapshot(v.projects, v.findings, v.project_dependencies, v.semgrep_findings, v.secret_findings, day="2001-12-01")
    return out.withColumn("snapshot_date", C("snapshot_date").cast("string"))


TOP = """t AS (SELECT f.*, p.organization_id FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id WHERE NOT suppressed)"""


@query("win1_top_vulns", f"""
    WITH {TOP}, a AS (SELECT osv_id, count(DISTINCT project_id) AS affected_project_count FROM t GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY osv_id ORDER BY depscore DESC NULLS LAST, project_id, severity) AS rn FROM t WHERE severity IN ('critical', 'high'))
    SELECT osv_id, depscore, severity, project_id AS worst_project_id, affected_project_count FROM r JOIN a USING (osv_id) WHERE rn = 1 ORDER BY depscore DESC NULLS LAST, osv_id LIMIT 5""")
def _(v):
    return s.top_vulns(v.findings, v.projects)


@query("win1_top_vulns_by_org", f"""
    WITH {TOP}, a AS (SELECT organization_id, osv_id, count(DISTINCT project_id) AS affected_project_count FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY organization_id, osv_id ORDER BY depscore DESC NULLS LAST, project_id, severity) AS rn FROM t WHERE severity IN ('critical', 'high'))
    SELECT * FROM (SELECT organization_id, osv_id, depscore, severity, project_id AS worst_project_id, affected_project_count FROM r JOIN a USING (organization_id, osv_id) WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY depscore DESC NULLS LAST, osv_id) <= 5)""")
def _(v):
    return s.top_vulns(v.findings, v.projects, group="organization_id")


@query("agg29_run_list", f"""
    SELECT project_id, run_id, strftime(started_at, {TS}) AS started_at FROM (SELECT project_id, run_id, min(created_at) AS started_at FROM scan_jobs GROUP BY 1, 2 HAVING NOT bool_or(job_type = 'fix')) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) <= 20""")
def _(v):
    return s.run_list(v.scan_jobs).select("project_id", "run_id", stamp("started_at"))


@query("agg30_failure_rate", f"""
    SELECT *, recent_runs < 5 OR failure_pct < 5 AS should_run FROM (SELECT *, CASE WHEN recent_runs > 0 THEN round(recent_failures * 100e0 / recent_runs, 4) ELSE 0e0 END AS failure_pct FROM (SELECT organization_id, count(*) FILTER (WHERE created_at > TIMESTAMP '{LEDGER_NOW}' - INTERVAL 30 DAY) AS recent_runs,
      count(*) FILTER (WHERE created_at > TIMESTAMP '{LEDGER_NOW}' - INTERVAL 30 DAY AND status = 'failed') AS recent_failures FROM scan_jobs GROUP BY 1))""")
def _(v):
    return s.failure_rate(v.scan_jobs, ["organization_id"], now=ledger_now(), minutes=30 * 1440)


@query("agg32_running_snapshot", """
    SELECT organization_id, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'processing') AS inflight, (SELECT count(DISTINCT machine_id) FROM scan_jobs WHERE job_type = 'extraction' AND status = 'processing') AS machines
    FROM scan_jobs WHERE job_type = 'extraction' AND status IN ('queued', 'processing') GROUP BY 1""")
def _(v):
    machines, load = s.running_snapshot(v.scan_jobs, "extraction")
    return load.withColumn("machines", machines.agg(F.count("*")).scalar())


SCAN = ", ".join(f"count(*) FILTER (WHERE status <> 'ignored' AND severity = '{x.upper()}') AS {{p}}_{x}" for x in (*s.BANDS, "info")) + ", count(*) FILTER (WHERE status = 'ignored') AS {p}_ignored"
SCAN_COLS = [f"{p}_{x}" for p in ("iac", "container") for x in (*s.BANDS, "info", "ignored")] + ["module", "unreachable", "unclassified"]


@query("agg33_scanner_rollup", f"""
    WITH i AS (SELECT project_id, {SCAN.format(p='iac')} FROM {act('iac_findings')} GROUP BY 1), c AS (SELECT project_id, {SCAN.format(p='container')}, count(*) FILTER (WHERE reachability_level = 'module') AS module, count(*) FILTER (WHERE reachability_level = 'unreachable') AS unreachable, count(*) FILTER (WHERE reachability_level IS NULL) AS unclassified FROM {act('container_findings')} GROUP BY 1)
    SELECT p.project_id, {', '.join(f'coalesce({x}, 0) AS {x}' for x in SCAN_COLS)} FROM projects p LEFT JOIN i USING (project_id) LEFT JOIN c USING (project_id)""")
def _(v):
    return s.scanner_rollup(v.iac_findings, v.container_findings, v.projects)


@query("agg36_pr_stats", f"""
    SELECT project_id, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE check_result = 'failed') AS failed_checks, count(*) FILTER (WHERE check_result = 'passed') AS passed_checks, count(*) FILTER (WHERE status = 'merged' AND merged_at >= TIMESTAMP '{LEDGER_NOW}' - INTERVAL 7 DAY) AS merged_this_week FROM pull_requests GROUP BY 1""")
def _(v):
    return s.pr_stats(v.pull_requests, now=ledger_now())


@query("agg20_finding_timeline", f"""
    SELECT project_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE event_type = 'detected') AS detected, count(*) FILTER (WHERE event_type = 'resolved') AS resolved FROM finding_events WHERE created_at >= TIMESTAMP '{FINDINGS_NOW}' - INTERVAL 90 DAY GROUP BY 1, 2""")
def _(v):
    return s.finding_timeline(v.finding_events, now=instant(FINDINGS_NOW), days=90).withColumn("day", C("day").cast("string"))


@query("agg39_corpus_gates", """
    SELECT *, noise_reduction_pct >= 60 AS noise_ok, observed = 0 OR unreachable > 0 AS silences_some, false_negatives = 0 AS no_false_negatives FROM (SELECT *, CASE WHEN observed > 0 THEN round((unreachable + 0.5e0 * module) / observed * 100, 2) ELSE 0e0 END AS noise_reduction_pct FROM (
      SELECT ecosystem, count(*) AS ground_truth, count(*) FILTER (WHERE observed) AS observed, count(*) FILTER (WHERE observed_reachability = 'unreachable') AS unreachable, count(*) FILTER (WHERE observed_reachability = 'module') AS module,
      count(*) FILTER (WHERE observed_reachability = 'unreachable' AND expected_reachability <> 'unreachable') AS false_negatives FROM corpus GROUP BY ROLLUP (ecosystem)))""")
def _(v):
    return s.corpus_gates(v.corpus)


@query("agg40_recall", "SELECT repo, ecosystem, count(*) FILTER (WHERE observed) AS matched, count(*) AS ground_truth, round(count(*) FILTER (WHERE observed) * 100e0 / count(*), 2) AS recall_pct FROM corpus GROUP BY GROUPING SETS ((repo), (ecosystem), ())")
def _(v):
    return s.recall(v.corpus)


@query("agg44_contributor_profile", """
    WITH h AS (SELECT author_id, string_agg(CAST(commit_hour AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY commit_hour) AS hours FROM (SELECT author_id, commit_hour, count(*) AS n FROM commits GROUP BY 1, 2) GROUP BY 1)
    SELECT author_id, count(*) AS commits, round(avg(insertions + deletions), 4) AS avg_lines, round(stddev_pop(insertions + deletions), 4) AS std_lines, round(avg(files_changed), 4) AS avg_files, round(avg(message_length), 4) AS avg_message,
      round(sum(insertions) / nullif(sum(deletions), 0), 4) AS insert_delete_ratio, any_value(hours) AS hours FROM commits JOIN h USING (author_id) GROUP BY 1""")
def _(v):
    return s.contributor_profile(v.commits)


@query("agg46_population_status", """
    SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'analyzing') AS analyzing, count(*) FILTER (WHERE known IS NULL OR status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error
    FROM (SELECT DISTINCT project_id, dependency_id FROM project_dependencies WHERE is_direct AND removed_at IS NULL) d LEFT JOIN (SELECT dependency_id, status, 1 AS known FROM dependencies WHERE license IS NOT NULL) c USING (dependency_id) GROUP BY 1""")
def _(v):
    return s.population_status(v.project_dependencies, v.dependencies.filter(C("license").isNotNull()))


@query("agg47_task_rollup", """
    SELECT *, CASE WHEN open_fixes > 0 OR total < planned THEN 'working' WHEN failed_fixes = 0 THEN 'completed' WHEN completed_fixes = 0 THEN 'failed' ELSE 'completed_with_failures' END AS status FROM (SELECT task_id, max(planned_fixes) AS planned, count(*) AS total,
      count(*) FILTER (WHERE status = 'completed') AS completed_fixes, count(*) FILTER (WHERE status IN ('failed', 'rejected')) AS failed_fixes, count(*) FILTER (WHERE status = 'executing') AS open_fixes FROM fix_tasks GROUP BY 1)""")
def _(v):
    return s.task_rollup(v.fix_tasks)


@query("agg48_attack_surface", "SELECT framework, count(*) FILTER (WHERE classification NOT IN ('AUTH_INTERNAL', 'OFFLINE_WORKER')) AS public, count(*) FILTER (WHERE classification = 'AUTH_INTERNAL') AS authenticated, count(*) FILTER (WHERE classification = 'OFFLINE_WORKER') AS background FROM routes GROUP BY 1")
def _(v):
    return s.attack_surface(v.routes, ["framework"])


@query("agg49_team_roster", "SELECT t.team_id, t.name, (SELECT count(*) FROM team_members m WHERE m.team_id = t.team_id) AS members, (SELECT count(*) FROM project_teams x WHERE x.team_id = t.team_id) AS projects FROM teams t")
def _(v):
    return s.team_roster(v.teams, v.team_members, v.project_teams)


VIOLATIONS = """viol AS (SELECT d.project_dependency_id, p.name AS project_name, p.team_id, CAST(least(100, floor(CASE policy_reason WHEN 'Package flagged as malicious' THEN 95 WHEN 'AGPL not allowed' THEN 80 WHEN 'copyleft' THEN 70 WHEN 'Banned license' THEN 75 WHEN 'unknown license' THEN 50 ELSE 55 END
    * CASE WHEN is_direct THEN 1e0 ELSE 0.75e0 END * CASE WHEN environment = 'dev' THEN 0.4e0 ELSE 1e0 END * importance + 0.5)) AS BIGINT) AS depscore FROM project_dependencies d JOIN projects p USING (project_id) WHERE removed_at IS NULL AND NOT policy_allowed)"""


@query("agg50_policy_violations", f"WITH {VIOLATIONS} SELECT project_dependency_id, project_name, depscore FROM viol")
def _(v):
    return s.policy_violations(v.project_dependencies, v.projects).select("project_dependency_id", "project_name", "depscore")


@query("win9_newest_run_scope", "SELECT finding_id, project_id FROM dast_findings d WHERE dast_run_id = (SELECT dast_run_id FROM dast_findings x WHERE x.project_id = d.project_id ORDER BY created_at DESC, finding_id DESC LIMIT 1)")
def _(v):
    return s.newest_run_scope(v.dast_findings).select("finding_id", "project_id")


@query("win10_commit_anomaly_rank", """
    SELECT package_id, sha, rank FROM (SELECT package_id, c.sha, row_number() OVER (PARTITION BY package_id ORDER BY anomaly_score DESC NULLS LAST, committed_at DESC, c.sha) AS rank FROM commits c LEFT JOIN commit_anomalies a USING (sha) WHERE c.files_changed <> 7) WHERE rank <= 30 AND rank > 10""")
def _(v):
    cleared = v.commits.filter(C("files_changed") == 7)
    return s.commit_anomaly_rank(v.commits, v.commit_anomalies, cleared, limit=20, offset=10).select("package_id", "sha", C("rank").cast("long").alias("rank"))
