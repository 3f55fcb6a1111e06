"""Registered queries for matching and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import packages
from larkspur.operators import matching
from larkspur.operators.filters import active_run
from larkspur.plans.common import findings_now, listing, stamp
from larkspur.plans.domain import FINDINGS_NOW
from larkspur.plans.registry import query

C = F.col
TS = "'%Y-%m-%d %H:%M:%S'"


def advisories(v):
    """Advisories with their range as an array of intervals."""
    interval = F.array(F.struct("introduced", "fixed"))
    return v.advisories.withColumn("ranges", F.when(~C("ranges_missing"), interval))


KEY = r"""(CASE WHEN {c} IS NULL OR {c} = 'latest' THEN NULL ELSE [TRY_CAST(split_part(regexp_replace({c}, '-.*', ''), '.', 1) AS BIGINT),
 TRY_CAST(split_part(regexp_replace({c}, '-.*', ''), '.', 2) AS BIGINT), TRY_CAST(split_part(regexp_replace({c}, '-.*', ''), '.', 3) AS BIGINT)] END)"""
AFFECTED = f"""affected AS (
    SELECT v.version_id, v.dependency_id, v.version, a.advisory_id, a.osv_id, a.severity FROM dependency_versions v JOIN advisories a ON a.dependency_id = v.dependency_id
    WHERE a.ranges_missing OR ({KEY.format(c='v.version')} IS NOT NULL AND (({KEY.format(c='v.version')} >= {KEY.format(c='a.introduced')} AND (a.fixed IS NULL OR {KEY.format(c='v.version')} < {KEY.format(c='a.fixed')}))
      OR (a.versions IS NOT NULL AND {KEY.format(c='a.versions[1]')} = {KEY.format(c='v.version')}))))"""
NORM = "CASE WHEN {e} = 'pypi' THEN regexp_replace(lower({n}), '[-_.]+', '-', 'g') ELSE lower({n}) END"


@query("jn1_attach_advisories", f"""
    WITH d AS (SELECT project_id, name, version, ecosystem, min(project_dependency_id) FILTER (WHERE environment IS DISTINCT FROM 'dev') AS prod, min(project_dependency_id) AS any_id FROM project_dependencies GROUP BY ALL),
    e AS (SELECT project_id, name, version, coalesce(prod, any_id) AS pd FROM d),
    n AS (SELECT project_id, {NORM.format(e='ecosystem', n='name')} AS name, version, coalesce(min(prod), min(any_id)) AS pd FROM d GROUP BY ALL)
    SELECT hit_id, CASE WHEN e1.pd IS NOT NULL THEN 1 WHEN e2.pd IS NOT NULL THEN 2 WHEN e3.pd IS NOT NULL THEN 3 ELSE 4 END AS rung, coalesce(e1.pd, e2.pd, e3.pd, n.pd) AS project_dependency_id
    FROM vdr_hits h LEFT JOIN e e1 ON e1.project_id = h.project_id AND e1.version = h.version AND e1.name = h.ref_name
    LEFT JOIN e e2 ON e2.project_id = h.project_id AND e2.version = h.version AND h.ref_name LIKE '%/%' AND e2.name = replace(h.ref_name, '/', ':')
    LEFT JOIN e e3 ON e3.project_id = h.project_id AND e3.version = h.version AND h.ref_name LIKE '%/%' AND e3.name = split_part(h.ref_name, '/', -1)
    LEFT JOIN n ON n.project_id = h.project_id AND n.version = h.version AND n.name = {NORM.format(e='h.ecosystem', n='h.ref_name')}
    WHERE coalesce(e1.pd, e2.pd, e3.pd, n.pd) IS NOT NULL""")
def _(v):
    return matching.attach_advisories(v.vdr_hits, v.project_dependencies).select("hit_id", "rung", "project_dependency_id")


@query("jn2_prefer_prod_scope", """
    SELECT project_id, dependency_id, scope_row_id, environment FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dependency_id ORDER BY CASE WHEN environment = 'dev' THEN 1 ELSE 0 END, scope_row_id) AS rn FROM scopes) WHERE rn = 1""")
def _(v):
    return matching.prefer_prod_scope(v.scopes, ["project_id", "dependency_id"], "scope_row_id").select("project_id", "dependency_id", "scope_row_id", "environment")


@query("jn3_affected_versions", f"WITH {AFFECTED} SELECT version_id, advisory_id FROM affected")
def _(v):
    return matching.affected_versions(v.dependency_versions, advisories(v)).select("version_id", "advisory_id")


@query("jn4_is_fixed", f"""
    SELECT f.finding_id, coalesce({KEY.format(c='d.version')} IS NOT NULL AND f.fixed_versions IS NOT NULL AND ({KEY.format(c='d.version')} >= {KEY.format(c='f.fixed_versions[1]')} OR {KEY.format(c='d.version')} >= {KEY.format(c='f.fixed_versions[2]')}), false) AS fixed
    FROM findings f JOIN project_dependencies d USING (project_dependency_id)""")
def _(v):
    f = v.findings.select("finding_id", "project_dependency_id", "fixed_versions").join(v.project_dependencies.select("project_dependency_id", "version"), "project_dependency_id")
    return f.select("finding_id", matching.is_fixed(C("version"), C("fixed_versions")).alias("fixed"))


FEED = """feed AS (SELECT feed_id, source_id, CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang' WHEN 'gem' THEN 'rubygems' WHEN 'packagist' THEN 'composer' WHEN 'crates.io' THEN 'cargo' ELSE ecosystem END AS eco,
    package_name, version, vulnerable_range, withdrawn_at, coalesce(severity, 'critical') AS severity FROM malware_feed)"""
CANON = "CASE WHEN {e} = 'pypi' THEN regexp_replace(lower({n}), '[-_.]+', '-', 'g') WHEN {e} IN ('npm', 'nuget', 'composer', 'cargo') THEN lower({n}) ELSE {n} END"


@query("jn5_match_malware_feed", f"""
    WITH {FEED} SELECT d.project_dependency_id, f.feed_id, f.severity FROM project_dependencies d JOIN feed f ON f.eco = d.ecosystem AND {CANON.format(e='f.eco', n='f.package_name')} = {CANON.format(e='d.ecosystem', n='d.name')}
    WHERE f.withdrawn_at IS NULL AND CASE WHEN f.eco = 'npm' AND f.vulnerable_range IS NOT NULL
      THEN f.vulnerable_range LIKE '>=%' AND d.version <> 'latest' AND {KEY.format(c='d.version')} >= {KEY.format(c="regexp_extract(f.vulnerable_range, '>= ([0-9.]+)', 1)")} AND {KEY.format(c='d.version')} < {KEY.format(c="regexp_extract(f.vulnerable_range, '< ([0-9.]+)', 1)")}
      ELSE f.version IS NOT NULL AND replace(split_part(f.version, '+', 1), 'v', '') = CASE d.ecosystem WHEN 'pypi' THEN replace(d.version, '-', '') WHEN 'maven' THEN replace(d.version, '-b', '.b') ELSE d.version END END""")
def _(v):
    return matching.match_malware_feed(v.project_dependencies, v.malware_feed).select("project_dependency_id", "feed_id", "severity")


@query("jn6_match_unique_artifact", f"""
    WITH {FEED}, u AS (SELECT split_part(package_name, ':', 2) AS artifact, min(package_name) AS coordinate FROM feed WHERE eco = 'maven' GROUP BY 1 HAVING count(DISTINCT package_name) = 1)
    SELECT d.project_dependency_id, f.feed_id FROM project_dependencies d JOIN u ON u.artifact = split_part(d.name, ':', 2) JOIN feed f ON f.package_name = u.coordinate AND f.eco = 'maven'
    WHERE d.ecosystem = 'maven' AND f.withdrawn_at IS NULL AND f.version IS NOT NULL AND replace(split_part(f.version, '+', 1), 'v', '') = replace(d.version, '-b', '.b')""")
def _(v):
    bare = v.project_dependencies.withColumn("name", F.element_at(F.split("name", ":"), -1))
    return matching.match_unique_artifact(bare.filter(C("ecosystem") == "maven"), v.malware_feed).select("project_dependency_id", "feed_id")


@query("jn7_enrich_threat", """
    SELECT f.finding_id, coalesce(f.osv_id IN (SELECT cve_id FROM kev) OR (f.aliases IS NOT NULL AND f.aliases[1] IN (SELECT cve_id FROM kev)), false) AS cisa_kev, coalesce(f.epss_score, e.epss) AS epss_score
    FROM findings f LEFT JOIN epss e ON e.cve_id = f.osv_id""")
def _(v):
    return matching.enrich_threat(v.findings, v.kev, v.epss).select("finding_id", "cisa_kev", "epss_score")


@query("jn17_as_of_baseline", f"""
    SELECT d.dependency_id AS package_id, strftime(s.observed_at, {TS}) AS base_observed_at, s.snapshot_id AS base_snapshot_id FROM dependencies d LEFT JOIN
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, snapshot_id DESC) AS rn FROM maintainer_snapshots WHERE observed_at < TIMESTAMP '{FINDINGS_NOW}' - INTERVAL 300 DAY) WHERE rn = 1) s ON s.package_id = d.dependency_id""")
def _(v):
    out = matching.as_of_baseline(v.dependencies.select(C("dependency_id").alias("package_id")), v.maintainer_snapshots, now=findings_now(), lag_days=300)
    return out.select("package_id", stamp("base_observed_at"), "base_snapshot_id")


@query("jn18_latest_snapshot", f"""
    SELECT package_id, strftime(observed_at, {TS}) AS observed_at, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, snapshot_id DESC) AS rn FROM maintainer_snapshots) WHERE rn = 1""")
def _(v):
    return matching.latest_snapshot(v.maintainer_snapshots, ["package_id"], "observed_at", "snapshot_id").select("package_id", stamp("observed_at"), "snapshot_id")


@query("scl18_maintainer_signals", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, snapshot_id DESC) AS rn FROM maintainer_snapshots),
    b AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, snapshot_id DESC) AS rn FROM maintainer_snapshots WHERE observed_at < TIMESTAMP '{FINDINGS_NOW}' - INTERVAL 300 DAY),
    first_seen AS (SELECT package_id, min(observed_at) AS t FROM maintainer_snapshots GROUP BY 1),
    j AS (SELECT r.package_id, date_diff('day', f.t, TIMESTAMP '{FINDINGS_NOW}') AS age, r.postinstall_hash IS NOT NULL AS hook,
       coalesce(b.primary_maintainer_email <> r.primary_maintainer_email, false) AS email, b.package_id IS NOT NULL AND list_sort(list_distinct(b.maintainer_handles)) <> list_sort(list_distinct(r.maintainer_handles)) AS owner,
       coalesce(b.signing_config_hash <> r.signing_config_hash, false) AS signing, b.package_id IS NOT NULL AND b.postinstall_hash IS NULL AND r.postinstall_hash IS NOT NULL AS posthook
       FROM r JOIN first_seen f USING (package_id) LEFT JOIN b ON b.package_id = r.package_id AND b.rn = 1 WHERE r.rn = 1)
    SELECT package_id, CASE WHEN age < 30 AND hook THEN 'maintainer:new_account_with_install_script' WHEN email AND posthook THEN 'maintainer:email_changed_with_new_postinstall' WHEN owner AND posthook THEN 'maintainer:maintainer_changed_with_new_postinstall'
      WHEN posthook THEN 'maintainer:new_postinstall_added' WHEN signing THEN 'maintainer:signing_setup_changed' WHEN email THEN 'maintainer:email_changed' WHEN owner THEN 'maintainer:maintainer_changed' WHEN age < 30 THEN 'maintainer:new_account' END AS signal_rule,
      CASE WHEN (age < 30 AND hook) OR (email AND posthook) OR (owner AND posthook) THEN 'critical' WHEN posthook OR signing THEN 'high' WHEN email OR owner OR age < 30 THEN 'medium' END AS signal_severity FROM j""")
def _(v):
    current = matching.latest_snapshot(v.maintainer_snapshots, ["package_id"], "observed_at", "snapshot_id")
    created = v.maintainer_snapshots.groupBy("package_id").agg(F.min("observed_at").alias("package_created_at"))
    rows = matching.as_of_baseline(current.join(created, "package_id"), v.maintainer_snapshots, now=findings_now(), lag_days=300)
    return matching.maintainer_signals(rows, now=findings_now()).select("package_id", "signal_rule", "signal_severity")


@query("jn19_allowlist_apply", """
    SELECT finding_id, allowlist_id FROM (SELECT m.finding_id, a.allowlist_id, row_number() OVER (PARTITION BY m.finding_id ORDER BY a.version IS NULL, a.added_at DESC, a.allowlist_id DESC) AS rn
      FROM malicious_findings m JOIN projects p USING (project_id) JOIN project_dependencies d ON d.project_id = m.project_id AND d.dependency_id = m.dependency_id
      JOIN malicious_allowlist a ON a.organization_id = p.organization_id AND a.package_name = d.name AND a.ecosystem = d.ecosystem AND a.revoked_at IS NULL AND (a.version IS NULL OR a.version = d.version) WHERE NOT m.suppressed) WHERE rn = 1""")
def _(v):
    return matching.allowlist_apply(v.malicious_findings, v.project_dependencies, v.projects, v.malicious_allowlist).select("finding_id", "allowlist_id")


@query("jn20_is_malicious", f"""
    WITH {FEED} SELECT d.dependency_id, EXISTS (SELECT 1 FROM malicious_findings m WHERE m.dependency_id = d.dependency_id AND NOT suppressed AND NOT risk_accepted AND status NOT IN ('ignored', 'resolved'))
      OR EXISTS (SELECT 1 FROM feed f WHERE f.eco = d.ecosystem AND f.package_name = d.name AND f.withdrawn_at IS NULL) AS is_malicious FROM dependencies d""")
def _(v):
    return matching.is_malicious(v.dependencies, v.malicious_findings, v.malware_feed).select("dependency_id", "is_malicious")


@query("jn21_project_findings_view", """
    SELECT f.finding_id, CASE WHEN d.namespace LIKE '@%' THEN d.namespace || '/' || d.name ELSE d.name END AS dependency_name, d.version FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id
    JOIN project_dependencies d ON d.project_dependency_id = f.project_dependency_id""")
def _(v):
    return matching.project_findings_view(v.findings, v.project_dependencies, v.projects).select("finding_id", "dependency_name", "version")


@query("jn22_catalog_findings_view", "SELECT a.advisory_id, d.project_dependency_id FROM advisories a JOIN project_dependencies d ON d.dependency_id = a.dependency_id")
def _(v):
    return matching.catalog_findings_view(v.advisories, v.project_dependencies).select("advisory_id", "project_dependency_id")


@query("jn23_with_names", "SELECT finding_id, p.name AS project_name, d.name AS dependency_name FROM findings f LEFT JOIN projects p USING (project_id) LEFT JOIN dependencies d ON d.dependency_id = f.dependency_id")
def _(v):
    f = matching.with_names(v.findings, v.projects, "project_id", "name", "project_name")
    return matching.with_names(f, v.dependencies, "dependency_id", "name", "dependency_name").select("finding_id", "project_name", "dependency_name")


@query("jn25_effective_policy", """
    SELECT f.finding_id, s.max_hours, s.warning_threshold_percent FROM findings f JOIN projects p USING (project_id) JOIN sla_policies s ON s.organization_id = p.organization_id AND s.severity = f.severity WHERE s.enabled""")
def _(v):
    from larkspur.operators.sla import effective_policy

    return effective_policy(v.findings, v.projects, v.sla_policies).select("finding_id", "max_hours", "warning_threshold_percent")


@query("jn30_banned_versions", """
    WITH w AS (SELECT DISTINCT project_id, dependency_id, version FROM project_dependencies)
    SELECT w.* FROM w JOIN projects p USING (project_id) JOIN banned_versions b ON b.organization_id = p.organization_id AND b.dependency_id = w.dependency_id AND b.banned_version = w.version
    UNION SELECT w.* FROM w JOIN project_teams t USING (project_id) JOIN banned_versions b ON b.team_id = t.team_id AND b.dependency_id = w.dependency_id AND b.banned_version = w.version""")
def _(v):
    return matching.banned_in_use(v.project_dependencies, v.banned_versions, v.projects, v.project_teams)


@query("jn31_kev_epss_lookup", """
    WITH x AS (SELECT project_id, cisa_kev, epss_score, unnest(CASE WHEN aliases IS NULL THEN [osv_id] ELSE list_append(aliases, osv_id) END) AS vuln_id FROM findings)
    SELECT vuln_id, bool_or(cisa_kev) AS cisa_kev, max(epss_score) AS epss_score, count(DISTINCT project_id) AS projects FROM x GROUP BY 1""")
def _(v):
    return matching.kev_epss_lookup(v.findings)


SEV4 = ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s}_vulns" for s in ("critical", "high", "medium", "low"))
COUNTS = f"""{AFFECTED}, lv AS (SELECT version_id, CASE WHEN severity IN ('critical', 'high', 'low') THEN severity ELSE 'medium' END AS s FROM affected),
    counts AS (SELECT v.version_id, v.dependency_id, v.version, coalesce(critical_vulns, 0) AS critical_vulns, coalesce(high_vulns, 0) AS high_vulns, coalesce(medium_vulns, 0) AS medium_vulns, coalesce(low_vulns, 0) AS low_vulns
      FROM dependency_versions v LEFT JOIN (SELECT version_id, {SEV4} FROM lv GROUP BY 1) c USING (version_id))"""


@query("agg10_vuln_counts_by_version", f"WITH {COUNTS} SELECT version_id, critical_vulns, high_vulns, medium_vulns, low_vulns FROM counts")
def _(v):
    return matching.vuln_counts_by_version(v.dependency_versions, advisories(v)).drop("dependency_id", "version")


@query("agg23_merge_advisories", """
    WITH k AS (SELECT *, coalesce(list_filter(aliases, lambda a: regexp_matches(a, '^CVE-[0-9]{4}-[0-9]+$'))[1], osv_id) AS canonical_id FROM advisories)
    SELECT DISTINCT canonical_id, 'alias' AS kind, value FROM (SELECT canonical_id, unnest(list_append(coalesce(aliases, []), osv_id)) AS value FROM k) WHERE value <> canonical_id
    UNION SELECT canonical_id, 'affected', CAST(dependency_id AS VARCHAR) FROM k""")
def _(v):
    return matching.merge_advisories(v.advisories)


CANDIDATES = f"""{AFFECTED}, st AS (SELECT *, {KEY.format(c='version')} AS k FROM dependency_versions WHERE version <> 'latest' AND version NOT LIKE '%-beta%'),
    banned AS (SELECT w.project_id, w.dependency_id, b.banned_version FROM (SELECT DISTINCT project_id, dependency_id FROM project_dependencies) w JOIN projects p USING (project_id) JOIN banned_versions b ON b.dependency_id = w.dependency_id AND b.organization_id = p.organization_id
      UNION SELECT w.project_id, w.dependency_id, b.banned_version FROM (SELECT DISTINCT project_id, dependency_id FROM project_dependencies) w JOIN project_teams t USING (project_id) JOIN banned_versions b ON b.dependency_id = w.dependency_id AND b.team_id = t.team_id),
    pairs AS (SELECT a.dependency_id, a.version AS cur_version, b.version AS candidate, b.k[1] > a.k[1] AS is_major_bump,
      (SELECT count(*) FROM affected x WHERE x.version_id = a.version_id AND x.advisory_id NOT IN (SELECT advisory_id FROM affected y WHERE y.version_id = b.version_id)) AS cves_fixed,
      (SELECT count(*) FROM affected x WHERE x.version_id = b.version_id AND x.advisory_id NOT IN (SELECT advisory_id FROM affected y WHERE y.version_id = a.version_id)) AS cves_new
      FROM st a JOIN st b ON a.dependency_id = b.dependency_id AND b.k > a.k),
    cand AS (SELECT d.project_id, d.dependency_id, d.cur_version, candidate, is_major_bump, cves_fixed, cves_new, n.banned_version IS NOT NULL AS is_banned
    FROM (SELECT DISTINCT project_id, dependency_id, version AS cur_version FROM project_dependencies) d JOIN pairs USING (dependency_id, cur_version) LEFT JOIN banned n ON n.project_id = d.project_id AND n.dependency_id = d.dependency_id AND n.banned_version = candidate)"""


@query("agg41_version_candidates", f"WITH {CANDIDATES} SELECT * FROM cand")
def _(v):
    uses = v.project_dependencies
    banned = matching.banned_versions(uses, v.banned_versions, v.projects, v.project_teams)
    return matching.version_candidates(uses, v.dependency_versions, advisories(v), banned)
