"""Registered queries for the scalar functions (SCL*) and row filters (FLT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import labels, packages, scores, text, versions
from larkspur.operators import filters
from larkspur.plans.common import events_now, findings_now, spread, stamp
from larkspur.plans.domain import EVENTS_NOW, FINDINGS_NOW
from larkspur.plans.registry import query

C = F.col
TS = "'%Y-%m-%d %H:%M:%S'"

KEY_SQL = r"""regexp_extract(version, '(?:^|[^0-9])([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?', {i})"""


@query("scl1_version_key", rf"""
    SELECT version_id, CASE WHEN {KEY_SQL.format(i=1)} = '' THEN NULL ELSE CAST(CAST({KEY_SQL.format(i=1)} AS BIGINT) AS VARCHAR) || '.' ||
           CAST(CAST({KEY_SQL.format(i=2)} AS BIGINT) AS VARCHAR) || '.' || CAST(CAST({KEY_SQL.format(i=3)} AS BIGINT) AS VARCHAR) END AS version_key,
           version LIKE '%-%' AS is_prerelease
    FROM dependency_versions""")
def _(v):
    key = versions.version_key(C("version"))
    return v.dependency_versions.select(
        "version_id", F.when(key.isNotNull(), versions.key_text(key)).alias("version_key"), versions.is_prerelease(C("version")).alias("is_prerelease")
    )


@query("scl2_version_norm", r"""
    WITH f AS (SELECT feed_id, ecosystem AS e, regexp_replace(split_part(version, '+', 1), '^v', '') AS s FROM malware_feed WHERE version IS NOT NULL)
    SELECT feed_id, lower(s) AS version_norm FROM f UNION ALL SELECT feed_id, NULL FROM malware_feed WHERE version IS NULL""")
def _(v):
    return v.malware_feed.select("feed_id", versions.version_norm(C("version"), packages.canonical_ecosystem(C("ecosystem"))).alias("version_norm"))


@query("scl3_registry_keys")
def _(v):
    d = spread(v.dependency_versions, "version_id").withColumn("version", F.concat(C("version"), F.when(C("version_id") % 3 == 0, "rc1").when(C("version_id") % 3 == 1, ".post2").otherwise("")))
    pep, gem = versions.pep440_key(C("version")), versions.gem_key(C("version"))
    return d.select("version_id", "version", pep.alias("p"), gem.alias("g")).select(
        "version_id", "version", F.to_json("p").alias("pep440_key"), F.to_json(F.struct("g")).alias("gem_key")
    )


@query("scl4_parse_range", r"""
    SELECT feed_id, CASE WHEN vulnerable_range LIKE '>=%' THEN '>=' || regexp_extract(vulnerable_range, '>= ([0-9.]+)', 1) || ',<' || regexp_extract(vulnerable_range, '< ([0-9.]+)', 1) END AS clauses
    FROM malware_feed WHERE vulnerable_range IS NOT NULL""")
def _(v):
    parsed = versions.parse_range(C("vulnerable_range"))
    shown = F.array_join(F.transform(parsed, lambda c: F.concat(c["op"], c["version"])), ",")
    return v.malware_feed.filter(C("vulnerable_range").isNotNull()).select("feed_id", F.when(parsed.isNotNull(), shown).alias("clauses"))


@query("scl5_canonical_ecosystem", """
    SELECT feed_id, CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang' WHEN 'gem' THEN 'rubygems' WHEN 'packagist' THEN 'composer'
           WHEN 'crates.io' THEN 'cargo' ELSE ecosystem END AS canonical FROM malware_feed""")
def _(v):
    return v.malware_feed.select("feed_id", packages.canonical_ecosystem(C("ecosystem")).alias("canonical"))


@query("scl6_canonical_name", """
    SELECT dependency_id, CASE WHEN ecosystem = 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g')
           WHEN ecosystem IN ('npm', 'nuget', 'composer', 'cargo') THEN lower(name) ELSE name END AS canonical_name FROM dependencies""")
def _(v):
    return v.dependencies.select("dependency_id", packages.canonical_name(C("name"), C("ecosystem")).alias("canonical_name"))


@query("scl7_purl", """
    SELECT version_id, 'pkg:' || CASE ecosystem WHEN 'rubygems' THEN 'gem' ELSE ecosystem END || '/' || CASE WHEN ecosystem = 'maven' THEN replace(name, ':', '/') ELSE name END || '@' || version AS purl,
           ecosystem AS parsed_ecosystem, name AS parsed_name, version AS parsed_version,
           CASE WHEN ecosystem = 'maven' THEN split_part(name, ':', 1) WHEN ecosystem = 'npm' AND name LIKE '%/%' THEN split_part(name, '/', 1) END AS parsed_namespace
    FROM dependency_versions JOIN dependencies USING (dependency_id)""")
def _(v):
    d = spread(v.dependency_versions.join(v.dependencies.select("dependency_id", "name", "ecosystem"), "dependency_id"), "version_id")
    d = d.withColumn("purl", packages.build_purl(C("ecosystem"), C("name"), C("version"))).withColumn("p", packages.parse_purl(C("purl")))
    return d.select("version_id", "purl", *[C(f"p.{k}").alias(f"parsed_{k}") for k in ("ecosystem", "name", "version", "namespace")])


@query("scl8_cvss3_score", """
    SELECT advisory_id, CASE WHEN vector LIKE 'CVSS:3.1/AV:N%' THEN 9.8e0 WHEN vector LIKE 'CVSS:3.0/AV:N%' THEN 5.4e0 WHEN vector LIKE 'CVSS:3.1/AV:L%' THEN 1.8e0 END AS base_score FROM advisories""")
def _(v):
    return v.advisories.select("advisory_id", scores.cvss3_score(C("vector")).alias("base_score"))


@query("scl9_severity", """
    SELECT a.advisory_id, CASE WHEN severity IN ('critical', 'high', 'low') THEN severity ELSE 'medium' END AS severity_norm FROM advisories a""")
def _(v):
    return v.advisories.select("advisory_id", labels.severity_norm(C("severity")).alias("severity_norm"))


@query("scl9_severity_band", """
    SELECT finding_id, CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' WHEN cvss_score > 0 THEN 'low' END AS band FROM findings""")
def _(v):
    return v.findings.select("finding_id", labels.severity_band(C("cvss_score")).alias("band"))


BASE_SQL = """(greatest(0, least(10, cvss_score)) * 10 * CASE WHEN cisa_kev THEN 1.2e0 ELSE 0.6e0 + 0.6e0 * sqrt(coalesce(epss_score, 0)) END * importance
    {level} * (CASE WHEN is_direct THEN 1e0 ELSE 0.75e0 END * CASE WHEN environment = 'dev' THEN 0.4e0 ELSE 1e0 END * CASE WHEN flagged_malicious THEN 1.3e0 ELSE 1e0 END
    * CASE WHEN score < 30 THEN 1.15e0 WHEN score > 70 THEN 0.95e0 ELSE 1e0 END))"""
LEVEL_SQL = """* CASE WHEN reachability_level = 'unreachable' THEN 0e0 WHEN reachability_level = 'confirmed' THEN 1e0 WHEN reachability_level = 'data_flow' THEN 0.9e0
    WHEN reachability_level = 'function' THEN 0.7e0 WHEN reachability_level = 'module' THEN 0.5e0 WHEN NOT is_reachable THEN 0.2e0 ELSE 1e0 END"""


@query("scl10_depscore", f"""
    SELECT finding_id, CAST(least(100, floor({BASE_SQL.format(level=LEVEL_SQL)} + 0.5)) AS BIGINT) AS depscore,
           CAST(least(100, floor({BASE_SQL.format(level='')} + 0.5)) AS BIGINT) AS base_depscore
    FROM findings f JOIN projects p USING (project_id) JOIN project_dependencies d ON d.project_dependency_id = f.project_dependency_id
    JOIN dependencies x ON x.dependency_id = f.dependency_id""")
def _(v):
    f = (
        v.findings.join(v.projects.select("project_id", "importance"), "project_id")
        .join(v.project_dependencies.select("project_dependency_id", "is_direct", "environment"), "project_dependency_id")
        .join(v.dependencies.select("dependency_id", "flagged_malicious", "score"), "dependency_id")
    )
    args = (
        C("cvss_score"), F.coalesce(C("epss_score"), F.lit(0.0)), C("cisa_kev"), C("importance"), C("is_direct"),
        F.coalesce(C("environment") == "dev", F.lit(False)), C("flagged_malicious"), C("score"),
    )
    return f.select(
        "finding_id", scores.depscore(*args, C("reachability_level"), C("is_reachable")).alias("depscore"),
        scores.base_depscore(*args).alias("base_depscore"),
    )


IMPACT_SQL = "CASE vulnerability_type WHEN 'SQL Injection' THEN 10 WHEN 'Path Traversal' THEN 10 WHEN 'Cross Site Scripting (Stored)' THEN 4 WHEN 'Open Redirect' THEN 4 ELSE -8 END"


@query("scl11_dast_depscore", f"""
    WITH s AS (SELECT finding_id, kev, linked_sca_osv_id, CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 72 WHEN 'medium' THEN 48 WHEN 'low' THEN 26 WHEN 'info' THEN 10 END
           + CASE confidence WHEN 'confirmed' THEN 10 WHEN 'high' THEN 6 WHEN 'low' THEN -12 ELSE 0 END + {IMPACT_SQL} AS raw,
           CASE vulnerability_type WHEN 'SQL Injection' THEN 'injection' WHEN 'Path Traversal' THEN 'injection' WHEN 'Cross Site Scripting (Stored)' THEN 'xss' WHEN 'Open Redirect' THEN 'xss' ELSE 'passive' END AS impact
           FROM dast_findings)
    SELECT finding_id, impact, CASE WHEN raw IS NULL THEN NULL ELSE CAST(greatest(0, least(100, CASE WHEN kev THEN greatest(raw, 96) WHEN linked_sca_osv_id IS NOT NULL THEN greatest(raw, 90) ELSE raw END)) AS BIGINT) END AS depscore FROM s""")
def _(v):
    return v.dast_findings.select(
        "finding_id", scores.dast_impact(C("vulnerability_type")).alias("impact"),
        scores.dast_depscore(C("severity"), C("confidence"), C("vulnerability_type"), C("linked_sca_osv_id").isNotNull(), C("kev")).cast("long").alias("depscore"),
    )


@query("scl12_secret_depscore", """
    SELECT finding_id, CAST(least(100, floor(CASE WHEN is_verified THEN 90e0 ELSE 60e0 END * CASE detector_type WHEN 'AWS' THEN 1e0 WHEN 'GitHub' THEN 0.9e0 WHEN 'Stripe' THEN 0.95e0 WHEN 'URI' THEN 0.5e0 WHEN 'Slack' THEN 0.7e0 ELSE 0.6e0 END
           * CASE WHEN is_current THEN 1e0 ELSE 0.8e0 END * importance + 0.5)) AS BIGINT) AS computed FROM secret_findings JOIN projects USING (project_id)""")
def _(v):
    f = v.secret_findings.join(v.projects.select("project_id", "importance"), "project_id")
    return f.select("finding_id", scores.secret_depscore(C("detector_type"), C("is_verified"), C("is_current"), C("importance")).alias("computed"))


@query("scl12_semgrep_depscore", """
    SELECT finding_id, CAST(least(100, floor((CASE upper(severity) WHEN 'ERROR' THEN 70 WHEN 'WARNING' THEN 45 WHEN 'INFO' THEN 20 ELSE 30 END
      + CASE WHEN regexp_matches(cwe_ids[1], '^CWE-(79|89|78|94|502|918|22|611|77|74)') THEN 15 ELSE 0 END + CASE WHEN category = 'security' THEN 5 ELSE 0 END) * importance + 0.5)) AS BIGINT) AS computed
    FROM semgrep_findings JOIN projects USING (project_id)""")
def _(v):
    f = v.semgrep_findings.join(v.projects.select("project_id", "importance"), "project_id")
    return f.select("finding_id", scores.semgrep_depscore(C("severity"), C("cwe_ids"), C("category"), C("importance")).alias("computed"))


@query("scl12_container_depscore", """
    SELECT finding_id, CASE WHEN reachability_level = 'unreachable' THEN CAST(floor(b * 0.4e0 + 0.5) AS BIGINT) ELSE CAST(b AS BIGINT) END AS computed
    FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 90 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 30 END AS b FROM container_findings)""")
def _(v):
    return v.container_findings.select("finding_id", scores.container_depscore(C("severity"), C("reachability_level")).alias("computed"))


@query("scl13_flow_depscore", """
    WITH b AS (SELECT flow_id, flow_length AS n, CASE WHEN vuln_class IN ('sql_injection', 'command_injection', 'deserialization') THEN 92 WHEN vuln_class IN ('xss', 'ssrf', 'path_traversal') THEN 78 ELSE 55 END AS base FROM flows)
    SELECT flow_id, CAST(greatest(CASE base WHEN 92 THEN 90 WHEN 78 THEN 70 ELSE 40 END, least(CASE base WHEN 92 THEN 99 WHEN 78 THEN 89 ELSE 69 END,
      base + CASE WHEN n IS NULL THEN 0 WHEN n <= 2 THEN 3 WHEN n = 3 THEN 2 WHEN n = 4 THEN 1 WHEN n <= 6 THEN 0 WHEN n <= 8 THEN -1 WHEN n <= 11 THEN -2 ELSE -3 END)) AS BIGINT) AS depscore FROM b""")
def _(v):
    return v.flows.select("flow_id", scores.flow_depscore(C("vuln_class"), C("flow_length")).alias("depscore"))


@query("scl14_finding_key", """
    SELECT finding_id, sha256(lower(rule_id) || chr(31) || lower(file_path) || chr(31) || coalesce(CAST(start_line AS VARCHAR), '')) AS finding_key FROM semgrep_findings""")
def _(v):
    return v.semgrep_findings.select("finding_id", packages.finding_key(C("rule_id"), C("file_path"), C("start_line")).alias("finding_key"))


@query("scl15_flow_signature", r"""
    SELECT flow_id, sha256(lower(entry_point_file) || ':' || CAST(entry_point_line AS VARCHAR) || '|' || lower(replace(sink_file, '\', '/')) || ':' || CAST(sink_line AS VARCHAR) || '|' || sink_method || '|' || coalesce(osv_id, '')) AS signature FROM flows""")
def _(v):
    return v.flows.select("flow_id", packages.flow_signature(*[C(c) for c in ("entry_point_file", "entry_point_line", "sink_file", "sink_line", "sink_method", "osv_id")]).alias("signature"))


@query("scl16_epd_factor", """
    SELECT flow_id, round(CASE WHEN is_sanitized THEN 0e0 ELSE CASE WHEN entry_point_tag LIKE '%public_unauth' THEN 1e0 WHEN entry_point_tag LIKE '%auth_internal' THEN 0.5e0 WHEN entry_point_tag LIKE '%offline_worker' THEN 0.2e0
      WHEN entry_point_tag = 'cron job' THEN 0.2e0 WHEN entry_point_tag IN ('framework-input:unmatched', 'http handler') THEN 1e0 ELSE 0.5e0 END * pow(0.85e0, flow_length - 1) END, 6) AS factor
    FROM flows WHERE flow_length IS NOT NULL""")
def _(v):
    f = v.flows.filter(C("flow_length").isNotNull())
    weight = scores.lookup(scores.ENTRY_WEIGHT, scores.entry_class(C("entry_point_tag")))
    return f.select("flow_id", F.round(scores.epd_factor(weight, C("flow_length") - 1, C("is_sanitized")), 6).alias("factor"))


@query("scl17_reputation_score", """
    SELECT dependency_id, CAST(greatest(0, least(100, floor((100e0 - CASE WHEN openssf_score IS NULL THEN 11e0 ELSE (10e0 - openssf_score) * 3.3e0 END
      - CASE WHEN weekly_downloads IS NULL THEN 16e0 ELSE greatest(0e0, least(33e0, 34e0 - log10(weekly_downloads + 1e0) * 7e0)) END
      - CASE WHEN releases_last_12_months IS NULL THEN 16e0 WHEN releases_last_12_months >= 12 THEN 0e0 WHEN releases_last_12_months >= 6 THEN 8e0 WHEN releases_last_12_months >= 3 THEN 16e0 WHEN releases_last_12_months >= 1 THEN 24e0 ELSE 33e0 END)
      * CASE WHEN slsa_level >= 3 THEN 1.1e0 WHEN slsa_level >= 1 THEN 1.05e0 ELSE 1e0 END * CASE WHEN flagged_malicious THEN 0.15e0 ELSE 1e0 END + 0.5))) AS BIGINT) AS reputation FROM dependencies""")
def _(v):
    return v.dependencies.select("dependency_id", scores.reputation_score(
        C("openssf_score"), C("weekly_downloads"), C("releases_last_12_months"), C("slsa_level"), C("flagged_malicious")).alias("reputation"))


@query("scl19_license", """
    SELECT dependency_id, CASE license WHEN 'MIT' THEN 'mit' WHEN 'Apache-2.0' THEN 'apache-2.0' WHEN 'GPL-3.0' THEN 'gpl-3.0' WHEN 'AGPL-3.0' THEN 'gpl-agpl-3.0' WHEN 'BSD-3-Clause' THEN 'bsd-3clause-3' ELSE '' END AS license_key,
           CASE WHEN license IS NULL THEN NULL ELSE license IN ('MIT', 'Apache-2.0') END AS allowed FROM dependencies""")
def _(v):
    return v.dependencies.select("dependency_id", text.license_key(F.coalesce(C("license"), F.lit(""))).alias("license_key"), text.license_allowed(C("license"), ["MIT License", "Apache 2.0"]).alias("allowed"))


@query("scl20_vuln_family", """
    SELECT finding_id, CASE WHEN vulnerability_type = 'SQL Injection' OR message LIKE '%sqli%' THEN 'sqli' WHEN vulnerability_type LIKE 'Cross Site%' THEN 'output-injection'
      WHEN vulnerability_type = 'Path Traversal' THEN 'path-traversal' ELSE 'rule:' || lower(coalesce(rule_id, vulnerability_type)) END AS family FROM dast_findings""")
def _(v):
    return v.dast_findings.select("finding_id", labels.vuln_family(C("vulnerability_type"), C("rule_id"), C("message")).alias("family"))


@query("scl21_cwe_to_type", """
    SELECT advisory_id, CASE cwe_id WHEN 'CWE-79' THEN 'xss' WHEN 'CWE-89' THEN 'sql-injection' WHEN 'CWE-22' THEN 'path-traversal' WHEN 'CWE-502' THEN 'deserialization' WHEN 'CWE-918' THEN 'ssrf' END AS vuln_type FROM advisories""")
def _(v):
    return v.advisories.select("advisory_id", labels.cwe_to_type(F.array(C("cwe_id"), F.lit("CWE-1"))).alias("vuln_type"))


@query("scl21_failure_category", """
    SELECT outcome_id, CASE failure_reason WHEN 'empty_diff' THEN 'unknown' WHEN 'build_error' THEN 'build_error' WHEN 'test_failure' THEN 'test_failure' WHEN 'auth_failed' THEN 'auth_failed' WHEN 'timeout' THEN 'timeout' ELSE 'unknown' END AS category
    FROM fix_outcomes WHERE failure_reason IS NOT NULL""")
def _(v):
    message = F.when(C("failure_reason") == "build_error", "npm ERR! code 1").when(C("failure_reason") == "test_failure", "Tests failed: 3").otherwise("???")
    return v.fix_outcomes.filter(C("failure_reason").isNotNull()).select("outcome_id", labels.failure_category(C("failure_reason"), message).alias("category"))


@query("scl22_redact", """
    SELECT finding_id, CASE WHEN length(raw_value) >= 20 THEN left(raw_value, 4) || '...' || right(raw_value, 4) ELSE '****' END AS redacted FROM secret_findings""")
def _(v):
    return v.secret_findings.select("finding_id", text.redact(C("raw_value")).alias("redacted"))


@query("scl23_ranks", """
    SELECT finding_id, CAST(CASE reachability_level WHEN 'confirmed' THEN 4 WHEN 'data_flow' THEN 3 WHEN 'function' THEN 2 WHEN 'module' THEN 1 ELSE 0 END AS BIGINT) AS reach_rank,
           CAST(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS BIGINT) AS sev_rank FROM findings""")
def _(v):
    return v.findings.select("finding_id", labels.reachability_rank(C("reachability_level")).cast("long").alias("reach_rank"), labels.severity_rank(C("severity")).cast("long").alias("sev_rank"))


@query("scl24_route_regex", r"""
    SELECT route_id, '^' || replace(replace(replace(replace(route_pattern, '<string:lang>', '[^/]+'), '{lang}', '[^/]+'), ':lang', '[^/]+'), ':id', '[^/]+') || '$' AS regex FROM routes""")
def _(v):
    return v.routes.select("route_id", text.route_regex(C("route_pattern")).alias("regex"))


@query("scl25_engine_confidence", """
    SELECT flow_id, round(greatest(0.05e0, least(0.99e0, 1e0 - CASE WHEN flow_length > 3 THEN least(0.4e0, (flow_length - 3) * 0.1e0) ELSE 0e0 END)), 2) AS confidence FROM flows WHERE flow_length IS NOT NULL""")
def _(v):
    return v.flows.filter(C("flow_length").isNotNull()).select("flow_id", scores.engine_confidence(C("flow_length"), C("sink_method"), C("sink_file")).alias("confidence"))


@query("scl26_days_since", f"""
    SELECT finding_id, CAST(floor(date_diff('second', detected_at, TIMESTAMP '{FINDINGS_NOW}') / 86400.0) AS BIGINT) AS days,
           runtime_confirmed_at IS NULL AS never FROM findings""")
def _(v):
    return v.findings.select("finding_id", labels.days_since(C("detected_at"), findings_now()).cast("long").alias("days"), (labels.days_since(C("runtime_confirmed_at"), findings_now()) == float("inf")).alias("never"))


@query("scl27_alias_set", """
    SELECT finding_id, CASE WHEN aliases IS NULL THEN upper(osv_id) ELSE upper(aliases[1]) || ',' || upper(osv_id) END AS ids FROM findings""")
def _(v):
    ids = packages.alias_set(C("osv_id"), C("aliases"))
    return v.findings.select("finding_id", F.array_join(F.array_sort(ids), ",").alias("ids"))


@query("flt1_active_run", """
    SELECT f.finding_id, f.project_id, f.extraction_run_id FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id""")
def _(v):
    return filters.active_run(v.findings, v.projects).select("finding_id", "project_id", "extraction_run_id")


@query("flt2_live_dependencies", "SELECT project_dependency_id FROM project_dependencies WHERE removed_at IS NULL")
def _(v):
    return filters.live_dependencies(v.project_dependencies).select("project_dependency_id")


OPEN_SQL = "status NOT IN ('ignored', 'resolved') AND NOT suppressed AND NOT risk_accepted AND NOT (auto_ignored AND runtime_confirmed_at IS NULL)"


@query("flt3_is_open", f"SELECT finding_id FROM findings WHERE {OPEN_SQL}")
def _(v):
    return filters.open_findings(v.findings).select("finding_id")


@query("flt4_auto_ignore_reason", """
    SELECT 'v' || finding_id AS id, CASE WHEN reachability_level IN ('confirmed', 'data_flow') THEN NULL WHEN reachability_level = 'unreachable' OR NOT is_reachable THEN 'not_reachable' WHEN reachability_level = 'module' THEN 'unconfirmed_reachable' END AS reason FROM findings
    UNION ALL SELECT 'c' || finding_id, CASE WHEN is_kev THEN NULL ELSE 'base_image' END FROM container_findings
    UNION ALL SELECT 'd' || CAST(finding_id AS VARCHAR), CASE WHEN trim(coalesce(payload_redacted, '')) <> '' OR severity IN ('high', 'critical') THEN NULL ELSE 'passive_hygiene' END FROM dast_findings
    UNION ALL SELECT 'i' || CAST(finding_id AS VARCHAR), CASE WHEN rule_id IN ('CKV_K8S_16', 'AVD-KSV-0023', 'KSV-0121') THEN NULL WHEN rule_id IN ('CKV_K8S_38', 'CKV2_K8S_6') THEN 'iac_hardening' WHEN severity IN ('HIGH', 'CRITICAL') THEN NULL ELSE 'iac_hardening' END FROM iac_findings""")
def _(v):
    def rows(df, kind, prefix, **cols):
        get = lambda c, t: C(cols[c]) if c in cols else F.lit(None).cast(t)
        reason = labels.auto_ignore_reason(
            F.lit(kind), get("level", "string"), get("reachable", "boolean"), get("kev", "boolean"), get("rule", "string"), get("severity", "string"), get("payload", "string"))
        return df.select(F.concat(F.lit(prefix), C("finding_id").cast("string")).alias("id"), reason.alias("reason"))

    return (
        rows(v.findings, "vulnerability", "v", level="reachability_level", reachable="is_reachable")
        .unionByName(rows(v.container_findings, "container", "c", kev="is_kev"))
        .unionByName(rows(v.dast_findings, "dast", "d", severity="severity", payload="payload_redacted"))
        .unionByName(rows(v.iac_findings, "iac", "i", rule="rule_id", severity="severity"))
    )


@query("flt5_iac_is_critical", """
    SELECT finding_id, CASE WHEN rule_id IN ('CKV_K8S_16', 'AVD-KSV-0023', 'KSV-0121') THEN true WHEN rule_id IN ('CKV_K8S_38', 'CKV2_K8S_6') THEN false ELSE coalesce(severity, '') IN ('HIGH', 'CRITICAL') END AS critical FROM iac_findings""")
def _(v):
    return v.iac_findings.select("finding_id", labels.iac_is_critical(C("rule_id"), C("severity")).alias("critical"))


@query("flt6_drop_noise_rules", """
    SELECT finding_id FROM semgrep_findings f JOIN projects p USING (project_id)
    WHERE NOT (rule_id LIKE 'generic.secrets.%' OR rule_id LIKE 'yaml.kubernetes.%' OR rule_id LIKE '%express-check-%' OR rule_id LIKE '%unsafe-formatstring%'
      OR (p.is_client_spa AND (rule_id LIKE '%detect-non-literal-regexp%' OR rule_id LIKE '%detect-child-process%')))
      AND file_path NOT LIKE '%node_modules/%' AND file_path NOT LIKE '%depscan-reports/%'""")
def _(v):
    return filters.drop_noise_rules(v.semgrep_findings, v.projects).select("finding_id")


@query("flt7_downrank_severity", """
    SELECT finding_id, CASE WHEN rule_id LIKE '%detect-non-literal-regexp%' THEN 'INFO' ELSE coalesce(severity, 'INFO') END AS severity FROM semgrep_findings""")
def _(v):
    return v.semgrep_findings.select("finding_id", labels.downrank_severity(C("rule_id"), C("severity")).alias("severity"))


@query("flt8_drop_vendored_paths", "SELECT finding_id FROM secret_findings WHERE file_path NOT LIKE '%node_modules/%' AND file_path NOT LIKE '.git/%'")
def _(v):
    return filters.drop_vendored_paths(v.secret_findings).select("finding_id")


@query("flt9_finding_filter", "SELECT finding_id FROM iac_findings WHERE severity = 'HIGH' AND status = 'open' AND depscore >= 20")
def _(v):
    return filters.finding_filter(v.iac_findings, severity="high", status="OPEN", framework="nonsense", min_score=20).select("finding_id")


@query("flt10_reachability_filter", "SELECT finding_id FROM findings WHERE reachability_level IN ('confirmed', 'data_flow') OR reachability_level IS NULL")
def _(v):
    return filters.reachability_filter(v.findings, ["confirmed", "data_flow"], include_unknown=True).select("finding_id")


GRANTS = """m AS (SELECT o.*, o.role = 'owner' OR coalesce(r.manage_teams_and_projects, false) AS sees_all FROM org_members o LEFT JOIN organization_roles r ON r.organization_id = o.organization_id AND r.name = o.role),
    g AS (SELECT user_id, 'organization' AS scope, organization_id AS scope_id FROM m WHERE sees_all
    UNION SELECT p.user_id, 'project', p.project_id FROM project_members p JOIN m USING (user_id) WHERE NOT sees_all
    UNION SELECT t.user_id, 'team', t.team_id FROM team_members t JOIN m USING (user_id) WHERE NOT sees_all)"""


@query("flt11_access_grants", f"WITH {GRANTS} SELECT * FROM g")
def _(v):
    return filters.access_grants(v.org_members, v.organization_roles, v.project_members, v.team_members)


@query("flt11_accessible_projects", """
    WITH m AS (SELECT o.*, o.role = 'owner' OR coalesce(r.manage_teams_and_projects, false) AS sees_all FROM org_members o LEFT JOIN organization_roles r ON r.organization_id = o.organization_id AND r.name = o.role)
    SELECT m.user_id, p.project_id, p.organization_id FROM m JOIN projects p ON p.organization_id = m.organization_id
    WHERE sees_all OR EXISTS (SELECT 1 FROM project_members x WHERE x.user_id = m.user_id AND x.project_id = p.project_id) OR EXISTS (SELECT 1 FROM team_members t JOIN project_teams y ON y.team_id = t.team_id WHERE t.user_id = m.user_id AND y.project_id = p.project_id)""")
def _(v):
    grants = filters.access_grants(v.org_members, v.organization_roles, v.project_members, v.team_members)
    return filters.accessible_projects(grants, v.projects, v.project_teams, v.org_members).select("user_id", "project_id", "organization_id")


@query("flt12_sla_approaching", f"""
    SELECT finding_id, p.organization_id, strftime(sla_deadline_at, {TS}) AS sla_deadline_at, round(date_diff('second', TIMESTAMP '{FINDINGS_NOW}', sla_deadline_at) / 3600.0, 4) AS hours_remaining
    FROM findings f JOIN projects p USING (project_id) JOIN organizations o ON o.organization_id = p.organization_id
    WHERE sla_status = 'on_track' AND o.sla_paused_at IS NULL AND sla_warning_at <= TIMESTAMP '{FINDINGS_NOW}' AND sla_deadline_at > TIMESTAMP '{FINDINGS_NOW}'""")
def _(v):
    out = filters.sla_approaching(v.findings, v.projects, v.organizations, now=findings_now())
    return out.select("finding_id", "organization_id", stamp("sla_deadline_at"), "hours_remaining")


@query("flt12_sla_newly_breached", f"""
    SELECT finding_id, p.organization_id, strftime(sla_deadline_at, {TS}) AS sla_deadline_at, round(date_diff('second', sla_deadline_at, TIMESTAMP '{FINDINGS_NOW}') / 3600.0, 4) AS hours_overdue
    FROM findings f JOIN projects p USING (project_id) JOIN organizations o ON o.organization_id = p.organization_id
    WHERE sla_status IN ('on_track', 'warning') AND sla_breach_notified_at IS NULL AND o.sla_paused_at IS NULL AND sla_deadline_at < TIMESTAMP '{FINDINGS_NOW}'""")
def _(v):
    out = filters.sla_newly_breached(v.findings, v.projects, v.organizations, now=findings_now())
    return out.select("finding_id", "organization_id", stamp("sla_deadline_at"), "hours_overdue")


@query("flt13_stable_versions", "SELECT version_id FROM dependency_versions WHERE version NOT LIKE '%-beta%' AND version <> 'latest'")
def _(v):
    return filters.stable_versions(v.dependency_versions).select("version_id")


@query("flt14_drop_single_node_flows", """
    WITH f AS (SELECT * REPLACE (CASE WHEN sink_line % 3 = 0 THEN NULL ELSE flow_id END AS flow_id) FROM flows WHERE flow_length > 1)
    SELECT project_id, flow_signature_hash, min(flow_id) AS flow_id FROM f WHERE flow_signature_hash IS NOT NULL GROUP BY project_id, flow_signature_hash
    UNION ALL SELECT project_id, flow_signature_hash, flow_id FROM f WHERE flow_signature_hash IS NULL""")
def _(v):
    some_without = v.flows.withColumn("flow_id", F.when(C("sink_line") % 3 == 0, None).otherwise(C("flow_id")))
    return filters.drop_single_node_flows(some_without).select("project_id", "flow_signature_hash", "flow_id")


@query("flt15_fresh_cache", f"""
    SELECT run_id FROM feed_runs WHERE source = 'osv' AND run_id % 5 <> 0 AND date_diff('second', started_at, TIMESTAMP '{EVENTS_NOW}') <= 7 * 86400""")
def _(v):
    good = packages.content_hash(state=C("state"), source=C("source"))
    stored = F.when(C("run_id") % 5 == 0, F.lit("tampered")).otherwise(good)
    cache = v.feed_runs.select("run_id", "state", "source", C("source").alias("scanner_version"), C("started_at").alias("scanned_at"), stored.alias("scan_results_hash"))
    return filters.fresh_cache(cache, good, scanner_version="osv", now=events_now()).select("run_id")


@query("flt16_fix_rule_gate", """
    WITH r AS (SELECT *, rule_id IN ('npm-api-obfuscation', 'pypi-shady-links') AS low, rule_id IN ('empty-information', 'release_zero', 'bundled_binary') AS weak FROM malicious_findings)
    SELECT finding_id FROM r WHERE NOT low AND (NOT weak OR EXISTS (SELECT 1 FROM r b WHERE b.project_id = r.project_id AND b.extraction_run_id = r.extraction_run_id AND (b.has_feed_hit OR (NOT b.low AND NOT b.weak))))""")
def _(v):
    return filters.fix_rule_gate(v.malicious_findings, ["project_id", "extraction_run_id"]).select("finding_id")
