"""Domain tables derived from the star-schema inputs.

Each view is one SELECT over the input tables (or over other views) and never drops rows to make a run
cheaper.  The text is shared by Spark and by the SQL check, so both engines see the same fixture; the operators
themselves are written twice.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FINDINGS_NOW = "2001-12-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"
LEDGER_NOW = "2001-08-02 00:00:00"


class SparkDialect:
    name = "spark"
    backslash = "\\\\"

    def ts(self, text: str) -> str:
        return f"CAST('{text}' AS TIMESTAMP_NTZ)"

    @property
    def ts_type(self) -> str:
        return "TIMESTAMP_NTZ"

    def add_hours(self, ts: str, hours: str) -> str:
        return f"({ts} + make_dt_interval(0, CAST({hours} AS INT), 0, 0))"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def series(self, name: str, lo: int, hi: int) -> str:
        return f"LATERAL VIEW explode(sequence({lo}, {hi})) s_{name} AS {name}"

    def has(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE '{pattern}')"

    def extract(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"


class DuckDialect:
    name = "duckdb"
    backslash = "\\"

    def ts(self, text: str) -> str:
        return f"CAST('{text}' AS TIMESTAMP)"

    @property
    def ts_type(self) -> str:
        return "TIMESTAMP"

    def add_hours(self, ts: str, hours: str) -> str:
        return f"({ts} + to_hours(CAST({hours} AS BIGINT)))"

    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def series(self, name: str, lo: int, hi: int) -> str:
        return f"CROSS JOIN (SELECT unnest(range({lo}, {hi + 1})) AS {name}) s_{name}"

    def has(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def extract(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"


def pick(expr: str, values: list[str | None], default: str | None = None) -> str:
    """CASE that maps 0, 1, 2, ... to the given text values."""

    def lit(v: str | None) -> str:
        return "NULL" if v is None else f"'{v}'"

    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {arms} ELSE {lit(default)} END)"


ECOSYSTEMS = ["npm", "pypi", "maven", "golang", "rubygems", "composer", "cargo", "nuget"]
LICENSES = ["MIT", "Apache-2.0", "GPL-3.0", "AGPL-3.0", "BSD-3-Clause", None]
SLA_STATES = ["on_track", "warning", "breached", "exempt", "met", "resolved_late", None]
VULN_CLASSES = [
    "sql_injection", "command_injection", "xss", "ssrf", "path_traversal", "open_redirect",
    "log_injection", "deserialization", "weak_crypto", None,
]
IAC_RULES = ["CKV_K8S_16", "CKV_K8S_38", "AVD-KSV-0023", "CKV_AWS_20", "KSV-0121", "CKV2_K8S_6", "CKV_GCP_1"]
SAST_RULES = [
    "javascript.lang.security.audit.unsafe-formatstring.unsafe-formatstring",
    "javascript.lang.security.audit.detect-non-literal-regexp",
    "generic.secrets.security.detected-token",
    "yaml.kubernetes.security.run-as-non-root",
    "javascript.express.security.express-check-csurf",
    "python.lang.security.audit.exec-detected",
    "java.lang.security.audit.sqli",
    "javascript.lang.security.detect-child-process",
]
DAST_TYPES = {
    "error": "SQL Injection", "view": "Cache-control Header Missing", "click": "Cross Site Scripting (Stored)",
    "purchase": "Path Traversal", "signup": "Open Redirect",
}
MALWARE_RULES = [
    "npm-api-obfuscation", "empty-information", "npm-silent-process-execution", "release_zero",
    "typosquatting", "pypi-shady-links", "bundled_binary",
]

VERSION_TEXT = (
    "(CASE WHEN {i} = 3 AND {p} % 50 = 0 THEN 'latest' ELSE CAST({s} % 5 AS STRING) || '.' || CAST({i} AS STRING)"
    " || '.' || CAST({p} % 7 AS STRING) || (CASE WHEN {i} = 4 AND {p} % 3 = 0 THEN '-beta.1' ELSE '' END) END)"
)
DEP_NAME = (
    "(CASE {p} % 8"
    " WHEN 0 THEN (CASE WHEN {p} % 3 = 0 THEN '@acme/' ELSE '' END) || replace({n}, ' ', '-') || '-' || CAST({p} AS STRING)"
    " WHEN 1 THEN upper(substring({n}, 1, 1)) || substring(replace({n}, ' ', '_'), 2) || '_' || CAST({p} AS STRING)"
    " WHEN 2 THEN 'org.' || lower(replace({b}, '#', '')) || ':' || replace({n}, ' ', '-') || '-' || CAST({p} AS STRING)"
    " ELSE replace({n}, ' ', '-') || '-' || CAST({p} AS STRING) END)"
)
LINE_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
    " || '-' || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)"
)
CVSS = "round(l_quantity / 5e0, 1)"
SEVERITY = (
    "(CASE WHEN {c} >= 9.0 THEN 'critical' WHEN {c} >= 7.0 THEN 'high' WHEN {c} >= 4.0 THEN 'medium'"
    " WHEN {c} > 0 THEN 'low' END)"
)


def _views(d) -> dict[str, str]:
    cve = "'CVE-2024-' || CAST(1000 + {p} AS STRING)"
    sev = SEVERITY.format(c=CVSS)
    version = VERSION_TEXT
    v: dict[str, str] = {}

    v["organizations"] = f"""
        SELECT CAST(n_nationkey AS BIGINT) AS organization_id, n_name AS name,
               CASE WHEN n_nationkey % 7 = 3 THEN {d.ts('2001-06-01 00:00:00')} END AS sla_paused_at,
               {d.ts('1995-01-01 00:00:00')} AS created_at
        FROM {{nation}} n"""
    v["teams"] = f"""
        SELECT CAST(r_regionkey AS BIGINT) AS team_id, r_name AS name,
               CASE WHEN r_regionkey = 2 THEN {d.ts('2024-02-15 00:00:00')} END AS notifications_paused_until
        FROM {{region}} r"""
    v["projects"] = f"""
        SELECT s_suppkey AS project_id, CAST(s_nationkey AS BIGINT) AS organization_id,
               CAST(s_suppkey % 5 AS BIGINT) AS team_id, s_name AS name,
               round(0.5e0 + (s_suppkey % 16) / 10e0, 1) AS importance,
               CASE WHEN s_suppkey % 20 = 19 THEN NULL ELSE '2001' END AS active_extraction_run_id,
               CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE '2000' END AS previous_extraction_run_id,
               CAST(floor(abs(s_acctbal) / 100e0) AS BIGINT) AS health_score,
               {pick('s_suppkey % 4', ['compliant', 'blocked', 'review'])} AS status_id,
               (s_suppkey % 4 = 0) AS is_passing,
               (s_suppkey % 6 = 1) AS is_client_spa,
               {pick('s_suppkey % 8', ECOSYSTEMS)} AS ecosystem,
               {d.add_hours(d.ts('1995-03-01 00:00:00'), 's_suppkey % 2000 * 24')} AS created_at,
               CASE WHEN s_suppkey % 9 = 4 THEN {d.ts('2024-02-10 00:00:00')} END AS notifications_paused_until,
               CASE WHEN s_suppkey % 3 = 0 THEN {d.ts('2001-07-01 00:00:00')}
                    WHEN s_suppkey % 3 = 1 THEN {d.ts('2001-10-01 00:00:00')} END AS policy_evaluated_at
        FROM {{supplier}} s"""
    v["org_members"] = f"""
        SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS organization_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'manager' ELSE 'member' END AS role,
               {d.add_hours(d.ts('1995-02-01 00:00:00'), 'c_custkey % 2200 * 24')} AS created_at
        FROM {{customer}} c"""
    v["organization_roles"] = f"""
        SELECT CAST(n_nationkey AS BIGINT) AS organization_id, {pick('k', ['owner', 'manager', 'member'])} AS name,
               (CASE k WHEN 1 THEN n_nationkey % 6 <> 5 WHEN 2 THEN n_nationkey % 11 = 3 END) AS manage_teams_and_projects
        FROM {{nation}} n {d.series('k', 0, 2)} WHERE k < 2 OR n_nationkey % 8 <> 7"""
    v["project_members"] = """
        SELECT DISTINCT o_custkey AS user_id, l_suppkey AS project_id
        FROM {orders} o JOIN {lineitem} l ON l_orderkey = o_orderkey"""
    v["team_members"] = "SELECT c_custkey AS user_id, CAST(c_custkey % 5 AS BIGINT) AS team_id FROM {customer} c"
    v["project_teams"] = "SELECT s_suppkey AS project_id, CAST(s_suppkey % 5 AS BIGINT) AS team_id FROM {supplier} s"

    v["dependencies"] = f"""
        SELECT p_partkey AS dependency_id, {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} AS name,
               {pick('p_partkey % 8', ECOSYSTEMS)} AS ecosystem,
               (CASE p_type WHEN 'STANDARD' THEN 'MIT' WHEN 'MEDIUM' THEN 'Apache-2.0' WHEN 'ECONOMY' THEN 'GPL-3.0'
                    WHEN 'SMALL' THEN 'BSD-3-Clause' WHEN 'LARGE' THEN 'AGPL-3.0' END) AS license,
               CASE WHEN p_size % 6 = 0 THEN NULL ELSE round(p_size / 5e0, 1) END AS openssf_score,
               CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(floor(p_retailprice * p_size) AS BIGINT) END AS weekly_downloads,
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 14 END AS releases_last_12_months,
               p_size % 5 AS slsa_level, (p_size % 17 = 0) AS flagged_malicious,
               CASE WHEN p_partkey % 31 = 0 THEN NULL
                    ELSE CAST(p_size % 5 AS STRING) || '.3.' || CAST(p_partkey % 7 AS STRING) END AS latest_version,
               {pick('p_size % 5', ['ready', 'analyzing', 'pending', 'error'])} AS status,
               CAST(p_size * 2 AS BIGINT) AS score
        FROM {{part}} p"""
    v["dependency_versions"] = f"""
        SELECT p_partkey * 10 + i AS version_id, p_partkey AS dependency_id,
               {version.format(i='i', p='p_partkey', s='p_size')} AS version,
               CASE WHEN i = 0 THEN NULL ELSE CAST(i AS BIGINT) END AS slsa_level
        FROM {{part}} p {d.series('i', 0, 4)}"""
    v["version_edges"] = f"""
        SELECT p_partkey * 10 + i AS parent_version_id, (2 * p_partkey + 1 + k) * 10 + i AS child_version_id
        FROM {{part}} p {d.series('i', 0, 4)} {d.series('k', 0, 1)}
        UNION ALL
        SELECT p_partkey * 10 + i, CAST(floor(p_partkey / 2e0) AS BIGINT) * 10 + i
        FROM {{part}} p {d.series('i', 0, 4)} WHERE p_type = 'PROMO' AND p_size = 1"""
    v["advisories"] = f"""
        SELECT p_partkey * 10 + k AS advisory_id, p_partkey AS dependency_id,
               CASE WHEN k = 0 THEN {cve.format(p='p_partkey')} ELSE 'GHSA-' || CAST(k AS STRING) || '-' || CAST(p_partkey AS STRING) END AS osv_id,
               CASE WHEN k = 1 THEN {d.arr(cve.format(p='p_partkey'), "'PYSEC-' || CAST(p_partkey AS STRING)")}
                    WHEN k = 2 THEN {d.arr("'CVE-2023-' || CAST(5000 + p_partkey AS STRING)")} END AS aliases,
               {pick('(p_size + k) % 6', ['critical', 'high', 'medium', 'low', 'MODERATE'])} AS severity,
               CASE WHEN p_partkey % 13 = 0 AND k = 0 THEN NULL
                    ELSE CAST(p_size % 5 AS STRING) || '.' || CAST(k AS STRING) || '.0' END AS introduced,
               CASE WHEN p_partkey % 13 = 0 AND k = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN NULL
                    ELSE CAST(p_size % 5 AS STRING) || '.' || CAST(k + 2 AS STRING) || '.1' END AS fixed,
               (p_partkey % 13 = 0 AND k = 0) AS ranges_missing,
               CASE WHEN k = 2 THEN {d.arr("CAST(p_size % 5 AS STRING) || '.0.' || CAST(p_partkey % 7 AS STRING)")} END AS versions,
               {d.add_hours(d.ts('1999-01-01 00:00:00'), 'p_partkey % 900 * 24 + k')} AS published_at,
               {pick('p_size % 7', ['CWE-79', 'CWE-89', 'CWE-22', 'CWE-502', 'CWE-918', 'CWE-1'])} AS cwe_id,
               {pick('p_size % 5', ['CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H', 'CVSS:3.0/AV:N/AC:L/PR:L/UI:R/S:C/C:L/I:L/A:N', 'CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N', 'CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P'])} AS vector
        FROM {{part}} p {d.series('k', 0, 2)}"""
    v["scopes"] = f"""
        SELECT l_suppkey AS project_id, l_partkey AS dependency_id, l_returnflag AS scope_flag,
               CAST(l_suppkey AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || l_returnflag AS scope_row_id,
               CASE l_returnflag WHEN 'R' THEN 'dev' WHEN 'A' THEN 'prod' END AS environment,
               {version.format(i='((l_suppkey + l_partkey) % 5)', p='l_partkey', s='max(p_size)')} AS version,
               max({DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')}) AS name
        FROM {{lineitem}} l JOIN {{part}} p ON p_partkey = l_partkey
        GROUP BY l_suppkey, l_partkey, l_returnflag"""
    v["project_dependencies"] = f"""
        SELECT CAST(g.project_id AS STRING) || ':' || CAST(g.dependency_id AS STRING) AS project_dependency_id,
               g.project_id, g.dependency_id, g.dependency_id * 10 + (g.project_id + g.dependency_id) % 5 AS version_id,
               {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} AS name,
               {pick('g.dependency_id % 8', ECOSYSTEMS)} AS ecosystem,
               CASE WHEN g.dependency_id % 8 = 5 THEN '@vendor' WHEN g.dependency_id % 8 = 6 THEN '' END AS namespace,
               {version.format(i='((g.project_id + g.dependency_id) % 5)', p='g.dependency_id', s='p_size')} AS version,
               g.first_line <= 2 AS is_direct, CASE WHEN g.first_flag = 'R' THEN 'dev' WHEN g.first_flag = 'A' THEN 'prod' END AS environment,
               CASE WHEN g.n = 3 THEN NULL ELSE g.n - 1 END AS files_importing_count,
               (p_size % 3 = 0) AS is_outdated,
               CASE WHEN (g.project_id + g.dependency_id) % 5 = 0 THEN false WHEN (g.project_id + g.dependency_id) % 5 < 4 THEN true END AS policy_allowed,
               {pick('(g.project_id + 2 * g.dependency_id) % 6', ['AGPL not allowed', 'Banned license', 'Package flagged as malicious', 'unknown license', 'copyleft'], 'other')} AS policy_reason,
               CASE WHEN g.last_year < 1997 THEN {d.ts('2001-01-01 00:00:00')} END AS removed_at,
               CAST(g.last_year AS STRING) AS last_seen_extraction_run_id
        FROM (SELECT l_suppkey AS project_id, l_partkey AS dependency_id, min(l_linenumber) AS first_line,
                     min(l_returnflag) AS first_flag, count(*) AS n, max(year(l_shipdate)) AS last_year
              FROM {{lineitem}} l GROUP BY l_suppkey, l_partkey) g
        JOIN {{part}} p ON p_partkey = g.dependency_id"""

    v["findings"] = f"""
        SELECT {LINE_ID} AS finding_id,
               l_suppkey AS project_id, CAST(l_suppkey AS STRING) || ':' || CAST(l_partkey AS STRING) AS project_dependency_id,
               l_partkey AS dependency_id,
               CASE WHEN l_partkey % 4 = 1 THEN 'GHSA-1-' || CAST(l_partkey AS STRING) ELSE {cve.format(p='l_partkey')} END AS osv_id,
               CASE WHEN l_partkey % 4 = 1 THEN {d.arr(cve.format(p='l_partkey'), "'PYSEC-' || CAST(l_partkey AS STRING)")} END AS aliases,
               CAST(year(l_shipdate) AS STRING) AS extraction_run_id, {sev} AS severity, {CVSS} AS cvss_score,
               CASE WHEN l_orderkey % 5 = 2 THEN NULL ELSE round(abs(l_discount) * 10, 2) END AS epss_score, (l_tax >= 0.07e0) AS cisa_kev,
               {pick('l_linenumber', [None, 'confirmed', 'data_flow', 'function', 'module', 'unreachable'])} AS reachability_level,
               (l_linenumber <> 5) AS is_reachable, (l_returnflag = 'R') AS suppressed, (l_orderkey % 11 = 0) AS risk_accepted,
               (l_linenumber IN (4, 5)) AS auto_ignored,
               CASE WHEN l_orderkey % 29 = 0 THEN {d.add_hours('l_shipdate', '24')} END AS runtime_confirmed_at,
               CASE WHEN l_linestatus = 'O' THEN 'open' ELSE {pick('l_orderkey % 4', ['open', 'ignored', 'resolved'], 'open')} END AS status,
               CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE CAST(floor(least(100e0, l_quantity * 2.4e0 * (1e0 - l_linenumber / 10e0)) + 0.5e0) AS BIGINT) END AS depscore,
               CASE WHEN l_linenumber <= 2 THEN round(floor(least(100e0, l_quantity * 2.4e0 * (1e0 - l_linenumber / 10e0)) + 0.5e0) * 0.85e0, 4) END AS contextual_depscore,
               l_shipdate AS detected_at, l_shipdate AS created_at, {d.add_hours('l_shipdate', '0 - l_linenumber * 240')} AS published_at,
               CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {d.arr("CAST(l_partkey % 5 AS STRING) || '.4.0'", "CAST(l_partkey % 4 AS STRING) || '.2.9'")} END AS fixed_versions,
               {pick('l_orderkey % 7', SLA_STATES)} AS sla_status,
               CASE WHEN l_orderkey % 7 < 6 THEN {d.add_hours('l_shipdate', '24 * (10 + l_linenumber * 10)')} END AS sla_deadline_at,
               CASE WHEN l_orderkey % 7 < 6 THEN {d.add_hours('l_shipdate', '18 * (10 + l_linenumber * 10)')} END AS sla_warning_at,
               CASE WHEN l_orderkey % 7 IN (2, 5) THEN {d.add_hours('l_shipdate', '24 * (10 + l_linenumber * 10)')} END AS sla_breached_at,
               CASE WHEN l_orderkey % 7 = 4 THEN {d.add_hours('l_shipdate', '7 * l_quantity')} WHEN l_orderkey % 7 = 5 THEN {d.add_hours('l_shipdate', '24 * (15 + l_linenumber * 10) + l_quantity')} END AS sla_met_at,
               CAST(NULL AS {d.ts_type}) AS sla_warning_notified_at,
               CASE WHEN l_orderkey % 13 = 0 THEN l_shipdate END AS sla_breach_notified_at
        FROM {{lineitem}} l"""
    v["vdr_hits"] = f"""
        SELECT {LINE_ID} AS hit_id,
               l_suppkey AS project_id, {cve.format(p='l_partkey')} AS osv_id, {pick('l_partkey % 8', ECOSYSTEMS)} AS ecosystem,
               (CASE l_orderkey % 4 WHEN 0 THEN {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')}
                     WHEN 1 THEN replace({DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')}, ':', '/')
                     WHEN 2 THEN lower(replace({DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')}, '_', '-')) ELSE 'group/' || {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} END) AS ref_name,
               {version.format(i='((l_suppkey + l_partkey) % 5)', p='l_partkey', s='p_size')} AS version
        FROM {{lineitem}} l JOIN {{part}} p ON p_partkey = l_partkey"""
    v["finding_events"] = f"""
        SELECT l_suppkey AS project_id, CASE WHEN l_partkey % 4 = 1 THEN 'GHSA-1-' || CAST(l_partkey AS STRING) ELSE {cve.format(p='l_partkey')} END AS osv_id,
               CASE WHEN k = 0 THEN 'detected' ELSE 'resolved' END AS event_type, CAST(year(l_shipdate) AS STRING) AS extraction_run_id,
               CAST(l_suppkey AS STRING) || ':' || CAST(l_partkey AS STRING) AS project_dependency_id,
               {d.add_hours('l_shipdate', 'k * 24 * l_linenumber')} AS created_at
        FROM {{lineitem}} l {d.series('k', 0, 1)} WHERE k = 0 OR l_linestatus = 'F'"""
    v["silence_events"] = f"""
        SELECT l_suppkey AS project_id, CAST(year(l_shipdate) AS STRING) AS extraction_run_id,
               CAST(l_suppkey AS STRING) || ':' || CAST(l_partkey AS STRING) AS project_dependency_id, {cve.format(p='l_partkey')} AS osv_id,
               {pick('l_linenumber', [None, 'confirmed', 'data_flow', 'function', 'module', 'unreachable', 'unreachable', 'module'])} AS reachability_level,
               CASE WHEN l_linenumber = 5 THEN 'orphan_transitive_unreachable' WHEN l_linenumber = 6 THEN 'dev_scope_unreachable' END AS verdict
        FROM {{lineitem}} l"""
    v["kev"] = f"SELECT {cve.format(p='p_partkey')} AS cve_id FROM {{part}} p WHERE p_size >= 45"
    v["epss"] = f"SELECT {cve.format(p='p_partkey')} AS cve_id, round(p_size / 64e0, 3) AS epss FROM {{part}} p"
    v["sla_policies"] = f"""
        SELECT CAST(n_nationkey AS BIGINT) AS organization_id, {pick('k', ['critical', 'high', 'medium', 'low'])} AS severity,
               CAST(48 * (k + 1) * (k + 1) AS BIGINT) AS max_hours, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(60 + k * 5 AS BIGINT) END AS warning_threshold_percent,
               (n_nationkey % 5 <> 4 OR k < 2) AS enabled
        FROM {{nation}} n {d.series('k', 0, 3)}"""

    v["semgrep_findings"] = f"""
        SELECT o_orderkey AS finding_id, CAST(floor(o_custkey / 15e0) AS BIGINT) AS project_id, CAST(year(o_orderdate) AS STRING) AS extraction_run_id,
               {pick('o_orderkey % 8', SAST_RULES)} AS rule_id,
               (CASE WHEN o_orderkey % 10 = 7 THEN 'node_modules/lib' WHEN o_orderkey % 10 = 3 THEN 'depscan-reports/x' ELSE 'src/m' END) || CAST(o_custkey % 40 AS STRING) || '.js' AS file_path,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 90 END AS start_line,
               {pick('o_orderkey % 5', ['ERROR', 'WARNING', 'INFO', 'critical'])} AS severity,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'fp' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 4 AS STRING) END AS fingerprint,
               {d.arr("'CWE-' || CAST(o_orderkey % 100 AS STRING)", "'CWE-1'")} AS cwe_ids,
               CASE WHEN o_orderstatus = 'F' THEN 'security' ELSE 'best-practice' END AS category,
               {pick('o_orderkey % 6', ['ignored', 'resolved'], 'open')} AS status,
               CAST(floor(o_totalprice / 5000e0) AS BIGINT) AS depscore, o_orderdate AS created_at
        FROM {{orders}} o"""
    v["iac_findings"] = f"""
        SELECT o_orderkey AS finding_id, CAST(floor(o_custkey / 15e0) AS BIGINT) AS project_id, CAST(year(o_orderdate) AS STRING) AS extraction_run_id,
               {pick('o_orderkey % 7', IAC_RULES)} AS rule_id, {pick('o_orderkey % 2', ['trivy', 'checkov'])} AS scanner,
               {pick('o_custkey % 3', ['kubernetes', 'terraform', 'dockerfile'])} AS framework,
               'infra/f' || CAST(o_custkey % 30 AS STRING) || '.yaml' AS file_path,
               {pick('o_orderkey % 6', ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'])} AS severity,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'iac' || CAST(o_custkey AS STRING) END AS fingerprint,
               {pick('o_orderkey % 5', ['ignored', 'resolved'], 'open')} AS status, (o_orderkey % 8 = 1) AS suppressed,
               (o_orderkey % 9 = 2) AS risk_accepted, (o_orderkey % 7 IN (1, 5)) AS auto_ignored,
               CAST(floor(o_totalprice / 5500e0) AS BIGINT) AS depscore
        FROM {{orders}} o"""
    v["container_findings"] = f"""
        SELECT {LINE_ID} AS finding_id,
               l_suppkey AS project_id, CAST(year(l_shipdate) AS STRING) AS extraction_run_id,
               'registry/app' || CAST(l_partkey % 6 AS STRING) AS image_reference, 'Lib' || CAST(l_partkey % 40 AS STRING) AS os_package_name,
               {cve.format(p='l_partkey')} AS cve_id, CASE WHEN l_partkey % 2 = 0 THEN 'DSA-' || CAST(l_partkey AS STRING) END AS osv_id,
               upper({sev}) AS severity, (l_tax >= 0.075e0) AS is_kev,
               {pick('l_linenumber', [None, 'module', 'unreachable', 'module'])} AS reachability_level,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'c' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey AS STRING) END AS fingerprint,
               {pick('l_orderkey % 6', ['ignored', 'resolved'], 'open')} AS status, (l_returnflag = 'R' AND l_linenumber = 1) AS suppressed, (l_orderkey % 19 = 0) AS risk_accepted,
               CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(floor(l_quantity * 2e0) AS BIGINT) END AS depscore
        FROM {{lineitem}} l"""
    dast_type = "(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in DAST_TYPES.items()) + " END)"
    v["dast_findings"] = f"""
        SELECT event_id AS finding_id, CAST(floor(user_id * 2 / 3e0) AS BIGINT) AS project_id,
               'run-' || CAST(CAST(floor(day(ts) / 10e0) AS BIGINT) AS STRING) AS dast_run_id, {dast_type} AS vulnerability_type,
               CASE WHEN event_id % 12 = 5 THEN NULL ELSE 'rule-' || CAST(event_id % 6 AS STRING) END AS rule_id,
               CASE WHEN event_id % 4 = 0 THEN 'stored payload echoed' WHEN event_id % 4 = 1 THEN 'possible sqli' ELSE 'observed' END AS message,
               {pick('event_id % 7', ['critical', 'high', 'medium', 'low', 'info', 'unknown'])} AS severity,
               {pick('event_id % 5', ['confirmed', 'high', 'medium', 'low'])} AS confidence,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'src/h' || CAST(event_id % 9 AS STRING) || '.js' END AS handler_file_path,
               CASE WHEN event_id % 6 = 1 THEN NULL ELSE 'handle' || CAST(event_id % 5 AS STRING) END AS handler_function_name,
               'https://app.example.com/api/' || CAST(user_id % 10 AS STRING) || '/items/' || CAST(event_id % 50 AS STRING) AS endpoint_url,
               {pick('event_id % 3', ['GET', 'POST', 'PUT'])} AS http_method,
               CASE WHEN event_id % 10 = 3 THEN {cve.format(p='(event_id % 2000)')} END AS linked_sca_osv_id, (event_id % 23 = 0) AS kev,
               CASE WHEN event_id % 8 = 2 THEN '   ' WHEN event_id % 8 = 4 THEN 'q=1' END AS payload_redacted,
               {pick('event_id % 5', ['ignored', 'resolved'], 'open')} AS status, (event_id % 6 = 2) AS auto_ignored, ts AS created_at
        FROM {{events}} e"""
    v["nuclei_hits"] = f"""
        SELECT CAST(o_orderkey AS BIGINT) AS hit_id, l_suppkey AS project_id, CAST(l_suppkey AS STRING) || ':' || CAST(l_partkey AS STRING) AS linked_project_dependency_id,
               {d.arr("lower(" + cve.format(p='l_partkey') + ")", "'CVE-1999-1'")} AS cve_ids, {pick('l_linenumber', ['low', 'low', 'medium', 'high', 'critical'])} AS severity, o_orderdate AS created_at
        FROM {{lineitem}} l JOIN {{orders}} o ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'"""
    v["secret_findings"] = f"""
        SELECT doc_id AS finding_id, CAST(floor(doc_id / 10e0) AS BIGINT) AS project_id, CASE WHEN doc_id % 3 = 0 THEN '2000' ELSE '2001' END AS extraction_run_id,
               {pick('doc_id % 6', ['AWS', 'GitHub', 'Stripe', 'URI', 'Slack', 'Generic'])} AS detector_type,
               CASE WHEN doc_id % 7 = 3 THEN 'web/node_modules/x' || CAST(doc_id AS STRING) || '.js' WHEN doc_id % 7 = 4 THEN '.git/config' ELSE 'src/' || source || '.env' END AS file_path,
               substring({d.extract('text', 'token = "([0-9a-f]+)"', 1)}, 1, 40) AS raw_value, n_chars % 400 AS start_line,
               (n_chars % 3 = 0) AS is_verified, (n_chars % 2 = 0) AS is_current,
               {pick('doc_id % 5', ['ignored', 'resolved'], 'open')} AS status,
               CASE WHEN n_chars % 9 = 0 THEN NULL ELSE n_chars % 101 END AS depscore
        FROM {{documents}} t WHERE {d.has('text', 'token = "[0-9a-f]+"')} OR lang IN ('en', 'de')"""
    v["malicious_findings"] = f"""
        SELECT c_custkey AS finding_id, CAST(floor(c_custkey / 15e0) AS BIGINT) AS project_id, CASE WHEN c_custkey % 2 = 0 THEN '2001' ELSE '2000' END AS extraction_run_id,
               c_custkey AS dependency_id, {pick('c_custkey % 7', MALWARE_RULES)} AS rule_id, (c_custkey % 3 = 0) AS has_feed_hit,
               CASE WHEN c_custkey % 4 = 0 THEN 'critical' WHEN c_custkey % 4 = 1 THEN 'high' END AS severity,
               CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE CAST(floor(abs(c_acctbal) / 100e0) AS BIGINT) END AS depscore,
               'k' || CAST(c_custkey % 11 AS STRING) AS finding_key, (c_custkey % 8 = 6) AS suppressed, (c_custkey % 10 = 4) AS risk_accepted,
               {pick('c_custkey % 6', ['ignored', 'ignored', 'resolved'], 'open')} AS status,
               {d.add_hours(d.ts('2001-01-01 00:00:00'), 'c_custkey')} AS created_at
        FROM {{customer}} c"""
    v["malware_feed"] = f"""
        SELECT p_partkey AS feed_id, {pick('p_size % 3', ['osv', 'ghsa'], 'osv')} AS source, 'MAL-2024-' || CAST(p_partkey AS STRING) AS source_id,
               (CASE p_partkey % 8 WHEN 1 THEN 'PyPI' WHEN 3 THEN 'Go' WHEN 4 THEN 'gem' WHEN 5 THEN 'packagist' WHEN 6 THEN 'crates.io' ELSE {pick('p_partkey % 8', ECOSYSTEMS)} END) AS ecosystem,
               CASE p_partkey % 8 WHEN 1 THEN lower({DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')}) ELSE {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} END AS package_name,
               CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_partkey % 8 = 0 AND p_size % 4 = 1 THEN NULL
                    ELSE 'v' || CAST(p_size % 5 AS STRING) || '.' || CAST(p_size % 3 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || (CASE WHEN p_size % 2 = 0 THEN '+build5' ELSE '' END) END AS version,
               CASE WHEN p_partkey % 8 = 0 AND p_size % 4 = 1 THEN (CASE WHEN p_size % 8 = 1 THEN '>= ' || CAST(p_size % 5 AS STRING) || '.1.0, < ' || CAST(p_size % 5 AS STRING) || '.3.9' ELSE 'not a range' END) END AS vulnerable_range,
               CASE WHEN p_size % 10 = 3 THEN {d.ts('2001-05-01 00:00:00')} END AS withdrawn_at,
               CASE WHEN p_size % 3 = 0 THEN 'high' END AS severity
        FROM {{part}} p"""
    v["flows"] = f"""
        SELECT {LINE_ID} AS flow_id,
               l_suppkey AS project_id, CAST(year(l_shipdate) AS STRING) AS extraction_run_id, l_partkey AS dependency_id,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN {cve.format(p='l_partkey')} ELSE {cve.format(p='(l_partkey + 1)')} END AS osv_id,
               {pick('l_orderkey % 4', ['taint_engine', 'semgrep_taint', 'atom'], 'taint_engine')} AS reachability_source,
               'src/H' || CAST(l_orderkey % 9 AS STRING) || '.js' AS entry_point_file, 'handle' || CAST(l_orderkey % 5 AS STRING) AS entry_point_method,
               l_orderkey % 120 AS entry_point_line,
               {pick('l_orderkey % 8', ['framework-route:public_unauth', 'framework-route:auth_internal', 'framework-route:offline_worker', 'framework-input:unmatched', 'http handler', 'cron job', 'cli'])} AS entry_point_tag,
               'lib{d.backslash}S' || CAST(l_partkey % 12 AS STRING) || '.js' AS sink_file, 'pkg.call' || CAST(l_partkey % 15 AS STRING) AS sink_method, l_partkey % 200 AS sink_line,
               CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE CAST(floor(1 + l_quantity / 4e0) AS BIGINT) END AS flow_length,
               {pick('l_partkey % 10', VULN_CLASSES)} AS vuln_class,
               CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE 'sig' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey % 50 AS STRING) END AS flow_signature_hash,
               (l_orderkey % 6 = 0) AS ai_error, (l_returnflag = 'A') AS is_sanitized, CASE WHEN l_orderkey % 9 = 4 THEN NULL ELSE round(0.3e0 + abs(l_discount) * 7, 2) END AS confidence,
               {pick('l_orderkey % 5', ['PUBLIC_UNAUTH', 'AUTH_INTERNAL', 'OFFLINE_WORKER', 'UNKNOWN'])} AS endpoint_class
        FROM {{lineitem}} l"""
    v["flow_suppressions"] = f"""
        SELECT DISTINCT l_suppkey AS project_id, 'sig' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey % 50 AS STRING) AS flow_signature_hash
        FROM {{lineitem}} l WHERE l_returnflag = 'R' AND l_linenumber = 7"""
    v["usages"] = f"""
        SELECT l_suppkey AS project_id, CAST(year(l_shipdate) AS STRING) AS extraction_run_id, 'src/u' || CAST(l_orderkey % 25 AS STRING) || '.js' AS file_path,
               l_orderkey % 300 AS line_number, CASE WHEN l_orderkey % 6 = 5 THEN NULL ELSE 'fn' || CAST(l_orderkey % 4 AS STRING) END AS containing_method,
               (CASE WHEN l_orderkey % 4 = 0 THEN 'com.' || replace(p_name, ' ', '.') WHEN l_orderkey % 4 = 1 THEN replace(p_name, ' ', '-') || '-' || CAST(l_partkey AS STRING)
                     WHEN l_orderkey % 4 = 2 THEN upper(replace(p_name, ' ', '_')) END) AS target_type,
               'pkg.call' || CAST(l_partkey % 15 AS STRING) || '.' || {pick('l_linenumber', ['a', 'get', 'parse', 'template', 'error', 'exec', 'load'], 'send')} AS resolved_method,
               {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} AS dependency_name, {pick('l_linenumber', ['call', 'call', 'member', 'new'], 'member')} AS usage_kind
        FROM {{lineitem}} l JOIN {{part}} p ON p_partkey = l_partkey"""
    v["imports"] = f"""
        SELECT DISTINCT l_suppkey AS project_id, {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} AS dependency_name,
               'src/u' || CAST(l_orderkey % 25 AS STRING) || '.js' AS file_path
        FROM {{lineitem}} l JOIN {{part}} p ON p_partkey = l_partkey WHERE l_linenumber <= 4"""
    v["cve_sinks"] = f"""
        SELECT {cve.format(p='p_partkey')} AS osv_id, 'Pkg.call' || CAST(p_size % 15 AS STRING) || {pick('p_size % 3', ['(*)', '.*'], '')} AS pattern
        FROM {{part}} p WHERE p_type IN ('PROMO', 'STANDARD', 'MEDIUM')"""
    v["calls"] = """
        SELECT DISTINCT l_suppkey AS project_id, 'fn' || CAST(l_partkey % 60 AS STRING) AS caller, 'fn' || CAST((l_partkey * 7 + l_linenumber) % 60 AS STRING) AS callee
        FROM {lineitem} l WHERE l_returnflag = 'A'"""
    v["call_roles"] = f"""
        SELECT DISTINCT l_suppkey AS project_id, 'fn' || CAST(l_partkey % 60 AS STRING) AS fn, {pick('l_partkey % 60 % 12', ['source', None, None, 'sanitizer', None, 'sink', 'sanitizer', None, 'sink'])} AS role FROM {{lineitem}} l"""
    v["sbom_edges"] = """
        SELECT project_id, 'root' AS parent, CAST(dependency_id AS STRING) AS child FROM {project_dependencies} d WHERE is_direct AND ecosystem <> 'nuget'
        UNION ALL SELECT a.project_id, CAST(a.dependency_id AS STRING), CAST(b.dependency_id AS STRING) FROM {project_dependencies} a JOIN {project_dependencies} b ON a.project_id = b.project_id AND CAST(floor((b.dependency_id - 1) / 2e0) AS BIGINT) = a.dependency_id AND b.dependency_id > 0"""
    v["native_bindings"] = f"""
        SELECT 'language' AS scope, {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} AS package_identifier, {pick('p_partkey % 8', ECOSYSTEMS)} AS package_ecosystem,
               'libso' || CAST(p_partkey % 40 AS STRING) || '.so' AS soname, '/app/' || CAST(p_partkey AS STRING) AS install_path FROM {{part}} p
        UNION ALL
        SELECT DISTINCT 'os', 'lib' || CAST(p_partkey % 40 AS STRING), CAST(NULL AS STRING), 'libso' || CAST((p_partkey + k) % 40 AS STRING) || '.so', '/usr/lib/' || CAST(k AS STRING)
        FROM {{part}} p {d.series('k', 0, 2)}"""
    v["package_files"] = f"""
        SELECT DISTINCT 'lib' || CAST(p_partkey % 37 AS STRING) AS package, 'libso' || CAST(p_partkey % 40 AS STRING) || '.so' AS basename FROM {{part}} p"""
    v["loaded_libraries"] = "SELECT DISTINCT 'libso' || CAST(p_size % 40 AS STRING) || '.so' AS soname FROM {part} p WHERE p_type = 'LARGE' AND p_size < 25"

    v["ledger"] = f"""
        SELECT o_orderkey AS transaction_id, CAST(o_custkey % 25 AS BIGINT) AS organization_id, CAST(floor(o_custkey / 15e0) AS BIGINT) AS project_id,
               (CASE o_orderstatus WHEN 'O' THEN 'usage_deduction' WHEN 'F' THEN {pick('o_orderkey % 3', ['topup', 'grant', 'refund'])} ELSE 'usage_deduction' END) AS kind,
               CAST(floor(o_totalprice) AS BIGINT) * (CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 < 2 THEN 1 ELSE -1 END) AS amount_cents,
               (CASE o_orderpriority WHEN '1-URGENT' THEN 'scan' WHEN '2-HIGH' THEN 'fix' WHEN '3-MEDIUM' THEN 'chat' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'review' END) AS feature,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'compute' ELSE 'ai' END AS event_type,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 17 AS BIGINT) END AS quantity, CAST(floor(o_totalprice * 0.4e0) AS BIGINT) AS cost_cents,
               o_orderdate AS created_at
        FROM {{orders}} o"""
    v["billing_balances"] = f"""
        SELECT organization_id, sum(amount_cents) + (CASE WHEN organization_id % 4 = 1 THEN 50 ELSE 0 END) AS balance_cents
        FROM {{ledger}} b GROUP BY organization_id"""
    v["fix_outcomes"] = f"""
        SELECT o_orderkey AS outcome_id, CAST(o_custkey % 25 AS BIGINT) AS organization_id,
               CASE WHEN o_orderkey % 12 = 5 THEN NULL ELSE {pick('o_custkey % 8', ECOSYSTEMS)} END AS ecosystem,
               (CASE o_orderpriority WHEN '1-URGENT' THEN 'bump_version' WHEN '2-HIGH' THEN 'code_patch' WHEN '3-MEDIUM' THEN 'add_wrapper' WHEN '4-NOT SPECIFIED' THEN 'pin_transitive' ELSE 'remove_unused' END) AS strategy,
               CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE {pick('o_custkey % 3', ['xss', 'sql-injection', 'ssrf'])} END AS vulnerability_type,
               CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE (o_orderkey % 2 = 0) END AS is_direct_dep, (o_orderstatus <> 'F') AS success,
               CASE WHEN o_orderstatus = 'F' THEN {pick('o_orderkey % 10', ['build_error', 'test_failure', 'timeout', 'empty_diff', 'auth_failed', 'api_error', 'no_safe_version', 'breaking_changes', 'unknown'])} END AS failure_reason,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS previous_attempt_id, (o_orderstatus = 'O' AND o_orderkey % 5 <> 0) AS pr_merged, (o_orderkey % 14 = 0) AS fix_reverted,
               CAST(o_orderkey % 900 AS BIGINT) AS duration_seconds, CASE WHEN o_orderkey % 6 = 1 THEN CAST(1 + o_orderkey % 5 AS BIGINT) END AS human_quality_rating,
               CAST(o_orderkey % 97 AS BIGINT) AS cost_cents, o_orderdate AS created_at
        FROM {{orders}} o"""
    v["debt_snapshots"] = f"""
        SELECT CAST(o_custkey % 25 AS BIGINT) AS organization_id, CAST(o_orderdate AS DATE) AS snapshot_date, max(CAST(floor(o_totalprice / 1000e0) AS BIGINT)) AS score
        FROM {{orders}} o GROUP BY o_custkey % 25, CAST(o_orderdate AS DATE)"""
    v["scan_jobs"] = f"""
        SELECT o_orderkey AS job_id, CAST(floor(o_custkey / 15e0) AS BIGINT) AS project_id, CAST(o_custkey % 25 AS BIGINT) AS organization_id, CAST(year(o_orderdate) AS STRING) AS run_id,
               {pick('o_orderkey % 5', ['extraction', 'extraction', 'fix', 'dast'], 'extraction')} AS job_type,
               {pick('o_orderkey % 7', ['queued', 'processing', 'failed', 'cancelled'], 'completed')} AS status,
               CASE WHEN o_orderkey % 7 = 1 AND o_orderkey % 3 > 0 THEN 'machine-' || CAST(o_custkey % 12 AS STRING) END AS machine_id,
               o_orderdate AS created_at, {d.add_hours('o_orderdate', '1 + o_orderkey % 9')} AS completed_at
        FROM {{orders}} o"""
    v["notification_events"] = f"""
        SELECT event_id, {pick('event_id % 4', ['vulnerability_discovered', 'policy_violation', 'dependency_added', 'status_changed'])} AS event_type, event_type AS raw_type,
               CAST(user_id % 25 AS BIGINT) AS organization_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(floor(user_id * 2 / 3e0) AS BIGINT) END AS project_id,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id % 5 AS BIGINT) END AS team_id,
               (CASE WHEN value >= 90 THEN 'critical' WHEN value >= 40 THEN 'high' WHEN value >= 10 THEN 'normal' ELSE 'low' END) AS priority,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(least(value, 100e0)) AS BIGINT) END AS depscore,
               CASE WHEN event_id % 7 = 3 THEN NULL ELSE event_type || props END AS dedup_key, ts AS created_at,
               {pick('event_id % 6', ['pending', 'dispatched', 'failed'], 'dispatched')} AS status, CAST(event_id % 5 AS BIGINT) AS dispatch_attempts
        FROM {{events}} e"""
    v["webhook_deliveries"] = f"""
        SELECT event_id AS webhook_id, 'd' || CAST(user_id AS STRING) || '-' || CAST(event_id % 40 AS STRING) AS delivery_id, {pick('user_id % 2', ['github', 'gitlab'])} AS provider,
               CASE event_type WHEN 'view' THEN 'check_run' WHEN 'click' THEN 'push' ELSE event_type END AS event_type, CAST(user_id % 25 AS BIGINT) AS organization_id,
               {pick('event_id % 4', ['processed', 'error', 'skipped'], 'processed')} AS processing_status, ts AS created_at
        FROM {{events}} e"""
    v["notification_rules"] = f"""
        SELECT 'o' || CAST(n_nationkey AS STRING) || '-' || CAST(k AS STRING) AS rule_id, 'organization' AS scope, CAST(n_nationkey AS BIGINT) AS scope_id, {pick('k', ['all', 'weekly_digest'], 'all')} AS trigger_type,
               (n_nationkey % 6 <> 5) AS active, CASE WHEN n_nationkey % 3 = 0 THEN CAST(30 AS BIGINT) END AS min_depscore_threshold,
               CASE WHEN n_nationkey % 8 = 2 THEN {d.ts('2024-03-01 00:00:00')} END AS snoozed_until, {d.arr("'slack-' || CAST(n_nationkey AS STRING)", "'email'")} AS destinations
        FROM {{nation}} n {d.series('k', 0, 1)}
        UNION ALL SELECT 't' || CAST(r_regionkey AS STRING), 'team', CAST(r_regionkey AS BIGINT), 'all', r_regionkey <> 4, CAST(50 AS BIGINT), CAST(NULL AS {d.ts_type}), {d.arr("'jira-' || CAST(r_regionkey AS STRING)")} FROM {{region}} r
        UNION ALL SELECT 'p' || CAST(s_suppkey AS STRING), 'project', s_suppkey, 'all', s_suppkey % 4 > 0, CAST(NULL AS BIGINT), CAST(NULL AS {d.ts_type}), {d.arr("'slack-' || CAST(s_nationkey AS STRING)", "'pager-' || CAST(s_suppkey AS STRING)")} FROM {{supplier}} s"""
    v["feed_runs"] = f"""
        SELECT event_id AS run_id, {pick('user_id % 4', ['osv', 'ghsa', 'kev'], 'epss')} AS source, {pick('event_id % 6', ['completed', 'running', 'failed', 'completed', 'dlq'], 'completed')} AS state,
               ts AS started_at, {d.add_hours('ts', 'event_id % 3')} AS updated_at, CASE WHEN event_id % 11 = 0 THEN NULL ELSE {d.add_hours('ts', 'event_id % 4')} END AS completed_at
        FROM {{events}} e"""
    v["routes"] = f"""
        SELECT page_id AS route_id, 'src/H' || CAST(page_id % 9 AS STRING) || '.js' AS file_path, page_id % 120 AS line_number, page_id % 120 + 15 AS end_line,
               'handle' || CAST(page_id % 5 AS STRING) AS handler_name, {pick('page_id % 4', ['GET', 'POST', 'PUT'])} AS http_method,
               {pick('page_id % 4', ['express', 'fastapi', 'flask'], 'express')} AS framework,
               '/' || (CASE page_id % 4 WHEN 0 THEN ':lang' WHEN 1 THEN '{{{{lang}}}}' WHEN 2 THEN '<string:lang>' ELSE substring({d.extract('url', 'example[.][a-z]+/([a-z]+)/', 1)}, 1, 2) END) || '/'
                   || (CASE WHEN page_id % 5 = 0 THEN ':id' WHEN page_id % 5 = 1 THEN {d.extract('url', '/([0-9]+)', 1)} WHEN page_id % 5 = 2 THEN ':id/details' ELSE ':id' END) AS route_pattern,
               {pick('page_id % 4', ['PUBLIC_UNAUTH', 'AUTH_INTERNAL', 'OFFLINE_WORKER'], 'UNKNOWN')} AS classification, page_id % 3 AS project_key
        FROM {{pages}} g"""
    v["requests"] = f"""
        SELECT page_id AS finding_id, url AS endpoint_url, {pick('page_id % 3', ['get', 'POST', 'PUT'])} AS http_method, page_id % 3 AS project_key FROM {{pages}} g"""
    v["corpus"] = f"""
        SELECT doc_id AS case_id, {pick('doc_id % 4', ['express', 'petclinic', 'bat', 'fastify'])} AS repo, {pick('doc_id % 3', ['npm', 'maven', 'cargo'])} AS ecosystem, 'CVE-2020-' || CAST(doc_id AS STRING) AS cve,
               CASE WHEN quality = 1 THEN 'unreachable' ELSE {pick('doc_id % 4', ['module', 'function', 'data_flow'], 'confirmed')} END AS expected_reachability, (doc_id % 9 <> 4) AS observed,
               CASE WHEN doc_id % 9 = 4 THEN NULL WHEN toxic = 1 THEN {pick('doc_id % 3', ['unreachable', 'module', 'function'])} WHEN quality = 1 THEN 'unreachable' ELSE {pick('doc_id % 4', ['module', 'function', 'data_flow'], 'confirmed')} END AS observed_reachability
        FROM {{labels}} b"""
    v["ai_usage"] = f"""
        SELECT conv_id, turn, CAST(conv_id % 25 AS BIGINT) AS organization_id, CASE role WHEN 'system' THEN NULL ELSE role END AS tool_name,
               CAST(length(text) AS BIGINT) AS input_tokens, CAST(length(text) % 97 AS BIGINT) AS output_tokens, length(text) / 1000e0 AS estimated_cost, (turn % 5 <> 3) AS success,
               {pick('turn % 4', ['spec_inference', 'fp_filter', 'chat'], 'model_fallback')} AS feature,
               {d.add_hours(d.ts('2024-01-01 00:00:00'), 'conv_id % 700 + turn')} AS created_at
        FROM {{conversations}} t"""
    v["memories"] = f"""
        SELECT vec_id AS memory_id, embedding, CAST(label % 5 AS BIGINT) AS organization_id, {pick('label % 3', ['fix', 'policy'], 'note')} AS category,
               CASE WHEN vec_id % 9 = 0 THEN {d.ts('2024-01-01 00:00:00')} END AS expires_at
        FROM {{embeddings}} t"""
    v["maintainer_snapshots"] = f"""
        SELECT l_partkey AS package_id, l_shipdate AS observed_at, {d.arr("'dev' || CAST(l_suppkey % 3 AS STRING)", "'dev' || CAST(l_partkey % 3 AS STRING)")} AS maintainer_handles,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE 'm' || CAST(l_suppkey % 4 AS STRING) || '@example.com' END AS primary_maintainer_email,
               CASE WHEN l_linenumber % 2 = 0 THEN 's' || CAST(l_suppkey % 2 AS STRING) END AS signing_config_hash, CASE WHEN l_orderkey % 3 = 0 THEN 'p' || CAST(l_orderkey % 2 AS STRING) END AS postinstall_hash,
               CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) AS snapshot_id
        FROM {{lineitem}} l"""
    v["commits"] = f"""
        SELECT 'sha' || CAST(o_orderkey AS STRING) AS sha, o_custkey AS author_id, CAST(floor(o_custkey / 15e0) AS BIGINT) AS package_id, o_orderdate AS committed_at,
               CAST(floor(o_totalprice / 700e0) AS BIGINT) AS insertions, CAST(floor(o_totalprice / 1100e0) AS BIGINT) AS deletions, 1 + o_orderkey % 30 AS files_changed, 10 + o_orderkey % 60 AS message_length, o_orderkey % 24 AS commit_hour
        FROM {{orders}} o"""
    v["commit_anomalies"] = """
        SELECT 'sha' || CAST(o_orderkey AS STRING) AS sha, CAST(floor(o_totalprice / 5000e0) AS BIGINT) AS anomaly_score FROM {orders} o WHERE o_orderstatus = 'F'"""
    v["image_catalog"] = f"""
        SELECT 'registry/app' || CAST(p_partkey % 6 AS STRING) AS base_image, 'alt-' || CAST(p_partkey AS STRING) AS image, {pick('p_partkey % 4', ['chainguard', 'distroless', 'alpine', 'debian'])} AS provider,
               CAST(p_size AS BIGINT) AS cve_count, CAST(p_size * 2 AS BIGINT) AS drop_in_score, (p_size % 3 <> 0) AS has_shell
        FROM {{part}} p"""
    v["banned_versions"] = f"""
        SELECT CAST(p_partkey % 25 AS BIGINT) AS organization_id, CAST(NULL AS BIGINT) AS team_id, p_partkey AS dependency_id, CAST(p_size % 5 AS STRING) || '.3.' || CAST(p_partkey % 7 AS STRING) AS banned_version FROM {{part}} p WHERE p_type = 'PROMO'
        UNION ALL SELECT CAST(NULL AS BIGINT), CAST(p_partkey % 5 AS BIGINT), p_partkey, CAST(p_size % 5 AS STRING) || '.2.' || CAST(p_partkey % 7 AS STRING) FROM {{part}} p WHERE p_type = 'SMALL'"""
    v["malicious_allowlist"] = f"""
        SELECT p_partkey * 10 + k AS allowlist_id, {DEP_NAME.format(p='p_partkey', n='p_name', b='p_brand')} AS package_name, {pick('p_partkey % 8', ECOSYSTEMS)} AS ecosystem, CAST(p_partkey % 25 AS BIGINT) AS organization_id,
               CASE WHEN k = 1 THEN CAST(p_size % 5 AS STRING) || '.1.' || CAST(p_partkey % 7 AS STRING) END AS version, CASE WHEN p_size % 8 = 3 THEN {d.ts('2001-02-01 00:00:00')} END AS revoked_at,
               {d.add_hours(d.ts('2001-01-01 00:00:00'), 'p_partkey * 3 + k')} AS added_at
        FROM {{part}} p {d.series('k', 0, 1)} WHERE p_type IN ('LARGE', 'ECONOMY')"""
    v["license_obligations"] = """
        SELECT DISTINCT (CASE p_type WHEN 'STANDARD' THEN 'MIT' WHEN 'MEDIUM' THEN 'Apache-2.0' WHEN 'ECONOMY' THEN 'GPL-3.0' WHEN 'LARGE' THEN 'AGPL-3.0' END) AS license_spdx_id,
               p_type IN ('ECONOMY', 'LARGE') AS is_copyleft, 'keep the notice of ' || lower(p_type) AS summary, CASE WHEN p_type = 'LARGE' THEN 'full text' END AS full_text
        FROM {part} p WHERE p_type IN ('STANDARD', 'MEDIUM', 'ECONOMY', 'LARGE')"""
    v["fix_tasks"] = "SELECT o_custkey AS task_id, CAST(8 + o_custkey % 4 AS BIGINT) AS planned_fixes, {status} AS status, o_orderkey AS fix_id FROM {{orders}} o".format(
        status=pick("o_orderkey % 6", ["completed", "completed", "completed", "failed", "rejected"], "executing")).replace("{{", "{").replace("}}", "}")
    v["pull_requests"] = f"""
        SELECT o_orderkey AS pr_id, CAST(floor(o_custkey / 15e0) AS BIGINT) AS project_id, (CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'merged' ELSE 'closed' END) AS status,
               {pick('o_orderkey % 3', ['passed', 'failed'])} AS check_result, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged_at
        FROM {{orders}} o"""
    v["module_imports"] = f"""
        SELECT l_suppkey AS project_id, 'dist' || CAST(l_partkey % 60 AS STRING) AS package, replace(p_name, ' ', '.') || (CASE WHEN l_linenumber > 3 THEN '.sub' || CAST(l_linenumber AS STRING) ELSE '' END) AS module
        FROM {{lineitem}} l JOIN {{part}} p ON p_partkey = l_partkey"""
    v["module_questions"] = """
        SELECT DISTINCT l_suppkey AS project_id, l_partkey % 500 AS question_id, replace(p_name, ' ', '.') AS module, 'dist' || CAST(l_partkey % 60 AS STRING) AS owner
        FROM {lineitem} l JOIN {part} p ON p_partkey = l_partkey WHERE l_linenumber = 1"""
    return v


_PLACEHOLDER = re.compile(r"\{(\w+)\}")
SPARK = SparkDialect()
DUCK = DuckDialect()
SPARK_VIEWS = _views(SPARK)
DUCK_VIEWS = _views(DUCK)


def spark_text(name: str, sf_dir: str) -> str:
    """The Spark SQL text of a view, with every referenced view inlined."""
    if name in BASE_TABLES:
        return f"parquet.`{sf_dir}/{name}.parquet`"

    def sub(m: re.Match) -> str:
        inner = spark_text(m.group(1), sf_dir)
        return inner if m.group(1) in BASE_TABLES else f"({inner})"

    body = SPARK_VIEWS[name].replace("{{", "\x00").replace("}}", "\x01")
    return _PLACEHOLDER.sub(sub, body).replace("\x00", "{").replace("\x01", "}")


def duck_view(name: str) -> tuple[str, list[str]]:
    """The DuckDB text of a view and the names it needs."""
    body = DUCK_VIEWS[name].replace("{{", "\x00").replace("}}", "\x01")
    needs = [n for n in _PLACEHOLDER.findall(body) if n not in BASE_TABLES]
    return _PLACEHOLDER.sub(lambda m: m.group(1), body).replace("\x00", "{").replace("\x01", "}"), needs


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the domain views it mentions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in duck_view(name)[1]:
            visit(need)
        order.append(name)

    for word in re.findall(r"\b[a-z_]+\b", sql):
        if word in DUCK_VIEWS:
            visit(word)
    ctes = ",\n".join(f"{n} AS ({duck_view(n)[0]})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ctes + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ctes + ",\n" + body[len("WITH"):]
    return "WITH " + ctes + "\n" + body
