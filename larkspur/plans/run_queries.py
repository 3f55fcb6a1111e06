"""Registered queries for run-over-run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import runs, sla
from larkspur.operators.filters import active_run
from larkspur.plans.common import findings_now, instant, listing, stamp
from larkspur.plans.domain import EVENTS_NOW, FINDINGS_NOW, LEDGER_NOW
from larkspur.plans.registry import query

C = F.col
TS = "'%Y-%m-%d %H:%M:%S'"
NOW = f"TIMESTAMP '{FINDINGS_NOW}'"

ACTIVE = "cur AS (SELECT f.*, d.name AS dep_name, d.version AS dep_version FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id JOIN project_dependencies d USING (project_dependency_id))"
PREVIOUS = "prev AS (SELECT f.*, d.name AS dep_name, d.version AS dep_version FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.previous_extraction_run_id = f.extraction_run_id JOIN project_dependencies d USING (project_dependency_id))"
CARRY = f"""{ACTIVE}, {PREVIOUS}, carried AS (SELECT * FROM (SELECT n.finding_id, o.status, o.suppressed, o.risk_accepted, coalesce(o.detected_at, n.detected_at) AS detected_at, o.sla_status, o.sla_deadline_at, o.sla_warning_at,
    CASE WHEN o.runtime_confirmed_at IS NOT NULL THEN 'confirmed' ELSE n.reachability_level END AS reachability_level,
    row_number() OVER (PARTITION BY n.finding_id ORDER BY n.project_dependency_id = o.project_dependency_id DESC, n.dep_version = o.dep_version DESC, o.detected_at ASC NULLS LAST, o.finding_id) AS rn
    FROM cur n JOIN prev o ON o.project_id = n.project_id AND o.dep_name = n.dep_name AND o.osv_id = n.osv_id) WHERE rn = 1)"""


@query("jn14_carry_forward", f"""
    WITH {CARRY} SELECT n.finding_id, c.finding_id IS NOT NULL AS carried, CASE WHEN c.finding_id IS NULL THEN n.status ELSE c.status END AS status, CASE WHEN c.finding_id IS NULL THEN n.suppressed ELSE c.suppressed END AS suppressed,
      CASE WHEN c.finding_id IS NULL THEN n.sla_status ELSE c.sla_status END AS sla_status, strftime(coalesce(c.detected_at, n.detected_at), {TS}) AS detected_at, CASE WHEN c.finding_id IS NULL THEN n.reachability_level ELSE c.reachability_level END AS reachability_level
    FROM cur n LEFT JOIN carried c USING (finding_id)""")
def _(v):
    out = runs.carry_forward(active_run(v.findings, v.projects), active_run(v.findings, v.projects, "previous"), v.project_dependencies)
    return out.select("finding_id", "carried", "status", "suppressed", "sla_status", stamp("detected_at"), "reachability_level")


@query("jn14_carry_sast", """
    WITH n AS (SELECT s.* FROM semgrep_findings s JOIN projects p ON p.project_id = s.project_id AND p.active_extraction_run_id = s.extraction_run_id),
    o AS (SELECT s.* FROM semgrep_findings s JOIN projects p ON p.project_id = s.project_id AND p.previous_extraction_run_id = s.extraction_run_id)
    SELECT n.finding_id, coalesce((SELECT o.status FROM o WHERE o.project_id = n.project_id AND CASE WHEN n.fingerprint IS NOT NULL THEN o.fingerprint = n.fingerprint ELSE o.rule_id = n.rule_id AND o.file_path = n.file_path AND o.start_line IS NOT DISTINCT FROM n.start_line END
      ORDER BY o.created_at DESC, o.finding_id DESC LIMIT 1), n.status) AS status FROM n""")
def _(v):
    s = v.semgrep_findings
    return runs.carry_sast(active_run(s, v.projects), active_run(s, v.projects, "previous")).select("finding_id", "status")


@query("jn14_carry_malicious", """
    SELECT n.finding_id, coalesce((SELECT o.status FROM malicious_findings o WHERE o.extraction_run_id = '2000' AND o.status = 'ignored' AND o.project_id = n.project_id AND o.finding_key = n.finding_key ORDER BY o.created_at DESC, o.finding_id DESC LIMIT 1), n.status) AS status
    FROM malicious_findings n WHERE n.extraction_run_id = '2001'""")
def _(v):
    m = v.malicious_findings
    return runs.carry_malicious(m.filter(C("extraction_run_id") == "2001"), m.filter(C("extraction_run_id") == "2000")).select("finding_id", "status")


def _carried_sql(table: str, same: str, columns: list[str]) -> str:
    """Rows of the active run with the columns of the last matching row of the previous one."""
    side = lambda run: f"SELECT s.* FROM {table} s JOIN projects p ON p.project_id = s.project_id AND p.{run}_extraction_run_id = s.extraction_run_id"
    chosen = ", ".join(f"CASE WHEN c.finding_id IS NULL THEN n.{x} ELSE c.{x} END AS {x}" for x in columns)
    return f"""
    WITH n AS ({side("active")}), o AS ({side("previous")}),
    c AS (SELECT n.finding_id, {", ".join("o." + x for x in columns)} FROM n JOIN o ON o.project_id = n.project_id AND {same} QUALIFY row_number() OVER (PARTITION BY n.finding_id ORDER BY o.finding_id DESC) = 1)
    SELECT n.finding_id, {chosen} FROM n LEFT JOIN c USING (finding_id)"""


def _active_and_previous(v, rows):
    return active_run(rows, v.projects), active_run(rows, v.projects, "previous")


@query("jn14_carry_secret", _carried_sql("secret_findings", "o.detector_type = n.detector_type AND o.file_path = n.file_path AND o.raw_value IS NOT DISTINCT FROM n.raw_value", ["status"]))
def _(v):
    return runs.carry_secret(*_active_and_previous(v, v.secret_findings), value="raw_value").select("finding_id", "status")


@query("jn14_carry_iac", _carried_sql("iac_findings", "o.scanner = n.scanner AND o.fingerprint = n.fingerprint", ["status", "suppressed", "risk_accepted"]))
def _(v):
    return runs.carry_iac(*_active_and_previous(v, v.iac_findings)).select("finding_id", "status", "suppressed", "risk_accepted")


@query("jn14_carry_container", _carried_sql("container_findings", "o.fingerprint = n.fingerprint", ["status", "suppressed", "risk_accepted"]))
def _(v):
    return runs.finalize_families({"container": v.container_findings}, v.projects)["container"].select("finding_id", "status", "suppressed", "risk_accepted")


@query("jn15_unmatched", f"""
    WITH {ACTIVE}, {PREVIOUS} SELECT finding_id FROM cur WHERE NOT EXISTS (SELECT 1 FROM prev o WHERE o.project_id = cur.project_id AND o.dep_name = cur.dep_name AND o.osv_id = cur.osv_id)""")
def _(v):
    return runs.unmatched(active_run(v.findings, v.projects), active_run(v.findings, v.projects, "previous"), v.project_dependencies).select("finding_id")


REOPENED = f"""{ACTIVE}, {PREVIOUS}, ev AS (SELECT cur.*, CASE WHEN EXISTS (SELECT 1 FROM findings h JOIN project_dependencies d USING (project_dependency_id) JOIN projects p ON p.project_id = h.project_id
      WHERE h.project_id = cur.project_id AND h.osv_id = cur.osv_id AND d.name = cur.dep_name AND h.extraction_run_id IS DISTINCT FROM p.active_extraction_run_id AND h.extraction_run_id IS DISTINCT FROM p.previous_extraction_run_id) THEN 'reopened' ELSE 'detected' END AS event_type
    FROM cur WHERE NOT EXISTS (SELECT 1 FROM prev o WHERE o.project_id = cur.project_id AND o.dep_name = cur.dep_name AND o.osv_id = cur.osv_id))"""


@query("jn16_is_reopened", f"WITH {REOPENED} SELECT finding_id, event_type FROM ev")
def _(v):
    fresh = runs.unmatched(active_run(v.findings, v.projects), active_run(v.findings, v.projects, "previous"), v.project_dependencies)
    return runs.classify_reopened(fresh, v.findings, v.projects, v.project_dependencies).select("finding_id", "event_type")


@query("str12_lifecycle_events", f"""
    WITH {REOPENED} SELECT DISTINCT e.project_id, e.osv_id, e.project_dependency_id, CASE WHEN p.previous_extraction_run_id IS NULL THEN 'detected' ELSE e.event_type END AS event_type FROM ev e JOIN projects p USING (project_id)""")
def _(v):
    return runs.lifecycle_events(v.findings, v.projects, v.project_dependencies, now=findings_now()).select("project_id", "osv_id", "project_dependency_id", "event_type")


@query("jn12_confirm_from_runtime", """
    SELECT finding_id, prior_level, runtime_hit_id, contextual_depscore FROM (SELECT f.finding_id, f.reachability_level AS prior_level, h.hit_id AS runtime_hit_id, coalesce(f.contextual_depscore, CAST(coalesce(f.depscore, 0) AS DOUBLE)) AS contextual_depscore,
      row_number() OVER (PARTITION BY f.finding_id ORDER BY CASE h.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, h.created_at, h.hit_id) AS rn
      FROM findings f JOIN nuclei_hits h ON h.project_id = f.project_id AND h.linked_project_dependency_id = f.project_dependency_id AND (upper(h.cve_ids[1]) = upper(f.osv_id) OR (f.aliases IS NOT NULL AND upper(h.cve_ids[1]) = upper(f.aliases[1])))
      WHERE f.reachability_level IS DISTINCT FROM 'confirmed') WHERE rn = 1""")
def _(v):
    return runs.confirm_from_runtime(v.findings, v.nuclei_hits).select("finding_id", "prior_level", "runtime_hit_id", "contextual_depscore")


@query("jn24_suppressed_flag", "SELECT f.flow_id, EXISTS (SELECT 1 FROM flow_suppressions s WHERE s.project_id = f.project_id AND s.flow_signature_hash = f.flow_signature_hash) AS is_suppressed FROM flows f")
def _(v):
    return runs.suppressed_flag(v.flows, v.flow_suppressions).select("flow_id", "is_suppressed")


@query("jn36_carry_forward_dast", """
    SELECT n.finding_id, coalesce((SELECT o.status FROM dast_findings o WHERE o.dast_run_id = 'run-1' AND o.status <> 'open' AND o.project_id = n.project_id AND o.rule_id IS NOT DISTINCT FROM n.rule_id AND o.vulnerability_type = n.vulnerability_type
      AND ((o.handler_file_path = n.handler_file_path AND o.handler_function_name IS NOT DISTINCT FROM n.handler_function_name) OR (o.handler_file_path IS NULL AND n.handler_file_path IS NULL AND o.endpoint_url = n.endpoint_url AND o.http_method = n.http_method))
      ORDER BY o.created_at DESC, o.finding_id DESC LIMIT 1), n.status) AS status FROM dast_findings n WHERE n.dast_run_id = 'run-2'""")
def _(v):
    d = v.dast_findings
    return runs.carry_forward_dast(d.filter(C("dast_run_id") == "run-2"), d.filter(C("dast_run_id") == "run-1")).select("finding_id", "status")


STATE = ["status", "suppressed", "risk_accepted", "sla_status", "sla_deadline_at", "sla_warning_at"]
COMMIT = f"""{CARRY}, base AS (SELECT n.* REPLACE ({", ".join(f"CASE WHEN c.finding_id IS NULL THEN n.{x} ELSE c.{x} END AS {x}" for x in STATE)}, coalesce(c.detected_at, n.detected_at) AS detected_at), c.finding_id IS NOT NULL AS carried FROM cur n LEFT JOIN carried c USING (finding_id)),
    fe AS (SELECT project_id, osv_id, min(created_at) AS t FROM finding_events WHERE event_type = 'detected' GROUP BY 1, 2),
    due AS (SELECT f.project_id, f.finding_id, coalesce(fe.t, f.created_at) AS d, s.max_hours AS h, coalesce(s.warning_threshold_percent, 75) AS w FROM base f JOIN projects p ON p.project_id = f.project_id JOIN organizations o ON o.organization_id = p.organization_id
      JOIN sla_policies s ON s.organization_id = p.organization_id AND s.severity = f.severity AND s.enabled LEFT JOIN fe ON fe.project_id = f.project_id AND fe.osv_id = f.osv_id
      WHERE f.sla_status IS NULL AND NOT f.suppressed AND NOT f.risk_accepted AND o.sla_paused_at IS NULL),
    clock AS (SELECT project_id, finding_id, d, d + to_hours(h) AS deadline, CASE WHEN {NOW} > d + to_hours(h) THEN 'breached' WHEN {NOW} >= d + to_seconds(h * w * 36) THEN 'warning' ELSE 'on_track' END AS state FROM due)"""
LOG = f"{REOPENED}, log AS (SELECT DISTINCT e.project_id, e.osv_id, e.extraction_run_id, e.project_dependency_id, CASE WHEN p.previous_extraction_run_id IS NULL THEN 'detected' ELSE e.event_type END AS event_type FROM ev e JOIN projects p USING (project_id))"
FAMILY_SQL = {
    "sast": """SELECT n.project_id, CAST(n.finding_id AS VARCHAR) AS finding_id, coalesce((SELECT o.status FROM semgrep_findings o JOIN projects p ON p.project_id = o.project_id AND p.previous_extraction_run_id = o.extraction_run_id WHERE o.project_id = n.project_id
        AND CASE WHEN n.fingerprint IS NOT NULL THEN o.fingerprint = n.fingerprint ELSE o.rule_id = n.rule_id AND o.file_path = n.file_path AND o.start_line IS NOT DISTINCT FROM n.start_line END ORDER BY o.created_at DESC, o.finding_id DESC LIMIT 1), n.status) AS status
        FROM semgrep_findings n JOIN projects p ON p.project_id = n.project_id AND p.active_extraction_run_id = n.extraction_run_id""",
    "malicious": """SELECT n.project_id, CAST(n.finding_id AS VARCHAR), coalesce((SELECT o.status FROM malicious_findings o JOIN projects p ON p.project_id = o.project_id AND p.previous_extraction_run_id = o.extraction_run_id WHERE o.status = 'ignored' AND o.project_id = n.project_id AND o.finding_key = n.finding_key
        ORDER BY o.created_at DESC, o.finding_id DESC LIMIT 1), n.status) FROM malicious_findings n JOIN projects p ON p.project_id = n.project_id AND p.active_extraction_run_id = n.extraction_run_id""",
} | {
    name: f"""SELECT n.project_id, CAST(n.finding_id AS VARCHAR), coalesce((SELECT o.status FROM {table} o JOIN projects p ON p.project_id = o.project_id AND p.previous_extraction_run_id = o.extraction_run_id WHERE o.project_id = n.project_id AND {same} ORDER BY o.finding_id DESC LIMIT 1), n.status)
        FROM {table} n JOIN projects p ON p.project_id = n.project_id AND p.active_extraction_run_id = n.extraction_run_id"""
    for name, table, same in (
        ("secret", "secret_findings", "o.detector_type = n.detector_type AND o.file_path = n.file_path AND o.raw_value IS NOT DISTINCT FROM n.raw_value"),
        ("iac", "iac_findings", "o.scanner = n.scanner AND o.fingerprint = n.fingerprint"), ("container", "container_findings", "o.fingerprint = n.fingerprint"))
}
FAMILY_ROWS = "fam AS (" + " UNION ALL ".join(f"SELECT '{name}' AS family, * FROM ({text})" for name, text in FAMILY_SQL.items()) + ")"


def _commit(v) -> runs.Commit:
    families = {
        "sast": v.semgrep_findings, "malicious": v.malicious_findings, "secret": v.secret_findings.withColumn("redacted_value", C("raw_value")),
        "iac": v.iac_findings, "container": v.container_findings,
    }
    return runs.finalize_runs(v.findings, v.finding_events, v.project_dependencies, v.projects, v.organizations, v.sla_policies, now=findings_now(), families=families, keep=[])


@query("finalize_runs_summary", f"""
    WITH {COMMIT}, {LOG.replace(ACTIVE + ", " + PREVIOUS + ", ", "")}, {FAMILY_ROWS},
    c AS (SELECT project_id, count(*) AS k FROM base WHERE carried GROUP BY 1),
    e AS (SELECT project_id, count(*) FILTER (WHERE event_type = 'detected') AS nw, count(*) FILTER (WHERE event_type = 'reopened') AS re FROM log GROUP BY 1),
    cr AS (SELECT project_id, count(*) FILTER (WHERE severity = 'critical' OR cisa_kev) AS k FROM ev GROUP BY 1),
    rm AS (SELECT d.project_id, count(*) AS k FROM project_dependencies d JOIN projects p USING (project_id) WHERE p.active_extraction_run_id IS NOT NULL AND removed_at IS NULL AND last_seen_extraction_run_id IS DISTINCT FROM p.active_extraction_run_id GROUP BY 1),
    sl AS (SELECT project_id, count(*) AS k FROM clock GROUP BY 1),
    fm AS (SELECT project_id, {", ".join(f"count(*) FILTER (WHERE family = '{n}') AS {n}_rows" for n in FAMILY_SQL)} FROM fam GROUP BY 1)
    SELECT p.project_id, coalesce(c.k, 0) AS vulns_carried, coalesce(e.nw, 0) AS vulns_new, coalesce(e.re, 0) AS vulns_reopened, coalesce(cr.k, 0) AS critical_new, coalesce(rm.k, 0) AS deps_removed, coalesce(sl.k, 0) AS sla_computed, {", ".join(f"coalesce({n}_rows, 0) AS {n}_rows" for n in FAMILY_SQL)}
    FROM projects p LEFT JOIN c USING (project_id) LEFT JOIN e USING (project_id) LEFT JOIN cr USING (project_id) LEFT JOIN rm USING (project_id) LEFT JOIN sl USING (project_id) LEFT JOIN fm USING (project_id) WHERE p.active_extraction_run_id IS NOT NULL""")
def _(v):
    return _commit(v).summary


@query("finalize_runs_rows", f"""
    WITH {COMMIT}
    SELECT b.finding_id, b.carried, b.status, b.suppressed, b.risk_accepted, coalesce(k.state, b.sla_status) AS sla_status, strftime(coalesce(k.deadline, b.sla_deadline_at), {TS}) AS sla_deadline_at, strftime(coalesce(k.d, b.detected_at), {TS}) AS detected_at
    FROM base b LEFT JOIN clock k USING (finding_id)""")
def _(v):
    return _commit(v).rows.select("finding_id", "carried", "status", "suppressed", "risk_accepted", "sla_status", stamp("sla_deadline_at"), stamp("detected_at"))


@query("finalize_runs_log", f"WITH {LOG} SELECT project_id, osv_id, event_type, extraction_run_id, project_dependency_id FROM log")
def _(v):
    return _commit(v).log.select("project_id", "osv_id", "event_type", "extraction_run_id", "project_dependency_id")


@query("finalize_runs_families", f"WITH {FAMILY_ROWS} SELECT family, project_id, finding_id, status FROM fam")
def _(v):
    out = None
    for name, rows in _commit(v).families.items():
        part = rows.select(F.lit(name).alias("family"), "project_id", C("finding_id").cast("string").alias("finding_id"), "status")
        out = part if out is None else out.unionByName(part)
    return out


@query("win7_sla_clock", f"""
    WITH fe AS (SELECT project_id, osv_id, min(created_at) AS t FROM finding_events WHERE event_type = 'detected' GROUP BY 1, 2),
    r AS (SELECT f.finding_id, coalesce(fe.t, f.created_at) AS d, s.max_hours AS h, coalesce(s.warning_threshold_percent, 75) AS w FROM findings f JOIN projects p USING (project_id) JOIN organizations o ON o.organization_id = p.organization_id
      JOIN sla_policies s ON s.organization_id = p.organization_id AND s.severity = f.severity AND s.enabled LEFT JOIN fe ON fe.project_id = f.project_id AND fe.osv_id = f.osv_id
      WHERE f.sla_status IS NULL AND NOT f.suppressed AND NOT f.risk_accepted AND o.sla_paused_at IS NULL)
    SELECT finding_id, strftime(d + to_hours(h), {TS}) AS sla_deadline_at, strftime(d + to_seconds(h * w * 36), {TS}) AS sla_warning_at,
      CASE WHEN {NOW} > d + to_hours(h) THEN 'breached' WHEN {NOW} >= d + to_seconds(h * w * 36) THEN 'warning' ELSE 'on_track' END AS sla_status FROM r""")
def _(v):
    out = sla.sla_clock(v.findings, v.finding_events, v.projects, v.organizations, v.sla_policies, now=findings_now())
    return out.select("finding_id", stamp("sla_deadline_at"), stamp("sla_warning_at"), "sla_status")


@query("str10_clock_alerts", f"""
    SELECT finding_id, CASE WHEN b THEN 'breach' ELSE 'warning' END AS alert, strftime(CASE WHEN b THEN sla_deadline_at ELSE sla_warning_at END, {TS}) AS alert_at
    FROM (SELECT *, sla_deadline_at > TIMESTAMP '2001-06-01' AND sla_deadline_at <= TIMESTAMP '2001-07-01' AS b, sla_status = 'on_track' AND sla_warning_at > TIMESTAMP '2001-06-01' AND sla_warning_at <= TIMESTAMP '2001-07-01' AND sla_deadline_at > TIMESTAMP '2001-07-01' AS w FROM findings WHERE sla_status IN ('on_track', 'warning')) WHERE b OR w""")
def _(v):
    out = sla.clock_alerts(v.findings, since=instant("2001-06-01 00:00:00"), until=instant("2001-07-01 00:00:00"))
    return out.select("finding_id", "alert", stamp("alert_at"))


@query("str10_resume_shift", f"""
    SELECT finding_id, strftime(CASE WHEN sla_status IN ('on_track', 'warning') THEN sla_deadline_at + INTERVAL 5400 SECOND ELSE sla_deadline_at END, {TS}) AS sla_deadline_at FROM findings""")
def _(v):
    return sla.resume_shift(v.findings, pause_seconds=5400).select("finding_id", stamp("sla_deadline_at"))


STATES = ", ".join(f"count(*) FILTER (WHERE sla_status = '{s}') AS {s}" for s in sla.STATES)
PCT = "CASE WHEN met + resolved_late > 0 THEN CAST(floor(met * 100.0 / (met + resolved_late) + 0.5) AS BIGINT) ELSE 100 END"


@query("agg11_sla_compliance", f"SELECT *, {PCT} AS compliance_percent FROM (SELECT organization_id, {STATES} FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id GROUP BY 1)")
def _(v):
    rows = active_run(v.findings, v.projects).join(v.projects.select("project_id", "organization_id"), "project_id")
    return sla.sla_compliance(rows, ["organization_id"])


@query("agg12_mttr", """
    SELECT organization_id, severity, count(*) AS resolved, floor(sum(date_diff('second', coalesce(detected_at, f.created_at), sla_met_at)) / 3600e0 / count(*) * 10 + 0.5) / 10 AS mttr_hours
    FROM findings f JOIN projects p USING (project_id) WHERE sla_status IN ('met', 'resolved_late') AND sla_met_at IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return sla.mttr(v.findings.join(v.projects.select("project_id", "organization_id"), "project_id"), ["organization_id", "severity"])


@query("agg13_sla_by_month", """
    WITH m AS (SELECT DISTINCT p.organization_id, f.finding_id, f.sla_status, strftime(unnest([sla_met_at, sla_breached_at, CASE WHEN sla_status = 'exempt' THEN f.created_at END]), '%Y-%m') AS month FROM findings f JOIN projects p USING (project_id))
    SELECT organization_id, month, count(*) FILTER (WHERE sla_status = 'met') AS met, count(*) FILTER (WHERE sla_status = 'resolved_late') AS met_late, count(*) FILTER (WHERE sla_status = 'breached') AS breached, count(*) FILTER (WHERE sla_status = 'exempt') AS exempt
    FROM m WHERE month IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return sla.sla_by_month(v.findings.join(v.projects.select("project_id", "organization_id"), "project_id"), ["organization_id"])


@query("snk3_export_sla", f"SELECT p.organization_id, f.finding_id, p.name AS project_name, f.sla_status, strftime(f.sla_deadline_at, {TS}) AS sla_deadline_at FROM findings f JOIN projects p USING (project_id) WHERE sla_status IS NOT NULL")
def _(v):
    flat, _summary = sla.export_sla(v.findings, v.projects)
    return flat.select("organization_id", "finding_id", "project_name", "sla_status", stamp("sla_deadline_at"))


@query("agg22_dedup_last", """
    SELECT project_id, image_reference, os_package_name, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, image_reference, os_package_name ORDER BY extraction_run_id DESC, finding_id DESC) AS rn FROM container_findings) WHERE rn = 1""")
def _(v):
    key = ["project_id", "image_reference", "os_package_name"]
    return runs.dedup(v.container_findings, key, ["extraction_run_id", "finding_id"]).select(*key, "finding_id")


@query("set4_advisory_delta", """
    WITH n AS (SELECT DISTINCT project_id, dependency_id, osv_id FROM findings WHERE extraction_run_id = '2001'), o AS (SELECT DISTINCT project_id, dependency_id, osv_id FROM findings WHERE extraction_run_id = '2000')
    SELECT *, 'detected' AS event_type FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def _(v):
    run = lambda r: v.findings.filter(C("extraction_run_id") == r)
    return runs.advisory_delta(run("2001"), run("2000"), ["project_id", "dependency_id", "osv_id"])


@query("set5_snapshot_diff", """
    WITH n AS (SELECT DISTINCT project_id, dependency_id FROM findings WHERE extraction_run_id = '2001'), o AS (SELECT DISTINCT project_id, dependency_id FROM findings WHERE extraction_run_id = '2000')
    SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.dependency_id, o.dependency_id) AS dependency_id, CASE WHEN o.project_id IS NULL THEN 'added' WHEN n.project_id IS NULL THEN 'removed' ELSE 'kept' END AS state FROM n FULL JOIN o ON o.project_id = n.project_id AND o.dependency_id = n.dependency_id""")
def _(v):
    run = lambda r: v.findings.filter(C("extraction_run_id") == r)
    return runs.snapshot_diff(run("2000"), run("2001"), ["project_id", "dependency_id"])


@query("set6_same_set", """
    WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY observed_at DESC, snapshot_id DESC) AS rn FROM maintainer_snapshots) WHERE rn = 1)
    SELECT s.package_id, count(*) FILTER (WHERE list_sort(list_distinct(s.maintainer_handles)) = list_sort(list_distinct(l.maintainer_handles))) AS same_as_latest FROM maintainer_snapshots s JOIN l USING (package_id) GROUP BY 1""")
def _(v):
    from larkspur.operators.matching import latest_snapshot, same_set

    last = latest_snapshot(v.maintainer_snapshots, ["package_id"], "observed_at", "snapshot_id").select("package_id", C("maintainer_handles").alias("latest"))
    rows = v.maintainer_snapshots.select("package_id", "maintainer_handles").join(last, "package_id")
    return rows.groupBy("package_id").agg(F.count_if(same_set(C("maintainer_handles"), C("latest"))).alias("same_as_latest"))


@query("set7_corpus_diff", """
    WITH r(l, k) AS (VALUES ('unreachable', 0), ('module', 1), ('function', 2), ('data_flow', 3), ('confirmed', 4)),
    o AS (SELECT project_id, project_dependency_id, osv_id, max(coalesce(k, 1)) AS k FROM silence_events s LEFT JOIN r ON l = reachability_level WHERE extraction_run_id = '2000' GROUP BY 1, 2, 3),
    n AS (SELECT project_id, project_dependency_id, osv_id, max(coalesce(k, 1)) AS k FROM silence_events s LEFT JOIN r ON l = reachability_level WHERE extraction_run_id = '2001' GROUP BY 1, 2, 3)
    SELECT coalesce(n.project_id, o.project_id) AS repo, coalesce(n.project_dependency_id, o.project_dependency_id) AS package, coalesce(n.osv_id, o.osv_id) AS osv_id,
      CASE WHEN n.k IS NULL THEN 'ONLY_OLD' WHEN o.k IS NULL THEN 'ONLY_NEW' WHEN o.k = n.k THEN 'SAME' WHEN o.k >= 2 AND n.k < 2 THEN 'ALARM' WHEN o.k = 1 AND n.k = 0 THEN 'REVIEW' ELSE 'INFO' END AS transition
    FROM n FULL JOIN o ON o.project_id = n.project_id AND o.project_dependency_id = n.project_dependency_id AND o.osv_id = n.osv_id""")
def _(v):
    s = v.silence_events.select(C("project_id").alias("repo"), C("project_dependency_id").alias("package"), "osv_id", C("reachability_level").alias("level"), "extraction_run_id")
    return runs.corpus_diff(s.filter(C("extraction_run_id") == "2000"), s.filter(C("extraction_run_id") == "2001"))


@query("set8_retention", """
    SELECT finding_id FROM findings f JOIN projects p USING (project_id) WHERE p.active_extraction_run_id IS NULL OR f.extraction_run_id = p.active_extraction_run_id OR f.extraction_run_id = p.previous_extraction_run_id""")
def _(v):
    return runs.retention(v.findings, v.projects).select("finding_id")


@query("set9_orphan_runs", f"""
    SELECT DISTINCT j.project_id, j.run_id AS extraction_run_id FROM scan_jobs j JOIN projects p USING (project_id) WHERE job_type = 'extraction' AND j.status IN ('failed', 'cancelled') AND j.created_at < TIMESTAMP '{LEDGER_NOW}' - INTERVAL 24 HOUR
      AND j.run_id IS DISTINCT FROM p.active_extraction_run_id AND j.run_id IS DISTINCT FROM p.previous_extraction_run_id""")
def _(v):
    return runs.orphan_runs(v.scan_jobs, v.projects, now=instant(LEDGER_NOW))


@query("set10_retention_days", f"SELECT run_id FROM feed_runs WHERE completed_at IS NULL OR completed_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY")
def _(v):
    return runs.retention_days(v.feed_runs, "completed_at", now=instant(EVENTS_NOW), days=14).select("run_id")


@query("snk2_upsert_update", """
    WITH o AS (SELECT * FROM semgrep_findings WHERE extraction_run_id = '2000'), n AS (SELECT * FROM semgrep_findings WHERE extraction_run_id = '2001'),
    a AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id, file_path ORDER BY created_at DESC, finding_id DESC) AS rn FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id, file_path ORDER BY created_at DESC, finding_id DESC) AS rn FROM o)
    SELECT project_id, rule_id, file_path, finding_id FROM a WHERE rn = 1 UNION ALL SELECT project_id, rule_id, file_path, finding_id FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.project_id = b.project_id AND n.rule_id = b.rule_id AND n.file_path = b.file_path)""")
def _(v):
    key, order = ["project_id", "rule_id", "file_path"], ["created_at", "finding_id"]
    run = lambda r: v.semgrep_findings.filter(C("extraction_run_id") == r)
    return runs.upsert(runs.dedup(run("2000"), key, order), run("2001"), key, order).select(*key, "finding_id")


@query("snk2_upsert_ignore", """
    WITH o AS (SELECT * FROM semgrep_findings WHERE extraction_run_id = '2000'), n AS (SELECT * FROM semgrep_findings WHERE extraction_run_id = '2001'),
    a AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id, file_path ORDER BY created_at, finding_id) AS rn FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id, file_path ORDER BY created_at DESC, finding_id DESC) AS rn FROM o)
    SELECT project_id, rule_id, file_path, finding_id FROM b WHERE rn = 1 UNION ALL SELECT project_id, rule_id, file_path, finding_id FROM a WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.project_id = a.project_id AND o.rule_id = a.rule_id AND o.file_path = a.file_path)""")
def _(v):
    key, order = ["project_id", "rule_id", "file_path"], ["created_at", "finding_id"]
    run = lambda r: v.semgrep_findings.filter(C("extraction_run_id") == r)
    return runs.upsert(runs.dedup(run("2000"), key, order), run("2001"), key, order, mode="ignore").select(*key, "finding_id")


@query("snk6_replace_if_newer", f"""
    WITH ok AS (SELECT project_id FROM projects WHERE policy_evaluated_at IS NULL OR policy_evaluated_at <= TIMESTAMP '2001-08-01')
    SELECT project_id, finding_id FROM iac_findings WHERE extraction_run_id = '2000' AND project_id NOT IN (SELECT project_id FROM ok) UNION ALL SELECT project_id, finding_id FROM iac_findings WHERE extraction_run_id = '2001' AND project_id IN (SELECT project_id FROM ok)""")
def _(v):
    run = lambda r: v.iac_findings.filter(C("extraction_run_id") == r).select("project_id", "finding_id")
    starts = v.projects.select("project_id", instant("2001-08-01 00:00:00").alias("eval_start"))
    return runs.replace_if_newer(run("2000"), run("2001"), starts, v.projects)


DRIFT = """r(l, k) AS (VALUES ('unreachable', 0), ('module', 1), ('function', 2), ('data_flow', 3), ('confirmed', 4)), both_runs AS (SELECT * FROM projects WHERE active_extraction_run_id IS NOT NULL AND previous_extraction_run_id IS NOT NULL),
    prev AS (SELECT s.*, coalesce(verdict, reachability_level) AS prior_verdict, k FROM silence_events s JOIN both_runs b ON b.project_id = s.project_id AND b.previous_extraction_run_id = s.extraction_run_id JOIN r ON l = reachability_level WHERE k <= 1),
    cur AS (SELECT s.*, k FROM silence_events s JOIN both_runs b ON b.project_id = s.project_id AND b.active_extraction_run_id = s.extraction_run_id JOIN r ON l = reachability_level),
    drift AS (SELECT prev.project_id, prior_verdict, count(*) AS upgraded_count, count(*) FILTER (WHERE cur.k >= 2) AS silence_fn_count, list_sort(list(DISTINCT cur.reachability_level)) AS to_levels FROM prev JOIN cur USING (project_id, project_dependency_id, osv_id) WHERE cur.k > prev.k GROUP BY 1, 2)"""


@query("agg27_silence_drift", f"WITH {DRIFT} SELECT project_id, prior_verdict, upgraded_count, silence_fn_count, array_to_string(to_levels, ',') AS to_levels FROM drift")
def _(v):
    return runs.silence_drift(v.silence_events, v.projects).withColumn("to_levels", listing("to_levels"))


@query("agg28_drift_summary", f"""
    WITH {DRIFT} SELECT prior_verdict, CAST(sum(upgraded_count) AS BIGINT) AS upgraded_count, CAST(sum(silence_fn_count) AS BIGINT) AS silence_fn_count, count(DISTINCT project_id) AS projects, CAST(grouping(prior_verdict) AS BIGINT) AS is_total, sum(silence_fn_count) = 0 AS ok FROM drift GROUP BY ROLLUP (prior_verdict)""")
def _(v):
    return runs.drift_summary(runs.silence_drift(v.silence_events, v.projects))
