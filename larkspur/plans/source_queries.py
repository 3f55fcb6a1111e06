"""Registered queries for readers, sinks, policies and detectors.

Report files are first written by Spark from the given tables, in the shared folder, then read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import policy, runs, sla
from larkspur.operators.filters import active_run
from larkspur.plans.common import stamp
from larkspur.plans.registry import query
from larkspur.session import new_folder
from larkspur.sources import merges, readers, writers

C = F.col


def json_files(v, rows: DataFrame, label: str) -> str:
    path = new_folder(v.spark, label)
    rows.write.json(path, compression="lz4")
    return path


def item(v):
    """Line items with their part, as raw material for report documents."""
    return v.lineitem.join(v.part.select(C("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey")


def sbom_docs(v) -> DataFrame:
    """One bill of materials per order line: the line is the root, its part the only other component."""
    ref = F.concat(F.lit("pkg:npm/"), F.regexp_replace("p_name", " ", "-"), F.lit("@v1."), C("l_linenumber").cast("string"), F.lit("."), C("l_partkey").cast("string"))
    root = F.concat_ws("-", F.lit("order"), C("l_orderkey").cast("string"), C("l_linenumber").cast("string"), C("l_partkey").cast("string"), C("l_suppkey").cast("string"), F.floor(C("l_extendedprice") * 100).cast("string"))
    none = F.lit(None).cast("string")
    part = F.struct(ref.alias("bom-ref"), F.when(C("l_linenumber") % 2 == 0, F.regexp_replace("p_name", " ", "-")).alias("name"), none.alias("version"), ref.alias("purl"))
    app = F.struct(root.alias("bom-ref"), F.lit("app").alias("name"), F.lit("1").alias("version"), none.alias("purl"))
    return item(v).select(
        F.struct(F.struct(root.alias("bom-ref")).alias("component")).alias("metadata"), F.array(app, part).alias("components"),
        F.array(F.struct(root.alias("ref"), F.array(ref).alias("dependsOn"))).alias("dependencies"))


REF = "'pkg:npm/' || replace(p_name, ' ', '-') || '@v1.' || CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR)"


@query("src1_read_sbom", f"""
    SELECT l_orderkey AS order_key, {REF} AS component, replace(p_name, ' ', '-') AS name, '1.' || CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR) AS version, true AS is_direct FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(v):
    components, edges, _roots = readers.read_sbom(v.spark, json_files(v, sbom_docs(v), "sbom"), multi_line=False)
    direct = edges.filter("from_root").select("document", C("child").alias("component"), F.lit(True).alias("is_direct"))
    rows = components.join(direct, ["document", "component"], "left")
    return rows.select(F.regexp_extract("document", "order-([0-9]+)-[0-9-]+$", 1).cast("long").alias("order_key"), "component", "name", "version", "is_direct")


@query("udf5_extract_purls", f"SELECT l_orderkey AS order_key, {REF} AS purl FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(v):
    components, _edges, _roots = readers.read_sbom(v.spark, json_files(v, sbom_docs(v), "sbom"), multi_line=False)
    return policy.extract_purls(components).select(F.regexp_extract("document", "order-([0-9]+)-[0-9-]+$", 1).cast("long").alias("order_key"), "purl")


@query("src2_read_osv_feed", """
    SELECT osv_id, package_name, severity, first_introduced, first_fixed, n_ranges, ranges_missing FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'MAL-' ELSE 'GHSA-' END || CAST(p_partkey AS VARCHAR) AS osv_id, replace(p_name, ' ', '-') AS package_name,
      CASE WHEN p_size % 3 = 0 THEN 'medium' WHEN p_size % 3 = 1 THEN 'critical' END AS severity, CASE WHEN p_size % 5 > 0 THEN '0' END AS first_introduced, CASE WHEN p_size % 5 > 0 THEN '1.2.0' END AS first_fixed, CAST(CASE WHEN p_size % 5 > 0 THEN 2 ELSE 0 END AS BIGINT) AS n_ranges, p_size % 5 = 0 AS ranges_missing FROM part)""")
def _(v):
    p = v.part
    event = lambda i, f: F.struct(F.lit(i).cast("string").alias("introduced"), F.lit(f).cast("string").alias("fixed"))
    events = F.array(event("0", None), event(None, "1.2.0"), event("2.0.0", None), event(None, "2.1.0"))
    affected = F.array(F.struct(
        F.struct(F.regexp_replace("p_name", " ", "-").alias("name"), F.lit("npm").alias("ecosystem")).alias("package"),
        F.when(C("p_size") % 5 > 0, F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events")))).alias("ranges")))
    docs = p.select(
        F.concat(F.when(C("p_size") % 4 == 0, "MAL-").otherwise("GHSA-"), C("p_partkey").cast("string")).alias("id"), affected.alias("affected"),
        F.when(C("p_size") % 3 == 0, F.struct(F.lit("MODERATE").alias("severity"))).alias("database_specific"),
        F.when(C("p_size") % 3 == 1, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("score")))).alias("severity"))
    out = readers.read_osv_feed(v.spark, json_files(v, docs, "osv"), multi_line=False)
    first = F.try_element_at("ranges", F.lit(1))
    return out.select("osv_id", "package_name", "severity", first["introduced"].alias("first_introduced"), first["fixed"].alias("first_fixed"), F.coalesce(F.size("ranges"), F.lit(0)).cast("long").alias("n_ranges"), "ranges_missing")


@query("src3_read_vdr", """
    SELECT 'CVE-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS osv_id, CASE WHEN l_orderkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS ref_name, '1.' || CAST(l_partkey AS VARCHAR) AS version, 'high' AS severity,
      CASE WHEN l_orderkey % 2 = 0 THEN 7.5e0 ELSE 7e0 END AS cvss_score, CASE WHEN l_orderkey % 2 = 0 THEN '9.9.9' END AS fixed, l_orderkey % 2 = 1 OR l_linenumber = 1 AS is_reachable FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(v):
    new = C("l_orderkey") % 2 == 0
    version = F.concat(F.lit("1."), C("l_partkey").cast("string"))
    ref = F.concat(F.lit("pkg:npm/"), F.regexp_replace("p_name", " ", "-"), F.lit("@"), version)
    vuln = F.struct(
        F.concat_ws("-", F.lit("CVE"), C("l_orderkey").cast("string"), C("l_linenumber").cast("string")).alias("id"), F.when(~new, F.lit("high")).alias("severity"), F.when(~new, C("p_name")).alias("component"), F.when(~new, version).alias("version"),
        F.when(new, F.array(F.struct(F.lit("high").alias("severity"), F.lit(7.5).alias("score")))).alias("ratings"),
        F.when(new, F.array(F.struct(ref.alias("ref"), F.array(F.struct(F.lit("9.9.9").alias("version"), F.lit("unaffected").alias("status"))).alias("versions")))).alias("affects"),
        F.when(new & (C("l_linenumber") == 1), F.array(F.struct(F.lit("depscan:insights").alias("name"), F.lit("Used in 3 places").alias("value")))).alias("properties"))
    docs = item(v).select(F.array(vuln).alias("vulnerabilities"))
    out = readers.read_vdr(v.spark, json_files(v, docs, "vdr"), multi_line=False)
    return out.select("osv_id", "ref_name", "version", "severity", "cvss_score", F.array_join("fixed_versions", ",").alias("fixed"), "is_reachable")


@query("src4_read_flow_slices", """
    SELECT 'pkg:npm/' || replace(p_name, ' ', '-') || '@1' AS purl, 'src/a' || CAST(l_orderkey % 9 AS VARCHAR) || '.js' AS entry_point_file, 'sink' || CAST(l_partkey AS VARCHAR) AS sink_method, CAST(l_linenumber AS BIGINT) AS flow_length FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber >= 2""")
def _(v):
    def node(i):
        return F.struct(
            F.concat(F.lit("src/a"), (C("l_orderkey") % 9).cast("string"), F.lit(".js")).alias("parentFileName"), i.cast("bigint").alias("lineNumber"), F.when(i == C("l_linenumber"), F.concat(F.lit("sink"), C("l_partkey").cast("string"))).alias("fullName"))

    docs = item(v).select(F.transform(F.sequence(F.lit(1), C("l_linenumber")), node).alias("flows"), F.array(F.concat(F.lit("pkg:npm/"), F.regexp_replace("p_name", " ", "-"), F.lit("@1"))).alias("purls"))
    return readers.read_flow_slices(v.spark, json_files(v, docs, "flows"), multi_line=False).select("purl", "entry_point_file", "sink_method", "flow_length")


@query("src5_read_usage_slices", """
    SELECT 'src/u' || CAST(l_orderkey % 25 AS VARCHAR) || '.js' AS file_path, CAST(l_linenumber AS BIGINT) AS line_number, p_name AS target_name, 'call' || CAST(l_partkey AS VARCHAR) AS resolved_method FROM lineitem JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 'unknown', CAST(l_linenumber AS BIGINT), 'run', 'Type' || CAST(l_partkey AS VARCHAR) || '.run' FROM lineitem""")
def _(v):
    usage = F.struct(F.struct(C("p_name").alias("name"), C("l_linenumber").cast("bigint").alias("lineNumber")).alias("targetObj"), F.array(F.struct(F.concat(F.lit("call"), C("l_partkey").cast("string")).alias("resolvedMethod"))).alias("invokedCalls"))
    docs = item(v).select(
        F.array(F.struct(F.concat(F.lit("src/u"), (C("l_orderkey") % 25).cast("string"), F.lit(".js")).alias("fileName"), F.array(usage).alias("usages"))).alias("objectSlices"),
        F.array(F.struct(F.concat(F.lit("Type"), C("l_partkey").cast("string")).alias("name"), F.array(F.struct(F.lit("run").alias("callName"), C("l_linenumber").cast("bigint").alias("lineNumber"))).alias("procedures"))).alias("userDefinedTypes"))
    return readers.read_usage_slices(v.spark, json_files(v, docs, "usages"), multi_line=False).select("file_path", "line_number", "target_name", "resolved_method")


@query("src6_read_secret_report", """
    SELECT detector_type, file_path, start_line, bool_or(is_verified) AS is_verified FROM secret_findings WHERE file_path NOT LIKE '%node_modules/%' AND file_path NOT LIKE '.git/%' GROUP BY 1, 2, 3""")
def _(v):
    f = v.secret_findings
    docs = f.select(C("detector_type").alias("DetectorName"), C("raw_value").alias("Raw"), C("is_verified").alias("Verified"), F.struct(F.struct(F.struct(C("file_path").alias("file"), C("start_line").alias("line")).alias("Filesystem")).alias("Data")).alias("SourceMetadata"))
    out = readers.read_secret_report(v.spark, json_files(v, docs, "secrets"))
    return out.groupBy("detector_type", "file_path", "start_line").agg(F.bool_or("is_verified").alias("is_verified"))


@query("src7_read_kev_epss", "SELECT e.cve_id, e.epss, k.cve_id IS NOT NULL AS listed FROM epss e LEFT JOIN kev k USING (cve_id)")
def _(v):
    kev = readers.read_kev(v.spark, json_files(v, v.kev.select(F.array(F.struct(C("cve_id").alias("cveID"))).alias("vulnerabilities")), "kev"), multi_line=False)
    path = new_folder(v.spark, "epss")
    v.epss.select(C("cve_id").alias("cve"), "epss", F.lit("0.5").alias("percentile")).write.option("header", "true").csv(path)
    return readers.read_epss(v.spark, path).join(kev.withColumn("_k", F.lit(True)), "cve_id", "left").select("cve_id", "epss", F.coalesce("_k", F.lit(False)).alias("listed"))


@query("src8_read_table", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def _(v):
    rows = readers.read_table(v.spark, "orders", v.sf_dir).filter(C("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("snk1_write_snapshot", "SELECT extraction_run_id, count(*) AS n, count(*) FILTER (WHERE status = 'rewritten') AS rewritten FROM (SELECT extraction_run_id, CASE WHEN extraction_run_id = '2001' THEN 'rewritten' ELSE status END AS status FROM findings WHERE NOT (extraction_run_id = '2001' AND suppressed)) GROUP BY 1")
def _(v):
    path = new_folder(v.spark, "snapshot")
    rows = v.findings.select("finding_id", "project_id", "status", "suppressed", "extraction_run_id")
    writers.write_snapshot(rows, path)
    writers.write_snapshot(rows.filter((C("extraction_run_id") == "2001") & ~C("suppressed")).withColumn("status", F.lit("rewritten")), path)
    out = v.spark.read.schema(rows.schema).parquet(path)
    return out.groupBy("extraction_run_id").agg(F.count("*").alias("n"), F.count_if(C("status") == "rewritten").alias("rewritten"))


@query("snk4_export_notice", """
    WITH r AS (SELECT d.project_id, coalesce(license, 'Unknown') AS license, d.name, d.version FROM project_dependencies d JOIN dependencies x USING (dependency_id) WHERE removed_at IS NULL), g AS (SELECT DISTINCT r.project_id, r.license, o.summary, o.is_copyleft, o.full_text FROM r LEFT JOIN license_obligations o ON o.license_spdx_id = r.license)
    SELECT project_id, line, count(*) AS n FROM (SELECT project_id, '  - ' || name || '@' || version AS line FROM r UNION ALL SELECT project_id, 'LICENSE: ' || license FROM g UNION ALL SELECT project_id, 'Obligations: ' || summary FROM g WHERE summary IS NOT NULL UNION ALL SELECT project_id, repeat('-', 70) FROM g UNION ALL SELECT project_id, full_text FROM g WHERE is_copyleft AND full_text IS NOT NULL
      UNION ALL SELECT DISTINCT project_id, 'THIRD-PARTY SOFTWARE NOTICES AND INFORMATION' FROM r UNION ALL SELECT DISTINCT project_id, repeat('=', 70) FROM r UNION ALL SELECT DISTINCT r.project_id, 'Project: ' || p.name FROM r JOIN projects p USING (project_id)) GROUP BY 1, 2""")
def _(v):
    path = new_folder(v.spark, "notice")
    writers.export_notice(writers.notice_lines(v.project_dependencies, v.dependencies, v.projects, v.license_obligations), path)
    return v.spark.read.text(path).groupBy(C("project_id").cast("long").alias("project_id"), C("value").alias("line")).agg(F.count("*").alias("n"))


@query("snk5_export_audit_log", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-10'")
def _(v):
    path = new_folder(v.spark, "audit")
    rows = v.events.select("event_id", "event_type", C("ts").alias("created_at"))
    writers.export_audit_log(rows, path, actions=["error", "signup"], since=F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return v.spark.read.schema("event_id bigint, event_type string, created_at string").option("header", "true").csv(path).select("event_id", "event_type")


def judged(v) -> DataFrame:
    facts = v.dependencies.select("dependency_id", "license", "score", C("flagged_malicious").alias("is_malicious"), F.lit(None).cast("string").alias("malicious_reason"))
    rows = v.project_dependencies.filter(C("removed_at").isNull()).select("project_id", "project_dependency_id", "dependency_id", "name").join(facts, "dependency_id").join(v.projects.select("project_id", "importance"), "project_id")
    return policy.evaluate(rows, policy.DEFAULT_RULES)


POLICY = """j AS (SELECT d.project_id, d.project_dependency_id, d.name, CASE WHEN flagged_malicious THEN 'Package flagged as malicious: unknown' WHEN importance >= 1.3 AND license LIKE '%GPL-3.0%' THEN 'Banned license for high-importance project: ' || license
    WHEN importance >= 1.3 AND score < 40 THEN 'Low reputation score for high-importance project: ' || CAST(score AS VARCHAR) WHEN importance < 1.3 AND license LIKE '%AGPL%' THEN 'AGPL not allowed' END AS reason FROM project_dependencies d JOIN dependencies x USING (dependency_id) JOIN projects p ON p.project_id = d.project_id WHERE removed_at IS NULL)"""


@query("udf1_package_policy", f"WITH {POLICY} SELECT project_dependency_id, reason IS NULL AS allowed, coalesce(reason, '') AS reasons FROM j")
def _(v):
    return judged(v).select("project_dependency_id", C("policy_result.allowed").alias("allowed"), F.array_join("policy_result.reasons", ",").alias("reasons"))


@query("udf1_package_policy_python", f"WITH {POLICY} SELECT project_dependency_id, reason IS NULL OR reason <> 'AGPL not allowed' AS allowed FROM j")
def _(v):
    def decide(batch):
        import pandas as pd

        agpl = (batch["importance"] < 1.3) & batch["license"].fillna("").str.contains("AGPL") & ~batch["is_malicious"]
        return pd.DataFrame({"allowed": ~agpl, "reasons": [["AGPL not allowed"] if a else [] for a in agpl]})

    rows = judged(v).drop("policy_result")
    return policy.evaluate_python(rows, decide).select("project_dependency_id", C("policy_result.allowed").alias("allowed"))


@query("udf2_project_status", f"WITH {POLICY} SELECT project_id, CASE WHEN count(reason) > 0 THEN 'Non-Compliant' ELSE 'Compliant' END AS status, count(reason) AS violations FROM j GROUP BY 1")
def _(v):
    return policy.project_status(judged(v))[0].select("project_id", "status", "violations")


@query("udf2_project_violations", f"WITH {POLICY} SELECT project_id, name || ': ' || reason AS violation FROM j WHERE reason IS NOT NULL")
def _(v):
    return policy.project_status(judged(v))[1]


@query("udf3_pr_check", """
    SELECT pr_id, bool_and(NOT (license LIKE '%AGPL%')) AS passed, count(*) FILTER (WHERE license LIKE '%AGPL%') AS violations FROM (SELECT o.o_orderkey AS pr_id, coalesce(d.license, '') AS license FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN dependencies d ON d.dependency_id = l.l_partkey) GROUP BY 1""")
def _(v):
    changes = v.orders.select(C("o_orderkey").alias("pr_id")).join(v.lineitem.select(C("l_orderkey").alias("pr_id"), C("l_partkey").alias("dependency_id")), "pr_id").join(v.dependencies.select("dependency_id", "license"), "dependency_id")
    return policy.pr_check(changes, [policy.Rule("agpl", "license LIKE '%AGPL%'", "'AGPL not allowed'")])


TRIGGERS = [
    ("loud", "priority IN ('critical', 'high') AND depscore >= 40", "upper(priority) || ': ' || event_type"),
    ("policy", "event_type = 'policy_violation' AND project_id IS NOT NULL", "'Policy violated in project ' || CAST(project_id AS STRING)"),
    ("unscored", "depscore IS NULL", "event_type || ' for ' || CAST(project_id AS STRING)"),
]


@query("udf3_notification_trigger", " UNION ALL ".join(f"SELECT event_id, '{label}' AS trigger, coalesce({when}, false) AS notify, CASE WHEN {when} THEN {text} END AS message FROM notification_events" for label, when, text in TRIGGERS))
def _(v):
    return policy.notification_triggers(v.notification_events, [policy.Rule(*t) for t in TRIGGERS]).select("event_id", "trigger", "notify", "message")


@query("udf4_preflight", """
    WITH c AS (SELECT p.project_id, p.importance, x.d AS dependency_id FROM projects p, (SELECT DISTINCT dependency_id + 7 AS d FROM dependencies) x WHERE x.d % 200 = p.project_id % 200),
    n AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM project_dependencies i WHERE i.project_id = c.project_id AND i.dependency_id = c.dependency_id))
    SELECT n.project_id, n.dependency_id, reason IS NULL AS allowed, coalesce(reason, '') AS reasons FROM (SELECT n.project_id, n.dependency_id, CASE WHEN x.dependency_id IS NULL THEN 'Package is not in the catalog' WHEN flagged_malicious THEN 'Package flagged as malicious: unknown'
      WHEN importance >= 1.3 AND license LIKE '%GPL-3.0%' THEN 'Banned license for high-importance project: ' || license WHEN importance >= 1.3 AND score < 40 THEN 'Low reputation score for high-importance project: ' || CAST(score AS VARCHAR)
      WHEN importance < 1.3 AND license LIKE '%AGPL%' THEN 'AGPL not allowed' END AS reason FROM n LEFT JOIN dependencies x USING (dependency_id)) n""")
def _(v):
    slice_of = lambda name: (C(name) % 200).alias("_k")
    asked = v.dependencies.select((C("dependency_id") + 7).alias("dependency_id")).select("dependency_id", slice_of("dependency_id"))
    projects = v.projects.select("project_id", "importance", slice_of("project_id"))
    installed = v.project_dependencies.select("project_id", "dependency_id", slice_of("dependency_id")).filter(C("_k") == C("project_id") % 200)
    catalog = v.dependencies.select("dependency_id", "license", "score", C("flagged_malicious").alias("is_malicious"), F.lit(None).cast("string").alias("malicious_reason"))
    out = policy.preflight_slices(asked, installed, catalog, projects, policy.DEFAULT_RULES, "_k")
    return out.select("project_id", "dependency_id", C("policy_result.allowed").alias("allowed"), F.array_join("policy_result.reasons", ",").alias("reasons"))


@query("snk3_export_sla_files", """
    SELECT p.organization_id, count(*) FILTER (WHERE sla_status IS NOT NULL) AS rows, count(DISTINCT finding_id) FILTER (WHERE sla_status IS NOT NULL) AS findings, count(*) FILTER (WHERE sla_status = 'met') AS met,
      CASE WHEN count(*) FILTER (WHERE sla_status IN ('met', 'resolved_late')) = 0 THEN 100 ELSE CAST(floor(count(*) FILTER (WHERE sla_status = 'met') * 100 / count(*) FILTER (WHERE sla_status IN ('met', 'resolved_late')) + 0.5) AS BIGINT) END AS compliance_percent
    FROM findings f JOIN projects p USING (project_id) GROUP BY 1""")
def _(v):
    path = new_folder(v.spark, "sla")
    writers.export_sla(*sla.export_sla(v.findings, v.projects), path)
    flat = v.spark.read.schema("organization_id bigint, finding_id string, sla_status string").json(f"{path}/rows")
    summary = v.spark.read.schema("organization_id bigint, met bigint, compliance_percent bigint").json(f"{path}/summary")
    counts = flat.groupBy("organization_id").agg(F.count("*").alias("rows"), F.countDistinct("finding_id").alias("findings"))
    return summary.join(counts, "organization_id", "left").fillna(0, ["rows", "findings"]).select("organization_id", "rows", "findings", "met", "compliance_percent")


MERGE_KEY = ["project_id", "rule_id", "file_path"]


@query("snk2_merge_buckets", """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id, file_path ORDER BY created_at DESC, finding_id DESC) AS rn FROM (SELECT s.* FROM semgrep_findings s JOIN projects p ON p.project_id = s.project_id AND p.active_extraction_run_id = s.extraction_run_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id, file_path ORDER BY created_at DESC, finding_id DESC) AS rn FROM (SELECT s.* FROM semgrep_findings s JOIN projects p ON p.project_id = s.project_id AND p.previous_extraction_run_id = s.extraction_run_id))
    SELECT project_id, rule_id, file_path, finding_id FROM a WHERE rn = 1 UNION ALL SELECT project_id, rule_id, file_path, finding_id FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.project_id = b.project_id AND a.rule_id = b.rule_id AND a.file_path = b.file_path)""")
def _(v):
    order, path = ["created_at", "finding_id"], new_folder(v.spark, "merge")
    run = lambda which: active_run(v.semgrep_findings, v.projects, which).select(*MERGE_KEY, *order)
    base, delta = runs.dedup(run("previous"), MERGE_KEY, order), run("active")
    merges.create_table(base, path, ["project_id"])
    merges.upsert_into(v.spark, path, base.schema, delta, MERGE_KEY, order, by=["project_id"])
    return merges.read_table(v.spark, path, base.schema).select(*MERGE_KEY, "finding_id")


@query("snk6_merge_buckets", """
    WITH ok AS (SELECT project_id FROM projects WHERE project_id % 2 = 0 AND (policy_evaluated_at IS NULL OR policy_evaluated_at <= TIMESTAMP '2001-08-01')),
    a AS (SELECT s.project_id, s.finding_id FROM iac_findings s JOIN projects p ON p.project_id = s.project_id AND p.active_extraction_run_id = s.extraction_run_id), b AS (SELECT s.project_id, s.finding_id FROM iac_findings s JOIN projects p ON p.project_id = s.project_id AND p.previous_extraction_run_id = s.extraction_run_id)
    SELECT * FROM b WHERE project_id NOT IN (SELECT project_id FROM ok) UNION ALL SELECT * FROM a WHERE project_id IN (SELECT project_id FROM ok) AND finding_id % 3 <> 0""")
def _(v):
    path = new_folder(v.spark, "replace")
    base, new = (active_run(v.iac_findings, v.projects, which).select("project_id", "finding_id") for which in ("previous", "active"))
    merges.create_table(base, path, ["project_id"])
    starts = v.projects.filter(C("project_id") % 2 == 0).select("project_id", F.lit("2001-08-01 00:00:00").cast("timestamp_ntz").alias("eval_start"))
    merges.replace_into(v.spark, path, base.schema, new.filter(C("finding_id") % 3 != 0), starts, v.projects)
    return merges.read_table(v.spark, path, base.schema)


@query("udf5_expand_ranges", r"""
    SELECT feed_id, CAST(i AS BIGINT) AS position, CASE i WHEN 0 THEN '>=' ELSE '<' END AS op, CASE i WHEN 0 THEN regexp_extract(vulnerable_range, '>= ([0-9.]+)', 1) ELSE regexp_extract(vulnerable_range, '< ([0-9.]+)', 1) END AS version FROM malware_feed CROSS JOIN (VALUES (0), (1)) t(i) WHERE vulnerable_range LIKE '>=%'""")
def _(v):
    return policy.expand_ranges(v.malware_feed).withColumn("position", C("position").cast("long"))


@query("udf6_detect_secrets", r"""
    SELECT doc_id, left(s, 4) || '...' || right(s, 4) AS redacted_value, sha256(s) AS value_hash, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:token|secret|api_key|password)\s*=\s*"([^"]{8,})"', 1)) AS s FROM documents) WHERE length(s) >= 20 GROUP BY ALL""")
def _(v):
    out = policy.detect_secrets(v.documents).filter((C("detector_type") == "AssignedToken") & (C("redacted_value") != "****"))
    return out.groupBy("doc_id", "redacted_value", "value_hash").agg(F.count("*").alias("n"))


@query("udf6_detect_licenses", r"""
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)\blicen[sc]ed?\b|released under') GROUP BY 1, 2""")
def _(v):
    return policy.detect_licenses(v.documents).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
