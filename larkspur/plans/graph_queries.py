"""Registered queries for closures and reachability evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import evidence, graph, matching, runs
from larkspur.operators.filters import active_run
from larkspur.plans.common import listing
from larkspur.plans.matching_queries import CANDIDATES, COUNTS, KEY, advisories
from larkspur.plans.registry import query
from larkspur.plans.summary_queries import act

C = F.col


@query("gr1_closure", """
    WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM version_edges), r AS (SELECT version_id AS node FROM dependency_versions v JOIN dependencies d USING (dependency_id) WHERE flagged_malicious UNION SELECT e.child_version_id FROM r JOIN e ON e.parent_version_id = r.node)
    SELECT node FROM r""")
def _(v):
    edges = v.version_edges.select(C("parent_version_id").alias("parent"), C("child_version_id").alias("child"))
    seeds = v.dependency_versions.join(v.dependencies.filter("flagged_malicious").select("dependency_id"), "dependency_id", "left_semi").select(C("version_id").alias("node"))
    return graph.closure(edges, seeds)


WIRED = "e AS MATERIALIZED (SELECT s.* FROM sbom_edges s JOIN projects p USING (project_id) WHERE NOT (parent = 'root' AND p.ecosystem = 'golang'))"


def _wired(v):
    loose = v.projects.filter(C("ecosystem") == "golang").select("project_id", F.lit("root").alias("parent"))
    return v.sbom_edges.join(loose, ["project_id", "parent"], "left_anti")


@query("gr2_direct_and_transitive", f"""
    WITH RECURSIVE {WIRED}, r AS (SELECT project_id, child AS node FROM e WHERE parent = 'root' UNION SELECT r.project_id, e.child FROM r JOIN e ON e.project_id = r.project_id AND e.parent = r.node),
    t AS (SELECT DISTINCT project_id FROM e WHERE parent = 'root')
    SELECT d.project_id, CAST(d.dependency_id AS VARCHAR) AS node, x.child IS NOT NULL AS is_direct, t.project_id IS NOT NULL AS trusted FROM project_dependencies d LEFT JOIN t ON t.project_id = d.project_id LEFT JOIN r ON r.project_id = d.project_id AND r.node = CAST(d.dependency_id AS VARCHAR)
    LEFT JOIN (SELECT * FROM e WHERE parent = 'root') x ON x.project_id = d.project_id AND x.child = CAST(d.dependency_id AS VARCHAR) WHERE t.project_id IS NULL OR r.node IS NOT NULL""")
def _(v):
    parts = v.project_dependencies.select("project_id", C("dependency_id").cast("string").alias("component"))
    return graph.direct_and_transitive(parts, _wired(v))


@query("gr3_dev_only", f"""
    WITH RECURSIVE {WIRED}, roots AS MATERIALIZED (SELECT d.project_id, CAST(dependency_id AS VARCHAR) AS node, CASE WHEN environment = 'dev' THEN 'dev' ELSE 'prod' END AS scope FROM project_dependencies d JOIN projects p USING (project_id) WHERE is_direct AND p.ecosystem NOT IN ('maven', 'golang')),
    r AS (SELECT * FROM roots UNION SELECT r.project_id, e.child, r.scope FROM r JOIN e ON e.project_id = r.project_id AND e.parent = r.node)
    SELECT DISTINCT project_id, node FROM r WHERE scope = 'dev' AND NOT EXISTS (SELECT 1 FROM r p WHERE p.project_id = r.project_id AND p.node = r.node AND p.scope = 'prod') AND NOT EXISTS (SELECT 1 FROM roots o WHERE o.project_id = r.project_id AND o.node = r.node)""")
def _(v):
    roots = v.project_dependencies.filter("is_direct").select("project_id", C("dependency_id").cast("string").alias("node"), F.when(C("environment") == "dev", "dev").otherwise("prod").alias("scope"))
    return graph.dev_only(_wired(v), roots, v.projects.filter(C("ecosystem").isin("maven", "golang")))


@query("gr4_transitive_of_reachable", """
    WITH RECURSIVE u AS MATERIALIZED (SELECT project_id, version_id, coalesce(files_importing_count, 0) > 0 AS seed FROM project_dependencies), g AS MATERIALIZED (SELECT * FROM version_edges),
    e AS MATERIALIZED (SELECT a.project_id, g.parent_version_id AS p, g.child_version_id AS c FROM g JOIN u a ON a.version_id = g.parent_version_id JOIN u b ON b.project_id = a.project_id AND b.version_id = g.child_version_id),
    r AS (SELECT project_id, version_id AS node FROM u WHERE seed UNION SELECT r.project_id, e.c FROM r JOIN e ON e.project_id = r.project_id AND e.p = r.node)
    SELECT r.project_id, r.node FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.project_id = r.project_id AND u.version_id = r.node AND seed)""")
def _(v):
    deps = v.project_dependencies
    return graph.transitive_of_reachable(deps, v.version_edges, deps.filter(C("files_importing_count") > 0).select("project_id", "version_id"))


BAND4 = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}_vulns" for n, c in [("critical", "s >= 90"), ("high", "s >= 70 AND s < 90"), ("medium", "s >= 40 AND s < 70"), ("low", "s < 40")])
NAMES = ["critical_vulns", "high_vulns", "medium_vulns", "low_vulns"]


@query("gr5_children_rollup", f"""
    WITH {COUNTS}, scan AS (SELECT project_id, dependency_id, {BAND4} FROM (SELECT project_id, dependency_id, coalesce(contextual_depscore, depscore, 0) AS s FROM {act('findings')}) GROUP BY 1, 2)
    SELECT d.project_id, d.project_dependency_id, v.version_id AS child_version_id, scan.project_id IS NOT NULL AS from_scan, {', '.join(f'coalesce(scan.{n}, counts.{n}, 0) AS {n}' for n in NAMES)}
    FROM project_dependencies d JOIN (SELECT DISTINCT * FROM version_edges) e ON e.parent_version_id = d.version_id JOIN dependency_versions v ON v.version_id = e.child_version_id LEFT JOIN counts ON counts.version_id = v.version_id
    LEFT JOIN scan ON scan.project_id = d.project_id AND scan.dependency_id = v.dependency_id""")
def _(v):
    from larkspur.functions.labels import ranking_score, score_band

    counts = matching.vuln_counts_by_version(v.dependency_versions, advisories(v))
    band = score_band(ranking_score(C("contextual_depscore"), C("depscore")))
    scan = active_run(v.findings, v.projects).groupBy("project_id", "dependency_id").agg(*[F.count_if(band == b).alias(f"{b}_vulns") for b in ("critical", "high", "medium", "low")])
    return graph.children_rollup(v.project_dependencies, v.version_edges, v.dependency_versions, counts, scan)


@query("gr6_latest_safe_version", f"""
    WITH {COUNTS}, st AS (SELECT *, {KEY.format(c='version')} AS k, critical_vulns + high_vulns > 0 AS over FROM counts WHERE version <> 'latest' AND version NOT LIKE '%-beta%'),
    badkids AS (SELECT DISTINCT e.parent_version_id AS version_id FROM version_edges e JOIN counts c ON c.version_id = e.child_version_id WHERE c.critical_vulns + c.high_vulns > 0),
    safe AS (SELECT * FROM st WHERE NOT over AND version_id NOT IN (SELECT version_id FROM badkids)),
    ban AS (SELECT p.project_id, b.dependency_id, b.banned_version AS version FROM projects p JOIN banned_versions b ON b.organization_id = p.organization_id UNION SELECT t.project_id, b.dependency_id, b.banned_version FROM project_teams t JOIN banned_versions b ON b.team_id = t.team_id),
    fx AS (SELECT project_dependency_id, unnest(fixed_versions) AS f, finding_id FROM {act('findings')} WHERE is_reachable AND fixed_versions IS NOT NULL),
    per AS (SELECT d.project_dependency_id, fx.finding_id, min({KEY.format(c='fx.f')}) AS k FROM fx JOIN project_dependencies d USING (project_dependency_id) WHERE d.version = 'latest' OR {KEY.format(c='fx.f')} > {KEY.format(c='d.version')} GROUP BY 1, 2),
    tgt AS (SELECT project_dependency_id, max(k) AS t FROM per GROUP BY 1),
    cov AS (SELECT d.project_id, d.project_dependency_id, d.dependency_id, arg_min(st.version, st.k) AS version, arg_min(st.over, st.k) AS over FROM tgt JOIN project_dependencies d USING (project_dependency_id) JOIN st ON st.dependency_id = d.dependency_id AND st.k >= tgt.t GROUP BY 1, 2, 3),
    fixv AS (SELECT * FROM cov WHERE NOT over AND NOT EXISTS (SELECT 1 FROM ban WHERE ban.project_id = cov.project_id AND ban.dependency_id = cov.dependency_id AND ban.version = cov.version)),
    best AS (SELECT d.project_dependency_id, arg_max(s.version, s.k) AS version FROM project_dependencies d JOIN safe s USING (dependency_id) LEFT JOIN ban b ON b.project_id = d.project_id AND b.dependency_id = d.dependency_id AND b.version = s.version WHERE b.version IS NULL GROUP BY 1)
    SELECT d.project_id, d.project_dependency_id, coalesce(f.version, b.version) AS safe_version, f.version IS NOT NULL AS covers_fixes, coalesce(coalesce(f.version, b.version) = d.version, false) AS is_current FROM project_dependencies d LEFT JOIN fixv f USING (project_dependency_id) LEFT JOIN best b USING (project_dependency_id)""")
def _(v):
    uses = v.project_dependencies
    banned = matching.banned_versions(uses, v.banned_versions, v.projects, v.project_teams)
    counts = matching.vuln_counts_by_version(v.dependency_versions, advisories(v))
    fixes = active_run(v.findings, v.projects).filter(C("is_reachable") & C("fixed_versions").isNotNull()).select("project_dependency_id", "fixed_versions")
    return graph.latest_safe_version(uses, counts, v.version_edges, banned, fixes)


def _taint_sql(cap: int) -> str:
    """Walks of up to ``cap`` hops, each node's nearest callers, the smallest of them followed back to the source."""
    return f"""
    WITH RECURSIVE k AS MATERIALIZED (SELECT c.* FROM calls c WHERE NOT EXISTS (SELECT 1 FROM call_roles r WHERE r.project_id = c.project_id AND r.fn = c.callee AND r.role = 'sanitizer')),
    r AS (SELECT project_id, fn AS source, fn AS node, 0 AS hops FROM call_roles WHERE role = 'source' UNION SELECT r.project_id, r.source, k.callee, r.hops + 1 FROM r JOIN k ON k.project_id = r.project_id AND k.caller = r.node WHERE r.hops <= {cap}),
    n AS MATERIALIZED (SELECT project_id, source, node, min(hops) AS hops FROM r GROUP BY ALL),
    v AS MATERIALIZED (SELECT * FROM n WHERE hops <= {cap}),
    e AS MATERIALIZED (SELECT v.project_id, v.source, v.node, v.hops, min(u.node) AS parent FROM v JOIN k ON k.project_id = v.project_id AND k.callee = v.node JOIN v u ON u.project_id = v.project_id AND u.source = v.source AND u.node = k.caller AND u.hops = v.hops - 1 GROUP BY ALL),
    p AS (SELECT project_id, source, node, node AS path FROM v WHERE hops = 0 UNION ALL SELECT e.project_id, e.source, e.node, p.path || '>' || e.node FROM p JOIN e ON e.project_id = p.project_id AND e.source = p.source AND e.parent = p.node)
    SELECT v.project_id, v.source, v.node AS sink, CAST(v.hops AS BIGINT) AS hops, p.path, EXISTS (SELECT 1 FROM n WHERE n.project_id = v.project_id AND n.hops > {cap}) AS truncated,
           sha256(CAST(v.project_id AS VARCHAR) || chr(31) || p.path) AS flow_id
    FROM v JOIN p USING (project_id, source, node) WHERE v.hops > 0 AND EXISTS (SELECT 1 FROM call_roles s WHERE s.project_id = v.project_id AND s.fn = v.node AND s.role = 'sink')"""


TAINT = ["project_id", "source", "sink", "CAST(hops AS BIGINT) AS hops", "path", "truncated", "flow_id"]


@query("gr7_taint_flows", _taint_sql(50))
def _(v):
    return graph.taint_flows(v.calls, v.call_roles).selectExpr(*TAINT)


@query("gr7_taint_flows_short", _taint_sql(3))
def _(v):
    return graph.taint_flows(v.calls, v.call_roles, max_hops=3).selectExpr(*TAINT)


@query("gr8_callers_of", "SELECT DISTINCT project_id, callee, caller, count(*) OVER (PARTITION BY project_id, callee) AS callers FROM calls")
def _(v):
    return graph.callers_of(v.calls, ["project_id"])


@query("jn8_flow_evidence", """
    WITH fl AS (SELECT f.*, EXISTS (SELECT 1 FROM flow_suppressions s WHERE s.project_id = f.project_id AND s.flow_signature_hash = f.flow_signature_hash) AS sup FROM flows f)
    SELECT f.finding_id, count(*) FILTER (WHERE fl.osv_id IS NOT NULL AND fl.reachability_source IN ('semgrep_taint', 'taint_engine') AND NOT sup) AS confirmed_flows, count(fl.flow_id) AS data_flow_flows
    FROM findings f LEFT JOIN fl ON fl.project_id = f.project_id AND fl.extraction_run_id = f.extraction_run_id AND fl.dependency_id = f.dependency_id AND (fl.osv_id IS NULL OR fl.osv_id = f.osv_id OR list_contains(f.aliases, fl.osv_id)) GROUP BY 1""")
def _(v):
    return evidence.flow_evidence(v.findings, v.flows, v.flow_suppressions).select("finding_id", "confirmed_flows", "data_flow_flows")


USED = """vr AS (SELECT project_id, project_dependency_id, is_direct, ecosystem, files_importing_count, unnest(list_distinct([lower(name), replace(lower(name), '-', '.'), CASE WHEN length(split_part(lower(name), '-', 1)) > 3 THEN split_part(lower(name), '-', 1) END, CASE WHEN lower(name) LIKE 'py%' AND length(name) > 3 THEN substring(lower(name), 3) END])) AS needle FROM project_dependencies),
    tx AS (SELECT DISTINCT project_id, file_path, text FROM (SELECT project_id, file_path, unnest([lower(target_type), lower(resolved_method)]) AS text FROM usages) WHERE text IS NOT NULL), nd AS (SELECT DISTINCT project_id, needle FROM vr WHERE needle IS NOT NULL),
    hit AS (SELECT DISTINCT nd.project_id, needle, file_path FROM nd JOIN tx ON tx.project_id = nd.project_id AND contains(text, needle)), um AS (SELECT DISTINCT project_id, project_dependency_id, file_path FROM vr JOIN hit USING (project_id, needle))"""


@query("jn9_usage_match", f"WITH {USED} SELECT project_dependency_id, count(*) AS files FROM um GROUP BY 1")
def _(v):
    return evidence.usage_match(v.usages, v.project_dependencies).groupBy("project_dependency_id").agg(F.count("*").alias("files"))


@query("agg26_import_counts", f"""
    WITH {USED}, c AS (SELECT project_dependency_id, count(*) AS n FROM um GROUP BY 1)
    SELECT d.project_dependency_id, CASE WHEN ecosystem = 'npm' THEN CASE WHEN files_importing_count IS NULL AND n IS NULL THEN NULL ELSE greatest(coalesce(files_importing_count, 0), coalesce(n, 0)) END WHEN n > 0 THEN n END AS files_importing_count FROM project_dependencies d LEFT JOIN c USING (project_dependency_id) WHERE is_direct""")
def _(v):
    return evidence.import_counts(v.usages, v.project_dependencies).select("project_dependency_id", "files_importing_count")


@query("jn33_symbol_match", """
    WITH tk AS (SELECT osv_id, unnest([regexp_replace(regexp_replace(lower(pattern), '\\(\\*\\)$', ''), '\\.\\*$', ''), split_part(regexp_replace(regexp_replace(lower(pattern), '\\(\\*\\)$', ''), '\\.\\*$', ''), '.', 2)]) AS needle FROM cve_sinks),
    ids AS (SELECT finding_id, project_id, unnest(list_distinct(list_append(coalesce(aliases, []), osv_id))) AS osv_id FROM findings), ask AS (SELECT DISTINCT finding_id, project_id, needle FROM ids JOIN tk USING (osv_id)),
    tx AS (SELECT DISTINCT project_id, unnest([lower(target_type), lower(resolved_method)]) AS text FROM usages), ok AS (SELECT DISTINCT a.project_id, a.needle FROM (SELECT DISTINCT project_id, needle FROM ask) a JOIN tx ON tx.project_id = a.project_id AND contains(text, needle))
    SELECT f.finding_id, x.hit AS symbol_hit FROM findings f LEFT JOIN (SELECT finding_id, bool_or(ok.needle IS NOT NULL) AS hit FROM ask LEFT JOIN ok USING (project_id, needle) GROUP BY 1) x USING (finding_id)""")
def _(v):
    return evidence.symbol_match(v.findings, v.cve_sinks, v.usages).select("finding_id", "symbol_hit")


@query("scl28_reachability_level", """
    SELECT finding_id, CASE WHEN c > 0 THEN 'confirmed' WHEN d > 0 THEN 'data_flow' WHEN environment = 'dev' THEN 'unreachable' WHEN sym THEN 'function' WHEN NOT sym AND ran AND coalesce(files, 0) > 0 THEN 'unreachable' WHEN strong THEN 'function' WHEN seen THEN 'module'
      WHEN ran AND trusted AND (NOT is_direct OR ecosystem IN ('composer', 'pypi', 'npm')) AND files = 0 AND NOT spa AND NOT entered AND NOT via THEN 'unreachable' ELSE 'module' END AS level
    FROM (SELECT f.finding_id, CASE WHEN length(f.finding_id) % 9 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN f.kevs THEN 1 ELSE 0 END AS d, x.environment, CASE WHEN f.severity = 'high' THEN true WHEN f.severity = 'low' THEN false END AS sym, x.files_importing_count AS files, f.suppressed AS seen, f.suppressed AND f.risk_accepted AS strong,
      f.status <> 'ignored' AS ran, f.status <> 'resolved' AS trusted, x.is_direct, x.ecosystem, p.is_client_spa AS spa, f.auto_ignored AS via, f.risk_accepted AS entered FROM (SELECT *, cisa_kev AND severity = 'medium' AS kevs FROM findings) f JOIN project_dependencies x USING (project_dependency_id) JOIN projects p ON p.project_id = f.project_id)""")
def _(v):
    rows = (
        v.findings.join(v.project_dependencies.select("project_dependency_id", "name", "environment", "files_importing_count", "is_direct", "ecosystem"), "project_dependency_id")
        .join(v.projects.select("project_id", C("is_client_spa").alias("client_spa")), "project_id")
        .withColumn("confirmed_flows", F.when(F.length("finding_id") % 9 == 0, 1).otherwise(0)).withColumn("data_flow_flows", F.when(C("cisa_kev") & (C("severity") == "medium"), 1).otherwise(0))
        .withColumn("symbol_hit", F.when(C("severity") == "high", True).when(C("severity") == "low", False)).withColumn("usage_seen", C("suppressed")).withColumn("usage_strong", C("suppressed") & C("risk_accepted"))
        .withColumn("usage_ran", C("status") != "ignored").withColumn("graph_trusted", C("status") != "resolved").withColumn("transitive_of_reachable", C("auto_ignored")).withColumn("call_reached", C("risk_accepted"))
    )
    return rows.select("finding_id", evidence.reachability_level().alias("level"))


_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
CLASSIFY = f"""
    WITH RECURSIVE af AS MATERIALIZED (SELECT f.* FROM findings f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id),
    au AS MATERIALIZED (SELECT u.project_id, lower(target_type) AS t, lower(resolved_method) AS m FROM usages u JOIN projects p ON p.project_id = u.project_id AND p.active_extraction_run_id = u.extraction_run_id),
    fl AS (SELECT f.*, EXISTS (SELECT 1 FROM flow_suppressions s WHERE s.project_id = f.project_id AND s.flow_signature_hash = f.flow_signature_hash) AS sup FROM flows f JOIN projects p ON p.project_id = f.project_id AND p.active_extraction_run_id = f.extraction_run_id),
    ev AS (SELECT f.finding_id, count(*) FILTER (WHERE fl.osv_id IS NOT NULL AND fl.reachability_source IN ('semgrep_taint', 'taint_engine') AND NOT sup) AS c, count(fl.flow_id) AS d FROM af f LEFT JOIN fl ON fl.project_id = f.project_id AND fl.dependency_id = f.dependency_id AND (fl.osv_id IS NULL OR fl.osv_id = f.osv_id OR list_contains(f.aliases, fl.osv_id)) GROUP BY 1),
    tk AS (SELECT osv_id, unnest([regexp_replace(regexp_replace(lower(pattern), '\\(\\*\\)$', ''), '\\.\\*$', ''), split_part(regexp_replace(regexp_replace(lower(pattern), '\\(\\*\\)$', ''), '\\.\\*$', ''), '.', 2)]) AS needle FROM cve_sinks),
    ask AS (SELECT DISTINCT finding_id, project_id, needle FROM (SELECT finding_id, project_id, unnest(list_distinct(list_append(coalesce(aliases, []), osv_id))) AS osv_id FROM af) JOIN tk USING (osv_id)),
    tx AS MATERIALIZED (SELECT project_id, text, bool_or(receiver) AS receiver, bool_or(strong) AS strong FROM (SELECT project_id, t AS text, true AS receiver, bare <> '' AND bare NOT IN ({_quoted(evidence.COMMON_CALLS)}) AS strong FROM (SELECT *, regexp_extract(coalesce(m, ''), '[a-z0-9_$]*$') AS bare FROM au)
      UNION ALL SELECT project_id, m, false, bare <> '' AND bare NOT IN ({_quoted(evidence.COMMON_CALLS)}) FROM (SELECT *, regexp_extract(coalesce(m, ''), '[a-z0-9_$]*$') AS bare FROM au)) WHERE text IS NOT NULL GROUP BY 1, 2),
    ok AS (SELECT DISTINCT a.project_id, a.needle FROM (SELECT DISTINCT project_id, needle FROM ask WHERE needle <> '') a JOIN tx ON tx.project_id = a.project_id AND contains(text, needle)),
    sy AS (SELECT finding_id, bool_or(ok.needle IS NOT NULL) AS hit FROM ask LEFT JOIN ok USING (project_id, needle) GROUP BY 1),
    vr AS (SELECT DISTINCT project_id, project_dependency_id, needle FROM (SELECT project_id, project_dependency_id, unnest([lower(name), replace(lower(name), '-', '.'), CASE WHEN length(split_part(lower(name), '-', 1)) > 3 THEN split_part(lower(name), '-', 1) END]) AS needle FROM project_dependencies) WHERE needle <> ''),
    st AS (SELECT n.project_id, n.needle, bool_or(strong OR (receiver AND length(needle) >= 4 AND needle NOT IN ({_quoted(evidence.COMMON_CALLS)}))) AS good FROM (SELECT DISTINCT project_id, needle FROM vr) n JOIN tx ON tx.project_id = n.project_id AND contains(text, needle)
      AND regexp_matches(text, '(^|[^a-z0-9])' || regexp_replace(needle, '([^a-z0-9 _-])', '\\\\\\1', 'g') || '($|[^a-z0-9])') GROUP BY 1, 2),
    us AS (SELECT project_dependency_id, bool_or(good) AS strong FROM vr JOIN st USING (project_id, needle) GROUP BY 1),
    rp AS (SELECT DISTINCT project_id, lower(dependency_name) AS package FROM usages WHERE usage_kind = 'new'),
    {WIRED}, tr AS (SELECT DISTINCT project_id FROM e WHERE parent = 'root'),
    dm AS MATERIALIZED (SELECT d.*, coalesce(environment = 'dev', false) AS dev, rp.package IS NOT NULL AS entered, tr.project_id IS NOT NULL AS trusted, lower(coalesce(name, '')) IN ({_quoted(evidence.CONVENTION_RUNTIME)}) OR {" OR ".join(f"contains(lower(coalesce(name, '')), '{w}')" for w in evidence.EMBEDDED_RUNTIME)} AS runtime
      FROM project_dependencies d LEFT JOIN rp ON rp.project_id = d.project_id AND rp.package = lower(d.name) LEFT JOIN tr ON tr.project_id = d.project_id),
    sd AS MATERIALIZED (SELECT project_id, version_id FROM dm WHERE trusted AND NOT dev AND (coalesce(files_importing_count, 0) > 0 OR runtime OR entered OR (is_direct AND ecosystem NOT IN ('composer', 'pypi', 'npm')))),
    ed AS MATERIALIZED (SELECT a.project_id, g.parent_version_id AS p, g.child_version_id AS c FROM version_edges g JOIN dm a ON a.version_id = g.parent_version_id AND a.trusted JOIN dm b ON b.project_id = a.project_id AND b.version_id = g.child_version_id),
    cl AS (SELECT project_id, version_id AS node FROM sd UNION SELECT cl.project_id, ed.c FROM cl JOIN ed ON ed.project_id = cl.project_id AND ed.p = cl.node),
    vi AS (SELECT * FROM cl EXCEPT SELECT * FROM sd), ra AS (SELECT DISTINCT project_id FROM au)
    SELECT f.finding_id, f.project_id, CASE WHEN ev.c > 0 THEN 'confirmed' WHEN ev.d > 0 THEN 'data_flow' WHEN x.dev THEN 'unreachable' WHEN sy.hit THEN 'function' WHEN NOT sy.hit AND ra.project_id IS NOT NULL AND coalesce(x.files_importing_count, 0) > 0 THEN 'unreachable'
      WHEN us.strong THEN 'function' WHEN us.project_dependency_id IS NOT NULL THEN 'module'
      WHEN x.trusted AND ra.project_id IS NOT NULL AND (NOT x.is_direct OR x.ecosystem IN ('composer', 'pypi', 'npm')) AND x.files_importing_count = 0 AND NOT x.runtime AND NOT p.is_client_spa AND NOT x.entered AND vi.node IS NULL THEN 'unreachable' ELSE 'module' END AS new_level
    FROM af f JOIN ev USING (finding_id) JOIN dm x USING (project_dependency_id) JOIN projects p ON p.project_id = f.project_id LEFT JOIN sy ON sy.finding_id = f.finding_id LEFT JOIN us ON us.project_dependency_id = f.project_dependency_id
    LEFT JOIN ra ON ra.project_id = f.project_id LEFT JOIN vi ON vi.project_id = f.project_id AND vi.node = x.version_id"""


@query("reachability_classify", CLASSIFY)
def _(v):
    reached = v.usages.filter(C("usage_kind") == "new").select("project_id", F.lower("dependency_name").alias("package"))
    out = evidence.classify(v.findings, v.project_dependencies, v.projects, v.flows, v.flow_suppressions, v.cve_sinks, v.usages, v.version_edges, _wired(v), reached)
    return out.select("finding_id", "project_id", "new_level")


ROUTE = "rx AS (SELECT *, '^' || replace(replace(replace(replace(route_pattern, '<string:lang>', '[^/]+'), '{lang}', '[^/]+'), ':lang', '[^/]+'), ':id', '[^/]+') || '$' AS regex FROM routes), rq AS (SELECT finding_id, project_key, upper(http_method) AS m, regexp_replace(regexp_replace(regexp_replace(endpoint_url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/+$', '') AS path FROM requests), mt AS (SELECT q.finding_id, q.project_key, min(r.route_id) AS route_id FROM rq q LEFT JOIN rx r ON r.project_key = q.project_key AND (r.http_method IS NULL OR r.http_method = q.m) AND regexp_matches(q.path, r.regex) GROUP BY 1, 2)"


@query("jn10_route_match", f"WITH {ROUTE} SELECT finding_id, project_key, route_id FROM mt")
def _(v):
    return evidence.route_match(v.requests, v.routes, ["project_key"])


@query("jn11_cross_link", f"""
    WITH {ROUTE}, fl AS (SELECT mt.*, r.file_path, r.handler_name, (SELECT dependency_id FROM flows f WHERE f.project_id = mt.project_key AND f.entry_point_file = r.file_path AND f.entry_point_method = r.handler_name ORDER BY flow_id LIMIT 1) AS dependency_id FROM mt LEFT JOIN routes r ON r.route_id = mt.route_id),
    w AS (SELECT project_id, dependency_id, arg_min(osv_id, (-CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, osv_id)) AS o, count(*) AS n FROM (SELECT * FROM findings WHERE extraction_run_id = '2001') GROUP BY 1, 2)
    SELECT finding_id, fl.project_key, route_id, fl.dependency_id, w.o AS linked_osv_id, w.n AS candidates, CASE WHEN route_id IS NULL THEN 'none' WHEN fl.dependency_id IS NULL THEN 'route_only' WHEN w.o IS NULL THEN 'route_and_flow_no_vuln' ELSE 'route_flow_vuln' END AS match_method FROM fl LEFT JOIN w ON w.project_id = fl.project_key AND w.dependency_id = fl.dependency_id""")
def _(v):
    return evidence.cross_link(v.requests, v.routes, v.flows, v.findings.filter(C("extraction_run_id") == "2001"), key="project_key")


COMPOSE = """cs AS (SELECT c.finding_id, c.project_id, c.extraction_run_id, unnest(list_distinct(list_filter([upper(c.cve_id), upper(c.osv_id)], lambda x: x IS NOT NULL))) AS cve, b.soname, CASE WHEN c.reachability_level = 'unreachable' THEN 0.4e0 ELSE 1e0 END AS m FROM container_findings c JOIN native_bindings b ON b.scope = 'os' AND lower(b.package_identifier) = lower(c.os_package_name)),
    fs AS (SELECT f.finding_id, f.project_id, f.extraction_run_id, unnest(list_distinct(list_append(list_filter(coalesce(aliases, []), lambda a: a LIKE 'CVE-%'), upper(osv_id)))) AS cve, b.soname, CASE f.reachability_level WHEN 'confirmed' THEN 1e0 WHEN 'data_flow' THEN 0.9e0 WHEN 'function' THEN 0.7e0 WHEN 'module' THEN 0.5e0 WHEN 'unreachable' THEN 0e0 END AS w
      FROM findings f JOIN project_dependencies d USING (project_dependency_id) JOIN native_bindings b ON b.scope = 'language' AND lower(b.package_ecosystem) = d.ecosystem AND lower(b.package_identifier) = lower(d.name) WHERE f.reachability_level IS NOT NULL),
    pairs AS (SELECT cs.finding_id AS container_finding_id, fs.finding_id, round(min(m * w), 3) AS composition_factor, list_sort(list(DISTINCT cs.soname)) AS sonames FROM cs JOIN fs ON cs.project_id = fs.project_id AND cs.extraction_run_id = fs.extraction_run_id AND cs.cve = fs.cve AND cs.soname = fs.soname GROUP BY 1, 2)"""


@query("jn13_compose_container", f"WITH {COMPOSE} SELECT finding_id, min(composition_factor) AS composition_factor FROM pairs GROUP BY 1")
def _(v):
    return evidence.compose_container(v.container_findings, v.findings, v.project_dependencies, v.native_bindings)


@query("jn13_composition_edges", f"WITH {COMPOSE} SELECT container_finding_id, finding_id, composition_factor, array_to_string(sonames, ',') AS sonames FROM pairs")
def _(v):
    return evidence.composition_edges(v.container_findings, v.findings, v.project_dependencies, v.native_bindings).withColumn("sonames", listing("sonames"))


@query("agg25_min_factor", f"WITH {COMPOSE}, mf AS (SELECT finding_id, min(composition_factor) AS x FROM pairs GROUP BY 1) SELECT f.finding_id, mf.x AS composition_factor, round(contextual_depscore * coalesce(mf.x, 1e0), 4) AS contextual_depscore FROM findings f LEFT JOIN mf USING (finding_id)")
def _(v):
    factors = evidence.compose_container(v.container_findings, v.findings, v.project_dependencies, v.native_bindings)
    return evidence.min_factor(v.findings, factors).select("finding_id", "composition_factor", "contextual_depscore")


@query("jn32_transitive_veto", """
    SELECT project_id, question_id, bool_or(EXISTS (SELECT 1 FROM (SELECT DISTINCT project_id, package, module FROM module_imports) i WHERE i.project_id = q.project_id AND (i.module = q.module OR starts_with(i.module, q.module || '.')) AND i.package NOT IN (SELECT owner FROM module_questions o WHERE o.project_id = q.project_id AND o.question_id = q.question_id AND o.module = q.module))) AS veto
    FROM (SELECT DISTINCT project_id, question_id, module FROM module_questions) q GROUP BY 1, 2""")
def _(v):
    return evidence.transitive_veto(v.module_questions, v.module_imports)


@query("jn34_os_package_loaded", """
    WITH k AS (SELECT lower(package) AS p, bool_or(basename IN (SELECT soname FROM loaded_libraries)) AS l FROM package_files GROUP BY 1) SELECT finding_id, CASE WHEN l IS NULL THEN NULL WHEN l THEN 'module' ELSE 'unreachable' END AS reachability_level FROM container_findings c LEFT JOIN k ON k.p = lower(c.os_package_name)""")
def _(v):
    return evidence.os_package_loaded(v.container_findings.drop("reachability_level"), v.package_files, v.loaded_libraries).select("finding_id", "reachability_level")


@query("jn35_route_of_flow", """
    WITH j AS (SELECT f.flow_id, bool_or(classification = 'PUBLIC_UNAUTH') AS pub, bool_or(classification NOT IN ('AUTH_INTERNAL', 'OFFLINE_WORKER')) AS unk, bool_or(classification = 'AUTH_INTERNAL') AS auth, arg_min(r.route_id, (r.end_line - r.line_number, r.route_id)) AS ctx FROM flows f JOIN routes r ON r.project_key = f.project_id AND r.file_path = f.entry_point_file AND f.entry_point_line BETWEEN r.line_number AND r.end_line GROUP BY 1)
    SELECT f.flow_id, CASE WHEN pub THEN 'framework-route:public_unauth' WHEN coalesce(unk, true) THEN 'framework-input:unmatched' WHEN auth THEN 'framework-route:auth_internal' ELSE 'framework-route:offline_worker' END AS stamp_tag, ctx AS context_route_id FROM flows f LEFT JOIN j USING (flow_id)""")
def _(v):
    return evidence.route_of_flow(v.flows, v.routes, key="project_key").select("flow_id", "stamp_tag", "context_route_id")


@query("jn37_malware_reachability", """
    WITH s AS (SELECT m.finding_id, m.project_id, d.name AS dependency_name FROM malicious_findings m JOIN dependencies d USING (dependency_id)), u AS (SELECT DISTINCT project_id, dependency_name, usage_kind <> 'member' AS called, file_path, line_number, containing_method FROM usages),
    c AS (SELECT project_id, dependency_name, string_agg(w, ',' ORDER BY w) AS chain FROM (SELECT project_id, dependency_name, file_path || ':' || CAST(line_number AS VARCHAR) || coalesce(' (' || containing_method || ')', '') AS w FROM (SELECT DISTINCT project_id, dependency_name, file_path, line_number, containing_method FROM u WHERE called) QUALIFY row_number() OVER (PARTITION BY project_id, dependency_name ORDER BY file_path, line_number, containing_method NULLS FIRST) <= 5) GROUP BY 1, 2)
    SELECT s.finding_id, CASE WHEN NOT EXISTS (SELECT 1 FROM imports i WHERE i.project_id = s.project_id AND i.dependency_name = s.dependency_name) THEN 'unimported' WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.project_id = s.project_id AND u.dependency_name = s.dependency_name) THEN 'imported_unused' WHEN chain IS NOT NULL THEN 'function' ELSE 'module' END AS level,
      CASE WHEN EXISTS (SELECT 1 FROM imports i WHERE i.project_id = s.project_id AND i.dependency_name = s.dependency_name) THEN chain END AS call_chain FROM s LEFT JOIN c USING (project_id, dependency_name)""")
def _(v):
    rows = v.malicious_findings.select("finding_id", "project_id", "dependency_id").join(v.dependencies.select("dependency_id", C("name").alias("dependency_name")), "dependency_id")
    return evidence.malware_reachability(rows, v.imports, v.usages).select("finding_id", "level", F.array_join("call_chain", ",").alias("call_chain"))


RANK = "CASE {c} WHEN 'PUBLIC_UNAUTH' THEN 3 WHEN 'AUTH_INTERNAL' THEN 2 WHEN 'OFFLINE_WORKER' THEN 1 WHEN 'UNKNOWN' THEN 0 END"


@query("agg24_epd_aggregate", f"""
    WITH fl AS (SELECT f.*, EXISTS (SELECT 1 FROM flow_suppressions s WHERE s.project_id = f.project_id AND s.flow_signature_hash = f.flow_signature_hash) AS sup, CASE WHEN entry_point_tag LIKE 'framework-route:%' THEN upper(substring(entry_point_tag, 17)) END AS tok, coalesce(confidence >= 0.75, false) AND endpoint_class IS NOT NULL AS sure FROM flows f),
    v AS (SELECT *, NOT sup AND NOT ai_error AS usable, CASE WHEN NOT sup AND NOT ai_error THEN greatest(CASE WHEN sure THEN {RANK.format(c='endpoint_class')} END, {RANK.format(c='tok')}) END AS vote FROM fl),
    g AS (SELECT project_id, extraction_run_id, dependency_id, count(*) AS n, count(vote) AS k, max(vote) AS worst, min(greatest(1, coalesce(flow_length, 1))) AS len, count(*) FILTER (WHERE usable AND sure) AS voters, bool_and(is_sanitized) FILTER (WHERE usable AND sure) AS clean, bool_and(sup) AS alloff, arg_max(coalesce(endpoint_class, 'OFFLINE_WORKER'), flow_id) AS lc, arg_max(CASE WHEN confidence IS NULL THEN true ELSE is_sanitized END, flow_id) AS ls FROM v GROUP BY 1, 2, 3),
    b AS (SELECT project_id, extraction_run_id, dependency_id, max(coalesce(depscore, 0)) AS base, max(reachability_level) AS lvl, bool_and(is_reachable) AS re FROM findings GROUP BY 1, 2, 3),
    r AS (SELECT b.*, g.*, CASE WHEN k > 0 THEN 'flow_aggregated' WHEN alloff THEN 'all_flows_suppressed' ELSE 'no_flows_evaluated' END AS status FROM b JOIN g USING (project_id, extraction_run_id, dependency_id)),
    q AS (SELECT *, CASE status WHEN 'flow_aggregated' THEN CASE worst WHEN 3 THEN 'PUBLIC_UNAUTH' WHEN 2 THEN 'AUTH_INTERNAL' WHEN 1 THEN 'OFFLINE_WORKER' ELSE 'UNKNOWN' END WHEN 'all_flows_suppressed' THEN lc ELSE 'UNKNOWN' END AS cls, CASE status WHEN 'flow_aggregated' THEN voters > 0 AND clean WHEN 'all_flows_suppressed' THEN ls ELSE false END AS san FROM r)
    SELECT project_id, extraction_run_id, dependency_id, CAST(len - 1 AS BIGINT) AS epd_depth, cls AS entry_point_classification, coalesce(san, false) AS is_sanitized, status AS epd_status, n AS flows_considered, k AS flows_aggregated,
      round(CASE WHEN lvl = 'unreachable' OR NOT re THEN 0e0 WHEN san THEN 0e0 ELSE CASE cls WHEN 'AUTH_INTERNAL' THEN 0.5e0 WHEN 'OFFLINE_WORKER' THEN 0.2e0 ELSE 1e0 END * pow(0.85e0, len - 1) END, 6) AS epd_factor FROM q""")
def _(v):
    key = ["project_id", "extraction_run_id", "dependency_id"]
    base = v.findings.groupBy(*key).agg(F.max(F.coalesce("depscore", F.lit(0))).alias("base_depscore"), F.max("reachability_level").alias("reachability_level"), F.bool_and("is_reachable").alias("is_reachable"))
    out = evidence.epd_aggregate(runs.suppressed_flag(v.flows, v.flow_suppressions), base, key)
    return out.drop("contextual_depscore")


@query("set2_flow_ids", f"""
    WITH a AS (SELECT project_id, osv_id, aliases FROM {act('findings')}) SELECT project_id, osv_id, unnest(list_append(coalesce(aliases, []), osv_id)) AS flow_osv_id FROM a
    UNION SELECT a.project_id, a.osv_id, unnest(x.aliases) FROM a JOIN advisories x ON x.osv_id = a.osv_id""")
def _(v):
    return evidence.flow_ids(active_run(v.findings, v.projects), v.advisories, ["project_id"])


@query("agg45_finding_detail", f"""
    WITH a AS MATERIALIZED (SELECT * FROM {act('findings')}), k AS (SELECT DISTINCT project_id, osv_id FROM a), ids AS (SELECT project_id, osv_id, unnest(list_append(coalesce(aliases, []), osv_id)) AS fid FROM a UNION SELECT a.project_id, a.osv_id, unnest(x.aliases) FROM a JOIN advisories x ON x.osv_id = a.osv_id),
    dep AS MATERIALIZED (SELECT DISTINCT a.project_id, a.osv_id, d.project_dependency_id, d.dependency_id, d.name, d.version, d.is_direct, d.environment, d.files_importing_count, coalesce(x.score, 0) AS package_score FROM a JOIN project_dependencies d USING (project_dependency_id) LEFT JOIN dependencies x ON x.dependency_id = d.dependency_id WHERE removed_at IS NULL),
    {USED.replace("FROM usages)", "FROM " + act("usages") + ")")},
    {CANDIDATES},
    evi AS (SELECT e.project_id, e.osv_id, e.event_type, strftime(e.created_at, '%Y-%m-%d %H:%M:%S') AS moment, sha256(e.event_type || '|' || e.project_dependency_id || '|' || strftime(e.created_at, '%Y-%m-%d %H:%M:%S')) AS item, e.created_at FROM finding_events e JOIN k USING (project_id, osv_id)),
    ev AS (SELECT * FROM evi QUALIFY row_number() OVER (PARTITION BY project_id, osv_id ORDER BY created_at DESC, item) <= 50),
    ad AS (SELECT DISTINCT k.project_id, k.osv_id, first_value(advisory_id) OVER w AS item, first_value(severity) OVER w AS severity FROM k JOIN (SELECT osv_id, 0 AS rank, advisory_id, severity FROM advisories UNION ALL SELECT unnest(aliases), 1, advisory_id, severity FROM advisories) x USING (osv_id) WINDOW w AS (PARTITION BY k.project_id, k.osv_id ORDER BY x.rank, x.advisory_id)),
    fl AS (SELECT ids.project_id, ids.osv_id, f.flow_id, f.flow_length, f.entry_point_file, f.sink_method, EXISTS (SELECT 1 FROM flow_suppressions s WHERE s.project_id = f.project_id AND s.flow_signature_hash = f.flow_signature_hash) AS is_suppressed
      FROM {act('flows')} JOIN ids ON ids.project_id = f.project_id AND ids.fid = f.osv_id WHERE EXISTS (SELECT 1 FROM dep WHERE dep.project_id = ids.project_id AND dep.osv_id = ids.osv_id AND dep.dependency_id = f.dependency_id) QUALIFY row_number() OVER (PARTITION BY ids.project_id, ids.osv_id ORDER BY flow_length NULLS LAST, flow_id) <= 20)
    SELECT k.project_id, k.osv_id, 'importance' AS section, CAST(k.project_id AS VARCHAR) AS item, CAST(to_json({{'importance': p.importance}}) AS VARCHAR) AS payload FROM k JOIN projects p USING (project_id)
    UNION ALL SELECT project_id, osv_id, 'vulnerability', finding_id, CAST(to_json({{'severity': severity, 'depscore': depscore, 'reachability_level': reachability_level, 'status': status}}) AS VARCHAR) FROM a
    UNION ALL SELECT project_id, osv_id, 'dependency', project_dependency_id, CAST(to_json({{'name': name, 'version': version, 'is_direct': is_direct, 'environment': environment, 'files_importing_count': files_importing_count, 'package_score': package_score}}) AS VARCHAR) FROM dep
    UNION ALL SELECT dep.project_id, osv_id, 'file', dep.project_dependency_id || '|' || file_path, CAST(to_json({{'file_path': file_path}}) AS VARCHAR) FROM dep JOIN um USING (project_dependency_id)
    UNION ALL SELECT x.project_id, osv_id, 'candidate', CAST(x.dependency_id AS VARCHAR) || '|' || x.cur_version || '|' || candidate, CAST(to_json({{'cves_fixed': cves_fixed, 'cves_new': cves_new, 'is_major_bump': is_major_bump, 'is_banned': is_banned}}) AS VARCHAR)
      FROM (SELECT DISTINCT project_id, osv_id, dependency_id, version AS cur_version FROM dep) x JOIN cand c ON c.project_id = x.project_id AND c.dependency_id = x.dependency_id AND c.cur_version = x.cur_version
    UNION ALL SELECT project_id, osv_id, 'event', item, CAST(to_json({{'event_type': event_type, 'created_at': moment}}) AS VARCHAR) FROM ev
    UNION ALL SELECT project_id, osv_id, 'advisory', CAST(item AS VARCHAR), CAST(to_json({{'advisory_id': item, 'severity': severity}}) AS VARCHAR) FROM ad
    UNION ALL SELECT project_id, osv_id, 'flow', flow_id, CAST(to_json({{'flow_length': flow_length, 'entry_point_file': entry_point_file, 'sink_method': sink_method, 'is_suppressed': is_suppressed}}) AS VARCHAR) FROM fl""")
def _(v):
    deps = evidence.affected_packages(v.findings, v.projects, v.project_dependencies)
    files = evidence.usage_match(active_run(v.usages, v.projects), deps)
    banned = matching.banned_versions(deps, v.banned_versions, v.projects, v.project_teams)
    candidates = matching.version_candidates(deps, v.dependency_versions, advisories(v), banned)
    return evidence.finding_detail(v.findings, deps, v.dependencies, v.projects, v.finding_events, v.advisories, v.flows, v.flow_suppressions, files, candidates)


@query("jn29_license_obligations", """
    SELECT project_id, coalesce(license, 'Unknown') AS license, count(*) AS packages, any_value(o.is_copyleft) AS is_copyleft, any_value(o.summary) AS summary FROM project_dependencies d JOIN dependencies x USING (dependency_id) LEFT JOIN license_obligations o ON o.license_spdx_id = x.license WHERE removed_at IS NULL GROUP BY 1, 2""")
def _(v):
    return evidence.license_obligations(v.project_dependencies, v.dependencies, v.license_obligations).drop("full_text")


@query("agg42_capability_or", r"""
    SELECT source, lang, bool_or(regexp_matches(text, '(?i)(token = "[0-9a-f]{32,}|fromCharCode|atob\()')) AS encrypted_payload, bool_or(regexp_matches(text, '(?i)\b(fetch\(|axios|urllib|requests\.(get|post)|socket|https?://)')) AS network_io, bool_or(regexp_matches(text, '(?i)(process\.env|os\.environ|getenv)')) AS reads_env FROM documents GROUP BY 1, 2""")
def _(v):
    return evidence.capability_or(v.documents, ["source", "lang"]).select("source", "lang", "encrypted_payload", "network_io", "reads_env")
