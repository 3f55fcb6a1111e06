"""Findings of round 4: rows that grow with a product are never exchanged, others as seldom as possible."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import evidence, filters, matching, policy, ranking
from larkspur.plans.registry import Views


def plan_of(df):
    """The plan before it was adapted to a run."""
    parts = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
    return parts[min(1, len(parts) - 1)]


def above_joins(df):
    """The plan above its first join."""
    text = plan_of(df)
    return text[: min(text.index(j) for j in ("SortMergeJoin", "BroadcastHashJoin") if j in text)]


def test_preflight_pairs_are_made_last(spark):
    catalog = spark.createDataFrame([(d, lic, score, bad, None) for d, lic, score, bad in [(1, "MIT", 90, False), (2, "AGPL-3.0", 10, False), (3, None, None, None), (4, "GPL-3.0", 50, True)]],
                                    "dependency_id long, license string, score long, is_malicious boolean, malicious_reason string")
    projects = spark.createDataFrame([(p, i, p % 2) for p, i in [(10, 0.5), (11, 1.4), (12, None), (13, 0.5)]], "project_id long, importance double, k long")
    asked = spark.createDataFrame([(d, d % 2) for d in (1, 1, 2, 3, 4, 5, 6)], "dependency_id long, k long")
    installed = spark.createDataFrame([(10, 2, 0), (10, 4, 0), (11, 3, 1), (13, 2, 0)], "project_id long, dependency_id long, k long")
    out = policy.preflight_slices(asked, installed, catalog, projects, policy.DEFAULT_RULES, "k")
    pairs = asked.join(projects, "k").select("project_id", "dependency_id")
    plain = policy.preflight_candidates(pairs, installed, catalog, projects, policy.DEFAULT_RULES).select("project_id", "dependency_id", "policy_result")
    rows = lambda df: sorted((p, d, r.allowed, r.reasons) for p, d, r in df.collect())
    assert rows(out) == rows(plain) and len(rows(out)) == 9
    assert "Exchange" not in above_joins(out) and "Aggregate" not in above_joins(out)


def test_visible_projects_are_made_last_and_once(spark):
    schema = "user_id long, scope string, scope_id long"
    grants = spark.createDataFrame([(1, "organization", 7), (2, "team", 1), (2, "team", 2), (2, "project", 100), (2, "project", 103), (2, "project", 200), (3, "project", 101), (3, "project", 101), (4, "team", 1)], schema)
    projects = spark.createDataFrame([(100, 7), (101, 7), (102, 7), (103, 7), (200, 8)], "project_id long, organization_id long")
    teams = spark.createDataFrame([(100, 1), (100, 2), (100, 2), (101, 2), (102, 3), (200, 1)], "project_id long, team_id long")
    members = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, 7)], "user_id long, organization_id long")
    out = filters.accessible_projects(grants, projects, teams, members)
    assert sorted(map(tuple, out.collect())) == [(1, 100, 7), (1, 101, 7), (1, 102, 7), (1, 103, 7), (2, 100, 7), (2, 101, 7), (2, 103, 7), (3, 101, 7), (4, 200, 8)]
    assert "Exchange" not in above_joins(out) and "Aggregate" not in above_joins(out)
    assert all("_part" in line for line in plan_of(out).splitlines() if "Exchange hashpartitioning(organization_id" in line)


def test_version_pages_are_made_once_for_all_projects(spark):
    current = spark.createDataFrame([(1, 5, "1.0.0"), (2, 5, "1.0.0"), (3, 5, "3.0.0-rc.1"), (3, 5, "3.0.0-rc.1"), (4, 6, "1.0.0")], "project_id long, dependency_id long, version string")
    counts = spark.createDataFrame([(50, 5, "1.0.0", 1), (51, 5, "2.0.0", 0), (52, 5, "3.0.0-rc.1", 2)], "version_id long, dependency_id long, version string, critical_vulns long")
    banned = spark.createDataFrame([(2, 5, "2.0.0"), (2, 5, "1.0.0"), (4, 5, "1.0.0")], "project_id long, dependency_id long, version string")
    out = ranking.version_list(current, counts, banned, number=1, size=2)
    got = sorted((r.project_id, r.version, r.is_banned, r.total) for r in out.collect())
    assert got == [(1, "1.0.0", False, 2), (1, "2.0.0", False, 2), (2, "1.0.0", True, 2), (2, "2.0.0", True, 2), (3, "2.0.0", False, 3), (3, "3.0.0-rc.1", False, 3)]
    windows = [line for line in plan_of(out).splitlines() if "Window" in line]
    assert windows and not any("project_id" in line for line in windows)


def test_hits_and_packages_are_exchanged_once(spark):
    hits = spark.createDataFrame(
        [(1, 1, "g/b", "npm", "1"), (1, 1, "g/b", "npm", "1"), (2, 1, "My_Lib", "PyPI", "1"), (3, 1, "a:b", None, "1"), (4, 1, "g/ B ", "npm", "1"), (5, 1, "g/b", "npm", None),
         (6, None, "g/b", "npm", "1"), (7, 1, None, "npm", "1"), (8, 1, "x/y", "maven", "2"), (9, 1, "none", "npm", "1")], "hit_id long, project_id long, ref_name string, ecosystem string, version string")
    deps = spark.createDataFrame(
        [(1, "1:b2", "b", "1", None, "npm"), (1, "1:b1", "b", "1", "dev", "npm"), (1, "1:my", "my.lib", "1", None, "pypi"), (1, "1:c", "A:B", "1", None, "maven"), (1, "1:gb", "g/ b", "1", None, "npm"),
         (1, "1:xy", "x:y", "2", "dev", "maven"), (1, "1:y", "y", "2", None, "maven"), (1, "1:n", None, "1", None, "npm"), (None, "0:b", "b", "1", None, "npm"), (1, "1:v", "b", None, None, "npm")],
        "project_id long, project_dependency_id string, name string, version string, environment string, ecosystem string")
    out = matching.attach_advisories(hits, deps)
    got = sorted((r.hit_id, r.rung, r.project_dependency_id) for r in out.collect())
    assert got == [(1, 3, "1:b2"), (1, 3, "1:b2"), (2, 4, "1:my"), (3, 4, "1:c"), (4, 4, "1:gb"), (8, 2, "1:xy")]
    assert plan_of(out).count("Exchange") == 1 and out.columns == [*hits.columns, "rung", "project_dependency_id"]


def test_both_sides_of_a_composition_are_exchanged_once_to_their_cve(spark):
    run = "project_id long, extraction_run_id string"
    container = spark.createDataFrame(
        [("c1", 1, "r", "Libz", "cve-1", None, "module"), ("c2", 1, "r", "libz", "CVE-1", "DSA-1", "unreachable"), ("c3", 1, None, "libz", "CVE-1", None, None), ("c4", 1, "r", "nolib", "CVE-2", None, None)],
        f"finding_id string, {run}, os_package_name string, cve_id string, osv_id string, reachability_level string")
    findings = spark.createDataFrame(
        [("f1", 1, "r", "1:a", "CVE-1", None, "confirmed"), ("f2", 1, "r", "1:a", "GHSA-1", ["CVE-1"], "module"), ("f3", 1, None, "1:a", "CVE-1", None, "confirmed"), ("f4", 1, "r", "1:a", "CVE-2", None, "confirmed"),
         ("f5", 1, "r", "1:b", "CVE-1", None, "confirmed"), ("f6", 1, "r", "1:a", "DSA-1", None, None)], f"finding_id string, {run}, project_dependency_id string, osv_id string, aliases array<string>, reachability_level string")
    deps = spark.createDataFrame([("1:a", "npm", "Z"), ("1:b", "npm", "other")], "project_dependency_id string, ecosystem string, name string")
    bindings = spark.createDataFrame([("os", "LIBZ", None, "libz.so"), ("os", "libz", None, None), ("language", "z", "npm", "libz.so"), ("language", "other", "npm", "libq.so")], "scope string, package_identifier string, package_ecosystem string, soname string")
    out = evidence.compose_container(container, findings, deps, bindings)
    assert sorted(map(tuple, out.collect())) == [("f1", 0.4), ("f2", 0.2)]
    text = plan_of(out)
    assert sum("Exchange hashpartitioning(project_id" in line and "cve" in line for line in text.splitlines()) == 1


def test_sites_and_packages_are_exchanged_once_to_their_project(spark, monkeypatch):
    usages = spark.createDataFrame(
        [(1, "a.js", "com.Foo.bar", None), (1, "a.js", "com.Foo.bar", "foo-bar.x"), (1, "b.js", None, "FOO"), (1, None, "foo", "foo"), (2, "a.js", "none", ""), (2, "c.js", "zed", "foo"), (None, "a.js", "foo", None)],
        "project_id long, file_path string, target_type string, resolved_method string")
    deps = spark.createDataFrame([(1, "1:f", "foo"), (1, "1:g", "Foo-Bar"), (1, "1:n", None), (2, "2:z", "zed"), (2, "2:q", "quux"), (3, "3:f", "foo"), (None, "0:f", "foo")], "project_id long, project_dependency_id string, name string")
    want = [(1, "1:f", "a.js"), (1, "1:f", "b.js"), (1, "1:g", "a.js"), (2, "2:z", "c.js")]
    assert sorted(map(tuple, evidence.usage_match(usages, deps).collect())) == want
    monkeypatch.setattr(evidence, "HOT_SITES", 1)  # every project of two sites is dealt over salts
    out = evidence.usage_match(usages, deps)
    lines = [line for line in plan_of(out).splitlines() if "Exchange" in line]
    assert sum("hashpartitioning(project_id" in line and "_salt" in line for line in lines) == 1
    assert not any("needle" in line and "project_id" in line for line in lines)
    assert sorted(map(tuple, out.collect())) == want


def test_a_detail_asks_only_for_packages_that_have_findings(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    asked = []
    monkeypatch.setattr(evidence, "usage_match", lambda usages, deps: asked.append(deps) or deps.select("project_id", "project_dependency_id", F.lit("f").alias("file_path")))
    candidates = matching.version_candidates
    monkeypatch.setattr(matching, "version_candidates", lambda current, *rest: asked.append(current) or candidates(current, *rest))
    rows = entry.QUERIES["agg45_finding_detail"](spark, sf_dir)
    named = {(r.project_id, r.item) for r in rows.filter("section = 'dependency'").select("project_id", "item").collect()}
    for deps in asked:
        assert {(r.project_id, r.project_dependency_id) for r in deps.select("project_id", "project_dependency_id").collect()} == named
    assert len(asked) == 2 and named


def test_only_packages_with_findings_have_their_call_sites_looked_at(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    asked, strength = [], evidence.usage_strength
    monkeypatch.setattr(evidence, "usage_strength", lambda usages, deps: asked.append(deps) or strength(usages, deps))
    entry.QUERIES["reachability_classify"](spark, sf_dir)
    v = Views(spark, sf_dir)
    named = {r[0] for r in filters.active_run(v.findings, v.projects).select("project_dependency_id").distinct().collect()}
    assert len(asked) == 1 and {r[0] for r in asked[0].select("project_dependency_id").collect()} == named
