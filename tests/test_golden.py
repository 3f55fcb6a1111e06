"""Golden cases on tiny inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.functions import labels, packages, scores, text, versions
from larkspur.operators import evidence, filters, graph, matching, policy, runs, summaries

C = F.col


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value, kind=None):
    out = F.lit(value)
    return out.cast(kind) if kind else out


def test_depscore_numbers(spark):
    def score(level, reachable=True, kev=True, epss=0.0, direct=True, dev=False, bad=False, rep=None):
        return one(spark, scores.depscore(lit(9.8), lit(epss), lit(kev), lit(1.0), lit(direct), lit(dev), lit(bad), lit(rep, "long"), lit(level, "string"), lit(reachable)))

    assert score("confirmed") == 100
    assert score("module") == 59
    assert score("unreachable") == 0
    assert score(None, reachable=False) == 24
    assert score("function", kev=False, epss=0.25) == 62
    assert score("module", direct=False, dev=True) == 18
    assert score("module", rep=20) == 68


def test_packages_are_mentioned_on_token_boundaries(spark):
    usages = spark.createDataFrame([(1, "MyDecoder", "com.acme.redistribute"), (2, "redis.Client", "redis.Client.fetch_all"), (2, "x", "@scope/code.run_it")], "project_id long, target_type string, resolved_method string")
    deps = spark.createDataFrame([(p, f"{p}:{n}", n) for p in (1, 2) for n in ("redis", "code", "@scope/code", "--")], "project_id long, project_dependency_id string, name string")
    got = {r["project_dependency_id"]: r["usage_strong"] for r in evidence.usage_strength(usages, deps).collect()}
    assert got == {"2:redis": True, "2:code": True, "2:@scope/code": True}


def test_unknown_inputs_never_score_as_the_maximum(spark):
    def base(cvss, epss, importance):
        return one(spark, scores.base_depscore(lit(cvss, "double"), lit(epss, "double"), lit(False), lit(importance, "double"), lit(True), lit(False), lit(False), lit(None, "long")))

    assert one(spark, scores.importance_weight(lit(None, "double"))) == 1.0
    assert base(10.0, None, 1.0) == base(10.0, 0.0, 1.0) == 60
    assert base(None, 0.0, 1.0) == 0 and base(10.0, 0.0, None) == 60
    assert one(spark, scores.secret_depscore(lit("AWS"), lit(True), lit(True), lit(None, "double"))) == 90
    assert one(spark, scores.capped(lit(None, "double"))) is None


def test_deadline_lists_are_whole_or_limited_per_organization(spark):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(i, i % 2, "on_track", None, None, day(0), day(20 + i)) for i in range(300)]
    findings = spark.createDataFrame(rows, "finding_id long, project_id long, sla_status string, sla_warning_notified_at timestamp, sla_breach_notified_at timestamp, sla_warning_at timestamp, sla_deadline_at timestamp")
    projects = spark.createDataFrame([(0, 10), (1, 11)], "project_id long, organization_id long")
    organizations = spark.createDataFrame([(10, None), (11, None)], "organization_id long, sla_paused_at timestamp")
    assert filters.sla_approaching(findings, projects, organizations, now=F.lit(day(10))).count() == 300
    assert filters.sla_newly_breached(findings, projects, organizations, now=F.lit(day(900))).count() == 300
    few = filters.sla_approaching(findings, projects, organizations, now=F.lit(day(10)), per_organization=2).collect()
    assert sorted(r["finding_id"] for r in few) == [0, 1, 2, 3]


def test_cvss_vectors(spark):
    assert one(spark, scores.cvss3_score(lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"))) == 9.8
    assert one(spark, scores.cvss3_score(lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"))) == 10.0
    assert one(spark, scores.cvss3_score(lit("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N"))) == 0.0
    assert one(spark, scores.cvss3_score(lit("CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P"))) is None
    assert one(spark, scores.cvss3_score(lit("CVSS:3.1/AV:N/AC:L"))) is None


@pytest.mark.parametrize("kind,level,reachable,kev,rule,severity,payload,want", [
    ("container", None, None, True, None, None, None, None),
    ("container", None, None, False, None, None, None, "base_image"),
    ("iac", None, None, None, "CKV_K8S_16", "LOW", None, None),
    ("iac", None, None, None, "CKV_K8S_38", "CRITICAL", None, "iac_hardening"),
    ("iac", None, None, None, "OTHER", "high", None, None),
    ("dast", None, None, None, None, "low", "  ", "passive_hygiene"),
    ("dast", None, None, None, None, "low", "q=1", None),
    ("dast", None, None, None, None, "HIGH", None, None),
    ("vulnerability", "confirmed", False, None, None, None, None, None),
    ("vulnerability", "unreachable", True, None, None, None, None, "not_reachable"),
    ("vulnerability", "function", False, None, None, None, None, "not_reachable"),
    ("vulnerability", "module", True, None, None, None, None, "unconfirmed_reachable"),
    ("vulnerability", None, True, None, None, None, None, None),
    ("secret", None, None, None, None, None, None, None),
])
def test_auto_ignore_table(spark, kind, level, reachable, kev, rule, severity, payload, want):
    got = labels.auto_ignore_reason(lit(kind), lit(level, "string"), lit(reachable, "boolean"), lit(kev, "boolean"), lit(rule, "string"), lit(severity, "string"), lit(payload, "string"))
    assert one(spark, got) == want


def test_composition_folds_into_score(spark):
    findings = spark.createDataFrame([("a", 70.0), ("b", 70.0), ("c", None)], "finding_id string, contextual_depscore double")
    factors = spark.createDataFrame([("a", 0.36), ("a", 0.9), ("b", 0.0)], "finding_id string, composition_factor double")
    got = {r["finding_id"]: r["contextual_depscore"] for r in evidence.min_factor(findings, factors).collect()}
    assert got == {"a": 25.2, "b": 0.0, "c": None}


def test_feed_ranges_and_exact_versions(spark):
    feed = spark.createDataFrame([
        (1, "osv", "MAL-1", "npm", "left-pad", None, "< 2.0.0", None, None), (2, "osv", "MAL-2", "npm", "Chalk", "v5.6.1", None, None, None),
        (3, "osv", "MAL-3", "npm", "left-pad", None, "garbage range", None, None), (4, "osv", "MAL-4", "npm", "any", None, None, None, None),
        (5, "osv", "MAL-5", "npm", "ranged", None, ">= 1.0.0, < 2.0.0", None, None), (6, "ghsa", "MAL-6", "pip", "Flask_Login", "1.0", None, dt.datetime(2024, 1, 1), None),
    ], "feed_id int, source string, source_id string, ecosystem string, package_name string, version string, vulnerable_range string, withdrawn_at timestamp, severity string")
    deps = spark.createDataFrame(
        [(n, e, v) for n, e, v in [("left-pad", "npm", "1.5.0"), ("left-pad", "npm", "2.0.0"), ("left-pad", "npm", "2.5.0"), ("chalk", "npm", "5.6.1"), ("chalk", "npm", "5.6.2"), ("any", "npm", "1.0.0"), ("ranged", "npm", "0.9.0"), ("ranged", "npm", "1.0.0"), ("flask-login", "pypi", "1.0.0")]],
        "name string, ecosystem string, version string")
    got = {(r["name"], r["version"], r["feed_id"]) for r in matching.match_malware_feed(deps, feed).collect()}
    assert got == {("left-pad", "1.5.0", 1), ("chalk", "5.6.1", 2), ("ranged", "1.0.0", 5)}


def test_unique_artifact_needs_one_group(spark):
    feed = spark.createDataFrame(
        [(1, "osv", "M1", "maven", "org.a:core", "1.0", None, None, None), (2, "osv", "M2", "maven", "org.b:core", "1.0", None, None, None), (3, "osv", "M3", "maven", "org.a:solo", "1.0-RELEASE", None, None, None)],
        "feed_id int, source string, source_id string, ecosystem string, package_name string, version string, vulnerable_range string, withdrawn_at timestamp, severity string")
    deps = spark.createDataFrame([("core", "maven", "1.0"), ("solo", "maven", "1.0.RELEASE")], "name string, ecosystem string, version string")
    assert [(r["name"], r["feed_id"]) for r in matching.match_unique_artifact(deps, feed).collect()] == [("solo", 3)]


def test_affected_intervals_and_missing_ranges(spark):
    rows = spark.createDataFrame([(1, 9, "1.5.0"), (2, 9, "2.0.0"), (3, 9, "3.1"), (4, 9, "latest")], "version_id int, dependency_id int, version string")
    adv = spark.createDataFrame([
        (10, 9, [("1.0.0", "2.0.0"), ("3.0.0", None)], None, False), (11, 9, None, None, True), (12, 9, None, ["v2.0"], False), (13, 9, [(None, "9.0.0")], None, False)],
        "advisory_id int, dependency_id int, ranges array<struct<introduced:string,fixed:string>>, versions array<string>, ranges_missing boolean")
    got = {(r["version_id"], r["advisory_id"]) for r in matching.affected_versions(rows, adv).collect()}
    assert got == {(1, 10), (3, 10), (2, 12), (1, 11), (2, 11), (3, 11), (4, 11)}


def test_prod_scope_wins(spark):
    rows = spark.createDataFrame([("p", "lodash", "c", "dev"), ("p", "lodash", "b", None), ("p", "lodash", "a", "dev"), ("p", "x", "z", "dev")], "project string, name string, id string, environment string")
    got = {r["name"]: r["id"] for r in matching.prefer_prod_scope(rows, ["project", "name"], "id").collect()}
    assert got == {"lodash": "b", "x": "z"}


def test_top_vulnerabilities(spark):
    rows = [("CVE-X", "critical", 99, 1), ("CVE-X", "critical", 80, 2), ("CVE-A", "high", 95, 2), ("CVE-A", "low", 99, 3), ("CVE-B", "critical", 90, 3), ("CVE-C", "medium", 100, 1)]
    findings = spark.createDataFrame([(o, s, d, p, "r", False) for o, s, d, p in rows], "osv_id string, severity string, depscore long, project_id long, extraction_run_id string, suppressed boolean")
    projects = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "project_id long, active_extraction_run_id string")
    got = [(r["osv_id"], r["depscore"], r["worst_project_id"], r["affected_project_count"]) for r in summaries.top_vulns(findings, projects).collect()]
    assert got == [("CVE-X", 99, 1, 2), ("CVE-A", 95, 2, 2), ("CVE-B", 90, 3, 1)]


def test_drift_buckets(spark):
    projects = spark.createDataFrame([(1, "2", "1"), (2, "2", None)], "project_id long, active_extraction_run_id string, previous_extraction_run_id string")
    events = spark.createDataFrame([
        (1, "1", "d1", "v1", "module", None), (1, "2", "d1", "v1", "function", None), (1, "1", "d2", "v1", "unreachable", "orphan"), (1, "2", "d2", "v1", "module", None),
        (1, "1", "d3", "v1", "function", None), (1, "2", "d3", "v1", "confirmed", None), (2, "2", "d1", "v1", "confirmed", None)],
        "project_id long, extraction_run_id string, project_dependency_id string, osv_id string, reachability_level string, verdict string")
    got = {r["prior_verdict"]: (r["upgraded_count"], r["silence_fn_count"], r["to_levels"]) for r in runs.silence_drift(events, projects).collect()}
    assert got == {"module": (1, 1, ["function"]), "orphan": (1, 0, ["module"])}


def _finding(fid, pd, run, **kw):
    base = dict(finding_id=fid, project_id=1, project_dependency_id=pd, osv_id="CVE-1", extraction_run_id=run, severity="high", cisa_kev=False, reachability_level="module", status="open", suppressed=False, risk_accepted=False,
                detected_at=dt.datetime(2024, 1, 1), sla_status=None, sla_deadline_at=None, sla_warning_at=None, sla_breached_at=None, sla_met_at=None, sla_warning_notified_at=None, sla_breach_notified_at=None, runtime_confirmed_at=None)
    return {**base, **kw}


FINDING = ("finding_id string, project_id long, project_dependency_id string, osv_id string, extraction_run_id string, severity string, cisa_kev boolean, reachability_level string, status string, suppressed boolean, risk_accepted boolean, "
           "detected_at timestamp, sla_status string, sla_deadline_at timestamp, sla_warning_at timestamp, sla_breached_at timestamp, sla_met_at timestamp, sla_warning_notified_at timestamp, sla_breach_notified_at timestamp, runtime_confirmed_at timestamp")


def test_carry_forward_prefers_same_row_then_version_then_oldest(spark):
    deps = spark.createDataFrame([("a1", "lib", "1.0"), ("a2", "lib", "2.0"), ("a3", "lib", "1.0"), ("b", "other", "1.0")], "project_dependency_id string, name string, version string")
    old = spark.createDataFrame([
        _finding("o1", "a1", "1", status="ignored", detected_at=dt.datetime(2023, 5, 1)), _finding("o2", "a2", "1", status="resolved", detected_at=dt.datetime(2023, 1, 1)),
        _finding("o3", "a1", "1", status="late", detected_at=dt.datetime(2023, 6, 1), runtime_confirmed_at=dt.datetime(2023, 7, 1))], FINDING)
    new = spark.createDataFrame([_finding("n1", "a1", "2"), _finding("n2", "a2", "2"), _finding("n3", "a3", "2"), _finding("n4", "b", "2")], FINDING)
    got = {r["finding_id"]: (r["status"], r["carried"], r["reachability_level"]) for r in runs.carry_forward(new, old, deps).collect()}
    assert got == {"n1": ("ignored", True, "module"), "n2": ("resolved", True, "module"), "n3": ("ignored", True, "module"), "n4": ("open", False, "module")}


def test_commit_closes_missing_packages(spark):
    projects = spark.createDataFrame([(1, "2")], "project_id long, active_extraction_run_id string")
    deps = spark.createDataFrame([("a", 1, None, "2"), ("b", 1, None, "1"), ("c", 1, None, None)], "project_dependency_id string, project_id long, removed_at timestamp, last_seen_extraction_run_id string")
    closed = runs.close_missing(deps, projects, now=F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r["project_dependency_id"] for r in closed.collect()) == ["b", "c"]


def test_version_order(spark):
    def ordered(values, key):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r["v"] for r in df.orderBy(key(C("v"))).collect()]

    pep = ["1.0.dev1", "1.0a1", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.1", "1.10"]
    assert ordered(list(reversed(pep)), versions.pep440_key) == pep
    gem = ["1.0.0.alpha", "1.0.0", "1.0.1", "1.10.0"]
    assert ordered(list(reversed(gem)), versions.gem_key) == gem
    sem = ["0.9.0", "v1.2", "1.10.0", "release-2.0.1"]
    assert ordered(list(reversed(sem)), versions.version_key) == sem
    assert one(spark, versions.version_key(lit("latest"))) is None
    assert one(spark, versions.pep440_key(lit("1.0")) == versions.pep440_key(lit("1.0.0"))) is True


@pytest.mark.parametrize("raw,eco,want", [
    ("v1.2", "npm", "1.2.0"), ("1.2.3-Beta.1+sha", "npm", "1.2.3-beta.1"), ("1.2.3.4", "npm", None), ("01.2", "pypi", "1.2.0"), ("1.0-post_1", "pypi", "1.0.0post1"),
    ("1.0-RELEASE", "maven", "1.0.release"), ("1.0-1", "maven", "1.0-1"), ("V1.0", "golang", "1.0"), ("", "npm", None)])
def test_version_norm(spark, raw, eco, want):
    assert one(spark, versions.version_norm(lit(raw), lit(eco))) == want


@pytest.mark.parametrize("textual,want", [
    ("2.10.1", [("=", "2.10.1")]), ("= 2.10.1", [("=", "2.10.1")]), ("< 2.0.0", [("<", "2.0.0")]), (">= 1.0, < 2.0", [(">=", "1.0"), ("<", "2.0")]), ("not a range", None), (">= 1.0, oops", None), ("", None)])
def test_parse_range(spark, textual, want):
    got = one(spark, versions.parse_range(lit(textual)))
    assert (None if got is None else [tuple(g) for g in got]) == want


def test_purls(spark):
    def parsed(p):
        r = one(spark, packages.parse_purl(lit(p)))
        return None if r is None else tuple(r)

    assert parsed("pkg:npm/%40acme/x@1.0?arch=1#s") == ("npm", "@acme/x", "1.0", "@acme")
    assert parsed("pkg:maven/org.a/core@2") == ("maven", "org.a:core", "2", "org.a")
    assert parsed("pkg:pypi/flask") is None
    assert parsed("pkg:unknown/x@1") is None
    assert one(spark, packages.build_purl(lit("gem"), lit("rails"), lit("7"))) == "pkg:gem/rails@7"


def test_licenses(spark):
    assert one(spark, text.license_key(lit("BSD 3-Clause License"))) == "bsd-3clause-3"
    assert one(spark, text.license_key(lit("Zero Clause BSD (0BSD)"))) == "0bsd"
    assert one(spark, text.license_allowed(lit("(MIT OR GPL-3.0)"), ["MIT"])) is True
    assert one(spark, text.license_allowed(lit("GPL-3.0"), ["MIT"])) is False
    assert one(spark, text.license_allowed(lit("Unknown"), ["MIT"])) is None


def test_route_templates(spark):
    def fits(pattern, path):
        return one(spark, F.regexp(lit(path), text.route_regex(lit(pattern))))

    assert fits("/users/:id", "/users/7") and not fits("/users/:id", "/users/7/x")
    assert fits("/files/*", "/files") and fits("/files/*", "/files/a/b")
    assert fits("/v1.0/{id}", "/v1.0/3") and not fits("/v1.0/{id}", "/v1x0/3")
    assert fits("/a/<int:n>/b", "/a/3/b") and fits("/", "/")


def test_dast_unknown_severity_is_null_per_row_and_48_in_summaries(spark):
    args = (lit("odd"), lit("high"), lit("thing"), lit(False), lit(False))
    assert one(spark, scores.dast_depscore(*args)) is None
    assert one(spark, scores.dast_depscore(*args, unknown_base=48)) == 54
    assert one(spark, scores.dast_depscore(lit("odd"), lit(None, "string"), lit(None, "string"), lit(True), lit(True))) is None


def test_preflight_and_failing_policy(spark):
    schema = "name string, is_malicious boolean, malicious_reason string, importance double, license string, score int"
    package = {"name": "x", "is_malicious": False, "malicious_reason": None, "importance": 1.5, "license": "AGPL-3.0", "score": 10}
    got = policy.preflight(spark, package, policy.DEFAULT_RULES, schema).first()["policy_result"]
    assert not got["allowed"] and got["reasons"] == ["Banned license for high-importance project: AGPL-3.0"]

    def broken(batch):
        raise ValueError("boom")

    refused = policy.evaluate_python(spark.createDataFrame([package], schema), broken).first()["policy_result"]
    assert not refused["allowed"] and "boom" in refused["reasons"][0]
    assert one(spark, policy.known_status(lit("odd"), ("Compliant",))) == "Non-Compliant"


def test_taint_paths_stop_at_sanitizers(spark):
    calls = spark.createDataFrame([(1, a, b) for a, b in [("s", "x"), ("x", "k"), ("s", "clean"), ("clean", "k2"), ("x", "s"), ("x", "y"), ("y", "k")]], "project_id long, caller string, callee string")
    roles = spark.createDataFrame([(1, "s", "source"), (1, "k", "sink"), (1, "k2", "sink"), (1, "clean", "sanitizer")], "project_id long, fn string, role string")
    got = [(r["source"], r["sink"], r["hops"], r["path"]) for r in graph.taint_flows(calls, roles).collect()]
    assert got == [("s", "k", 2, "s>x>k")]


def test_ladder_never_unreachable_without_analysis(spark):
    cols = "confirmed_flows int, data_flow_flows int, environment string, symbol_hit boolean, usage_seen boolean, usage_strong boolean, usage_ran boolean, files_importing_count int, is_direct boolean, ecosystem string, name string, graph_trusted boolean, client_spa boolean, transitive_of_reachable boolean, call_reached boolean"
    base = (0, 0, None, None, None, None, True, 0, False, "npm", "lib", True, False, None, None)
    cases = {base: "unreachable"}
    for index, value, want in [(6, None, "module"), (11, False, "module"), (12, True, "module"), (13, True, "module"), (14, True, "module"), (10, "jetty-server", "module"), (10, "react", "module"), (0, 1, "confirmed"), (1, 2, "data_flow"), (2, "Test", "unreachable"), (3, True, "function"), (7, None, "module")]:
        row = list(base)
        row[index] = value
        cases[tuple(row)] = want
    for row, want in cases.items():
        assert spark.createDataFrame([row], cols).select(evidence.reachability_level().alias("l")).first()["l"] == want, row
